"""Translation checks, finalization of reviewed question sets, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from .dedupe import last_wins


def back_similarity(question: Column, back: Column) -> Column:
    """Token F1 with the back-translation; null without one."""
    return F.when(F.coalesce(back, F.lit("")) != "", text.token_f1(question, back))


def check(candidates: DataFrame, drift_below: float = 0.5, unchanged_from: float = 0.95) -> DataFrame:
    """Candidates (qid, question_msa, dialect_candidate, backtranslation_msa) with bt, dd and flags."""
    q, c = F.col("question_msa"), F.col("dialect_candidate")
    bt = back_similarity(q, F.col("backtranslation_msa"))
    return candidates.withColumn("bt", bt).withColumn("dd", text.token_f1(q, c)).withColumn("flags", text.qc_flags(q, c, F.col("bt"), drift_below, unchanged_from))


def validation_sheet(checked: DataFrame) -> DataFrame:
    empty = F.lit("")
    return checked.select("qid", F.col("question_msa").alias("msa_question"), "dialect_candidate", empty.alias("APPROVE_or_REWRITE"), empty.alias("your_rewrite"), empty.alias("fluency_1_5"), F.array_join("flags", "|").alias("auto_flags"), F.coalesce(text.fixed(F.col("bt"), 3), empty).alias("backtrans_sim"), text.fixed(F.col("dd"), 3).alias("dialect_distance"))


def flag_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n"), F.avg("bt").alias("mean_bt"), F.avg("dd").alias("mean_dd"), F.count_if(F.size("flags") > 0).alias("n_flagged"))


def reviewed(candidates: DataFrame, sheet: DataFrame, min_back: float = 0.4, seq: str | None = None) -> DataFrame:
    """Reviewed rows: state, final text, bt, dd, edit, fluency, excluded. Unmatched rows go; unreviewed ones keep state 'unreviewed'."""
    c = last_wins(candidates, ["qid"], seq) if seq else candidates.dropDuplicates(["qid"])
    extra = [x for x in ("APPROVE_or_REWRITE", "your_rewrite", "fluency_1_5") if x in sheet.columns]
    j = sheet.select("qid", *extra).join(c, "qid")
    rewrite = text.ws_trim(text.text_or_empty("your_rewrite"))
    j = j.withColumn("state", labels.review_state(F.col("APPROVE_or_REWRITE"), F.col("your_rewrite")))
    j = j.withColumn("final", F.when((F.col("state") == "rewritten") & (rewrite != ""), rewrite).otherwise(F.col("dialect_candidate")))
    j = j.withColumn("bt", back_similarity(F.col("question_msa"), F.col("backtranslation_msa"))).withColumn("dd", text.token_f1(F.col("question_msa"), F.col("final")))
    j = j.withColumn("edit", F.when(F.col("state") == "rewritten", text.edit_distance(F.col("dialect_candidate"), F.col("final"))).otherwise(0.0)).withColumn("fluency", labels.fluency(text.text_or_empty("fluency_1_5")))
    return j.withColumn("excluded", hard_filter(F.col("bt"), F.col("state"), min_back))


def hard_filter(bt: Column, state: Column, min_back: float = 0.4) -> Column:
    """Meaning drifted and nobody rewrote it, or it was dropped."""
    return (F.coalesce(bt < min_back, F.lit(False)) & (state != "rewritten")) | (state == "dropped")


def finalize_metrics(rows: DataFrame, min_back: float = 0.4, seq: str = "qid") -> DataFrame:
    """The summary of a reviewed set: rates over reviewed rows, distance over kept ones, edits over rewritten ones, the sub-variety of the first (by ``seq``)."""
    seen, kept, rewritten = F.col("state") != "unreviewed", ~F.col("excluded"), F.col("state") == "rewritten"
    n = F.count_if(seen)
    when = lambda c, v: F.when(c, F.col(v))
    return rows.agg(
        F.coalesce(F.min_by("sub_variety", F.when(seen, F.col(seq))), F.lit("")).alias("sub_variety"), n.alias("n_reviewed"), F.count_if(~seen).alias("n_unreviewed"),
        F.bround(F.try_divide(F.count_if(F.col("state") == "approved"), n), 3).alias("acceptance_rate"), F.bround(F.try_divide(F.count_if(rewritten), n), 3).alias("rewrite_rate"),
        F.bround(F.avg(when(rewritten, "edit")), 3).alias("mean_edit_distance_on_rewrites"), F.bround(F.avg(when(seen, "bt")), 3).alias("mean_backtrans_similarity"),
        F.bround(F.avg(when(seen & kept, "dd")), 3).alias("mean_dialect_distance"), F.bround(F.avg(when(seen, "fluency")), 2).alias("mean_fluency_1_5"),
        F.count_if(seen & ~kept).alias("n_filtered_out"), F.count_if(seen & kept).alias("n_final_benchmark"), F.lit(min_back).alias("min_backtrans_threshold"),
    )


def final_arm(rows: DataFrame, dialect: str) -> DataFrame:
    kept = rows.filter((F.col("state") != "unreviewed") & ~F.col("excluded"))
    return kept.select("qid", "question_msa", F.col("final").alias("question_dialect"), "gold_answer", F.lit(dialect).alias("dialect"), "sub_variety", labels.provenance(F.col("state")).alias("provenance"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Means that skip nulls (4 places) and counts of unchanged and drifted rows."""
    cols = [c for c in ("backtrans_similarity", "dialect_distance", "bertscore_f1", "bartscore") if c in scored.columns]
    return scored.agg(F.count("*").alias("n"), *(F.bround(F.avg(c), 4).alias(f"mean_{c}") for c in cols), F.count_if(F.col("dialect_distance") >= 0.95).alias("n_unchanged"), F.count_if(F.col("backtrans_similarity") < 0.4).alias("n_drifted"))


def judged_summary(judged: DataFrame) -> DataFrame:
    """Means (2 places) of an LLM judge's four scores, and rows it failed on."""
    names = ("quality", "fluency", "coherence", "understandability")
    return judged.agg(*(F.bround(F.avg(n), 2).alias(f"mean_{n}") for n in names), F.count_if(F.col("quality").isNull()).alias("n_failed"))
