"""Routing of generations: mechanical faults first, then a scorer for what is deferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from .dedupe import KEY, canonical, succeeded


class Scorer(Protocol):
    """A classifier behind the engine: loaded once for each worker, called with batches."""

    threshold: float

    def load(self) -> Callable[[list[str], list[str]], list[float]]:
        """A function from contexts and answers to probabilities of hallucination."""


class OverlapScorer:
    """A deterministic stand-in where no model is installed: one minus the share of context words in the answer."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def load(self):
        def score(contexts: list[str], answers: list[str]) -> list[float]:
            out = []
            for c, a in zip(contexts, answers):
                want, have = set(c.split()), set(a.split())
                out.append(1.0 - len(want & have) / len(want) if want else 0.5)
            return out

        return score


def layer1(log: DataFrame, seq: str) -> DataFrame:
    """Canonical generations with coverage, mechanical decision and reasons."""
    rows = canonical(log, succeeded(F.col("answer"), F.col("error")), seq)
    s = text.score_answer(text.text_or_empty("answer"), text.text_or_empty("gold_answer"), text.text_or_empty("error"))
    return rows.withColumn("__s", s).select(*rows.columns, F.col("__s.coverage").alias("layer1_coverage"), F.col("__s.decision").alias("layer1_decision"), F.array_join("__s.reasons", "|").alias("degeneration_reasons"))


def score_deferred(rows: DataFrame, scorer: Scorer, variant: str = "question_gold_answer", batch: int = 32) -> DataFrame:
    """(key, probability) of deferred rows only: the filter comes before the model, as a conditional column would run it on all rows."""
    deferred = rows.filter(F.col("layer1_decision") == "defer")
    pair = labels.judge_input(variant, F.col("question"), F.col("gold_answer"), F.col("answer"))

    def run(batches: Iterator):
        score = scorer.load()
        for pdf in batches:
            p: list[float] = []
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                p += score(part["context"].tolist(), part["reply"].tolist())
            yield pdf[list(KEY)].assign(probability=p)

    sent = deferred.withColumn("__x", pair).select(*KEY, F.col("__x.context").alias("context"), F.col("__x.answer").alias("reply"))
    return sent.mapInPandas(run, ", ".join(f"{k} string" for k in KEY) + ", probability double")


def layer2(rows: DataFrame, scorer: Scorer, variant: str = "question_gold_answer", override: float | None = None, acknowledged: bool = False) -> DataFrame:
    """Layer-1 rows with probability, threshold, decision, label and headline failure."""
    t = labels.resolve_threshold(scorer.threshold, override, acknowledged)
    j = rows.join(score_deferred(rows, scorer, variant), list(KEY), "left").withColumn("__d", labels.final_decision(F.col("layer1_decision"), F.col("probability"), t))
    return j.select(*rows.columns, F.col("probability").alias("layer2_hallucination_probability"), F.when(F.col("probability").isNotNull(), t).alias("layer2_decision_threshold"), F.col("__d.decision").alias("combined_decision"), F.col("__d.label").alias("combined_label"), F.col("__d.failure").alias("headline_failure_label"))


def rollup(rows: DataFrame, decision: str = "combined_decision", variety: str = "variety") -> DataFrame:
    """Counts by decision, by variety, by both, and in all: one expansion, one aggregation."""
    return rows.groupingSets([[decision, variety], [decision], [variety], []], decision, variety).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def check_scored(log: DataFrame, scored: DataFrame) -> DataFrame:
    """Integrity of a scored run, a row a check: canonical keys = scored rows; deferred rows = probabilities; blank answers and errors."""
    keys = log.select(*KEY).distinct().agg(F.count("*").alias("expected"))
    s = scored.agg(F.count("*").alias("rows"), F.count_if(F.col("layer1_decision") == "defer").alias("deferred"), F.count("layer2_hallucination_probability").alias("scored"))
    j = keys.crossJoin(s)  # two single rows
    return j.select(F.explode(F.array(F.struct(F.lit("rows_match_keys").alias("check"), (F.col("rows") == F.col("expected")).alias("ok")), F.struct(F.lit("deferred_match_scores").alias("check"), (F.col("deferred") == F.col("scored")).alias("ok")))).alias("c")).select("c.*")


def check_complete(log: DataFrame, per_variety: int) -> DataFrame:
    """For each variety: whether it has exactly ``per_variety`` rows and none is blank or failed."""
    ok = succeeded(F.col("answer"), F.col("error"))
    return log.groupBy("variety").agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_failed")).withColumn("ok", (F.col("n") == per_variety) & (F.col("n_failed") == 0))
