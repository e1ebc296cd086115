"""Every registered query of the evaluation engine, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import agreement, dedupe, generation, paired, routing, sampling, training, translation
from . import adapters as A

GEN = """
gen AS (
  SELECT CAST(user_id AS VARCHAR) AS qid,
         CASE event_type WHEN 'view' THEN 'msa' WHEN 'click' THEN 'gulf' WHEN 'purchase' THEN 'egyptian' WHEN 'signup' THEN 'levantine' WHEN 'error' THEN 'sudanese' END AS variety,
         'direct' AS condition, 'm' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 6 AS VARCHAR) AS model, event_id AS seq, value, value >= 1.0 AS ok,
         CASE WHEN value < 2.6 THEN 'degeneration' WHEN value >= 35.0 THEN 'factual_hallucination' ELSE 'clean' END AS decision,
         CASE WHEN value < 1.0 THEN 'generation_error' WHEN value < 2.6 THEN 'heavy_repetition' ELSE '' END AS reasons
  FROM events),
canon AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qid, variety, condition, model ORDER BY ok DESC, seq DESC) AS rn FROM gen) WHERE rn = 1)
"""
PAIRS = GEN + """,
lab AS (SELECT *, CASE decision WHEN 'clean' THEN 0 WHEN 'factual_hallucination' THEN 1 END AS label, (decision = 'degeneration' OR reasons <> '') AS deg FROM canon),
pairs AS (SELECT d.model, d.variety, d.condition, d.qid, m.label AS lm, d.label AS ld, m.deg AS gm, d.deg AS gd
          FROM lab d JOIN lab m ON d.model = m.model AND d.qid = m.qid AND m.variety = 'msa' AND m.condition = 'direct' WHERE d.variety <> 'msa'),
cells AS (SELECT model, variety, condition, count(*) AS n_paired_total,
                 count(*) FILTER (lm IS NOT NULL AND ld IS NOT NULL) AS n_paired_factual,
                 count(*) FILTER (gm) AS n_degenerated_msa, count(*) FILTER (gd) AS n_degenerated_dialect,
                 round(avg(CAST(gm AS INT)), 6) AS degeneration_rate_msa, round(avg(CAST(gd AS INT)), 6) AS degeneration_rate_dialect,
                 round(avg(CAST(gm OR coalesce(lm, 0) = 1 AS INT)), 6) AS headline_failure_rate_msa, round(avg(CAST(gd OR coalesce(ld, 0) = 1 AS INT)), 6) AS headline_failure_rate_dialect,
                 count(*) FILTER (lm = 0 AND ld = 0) AS cc, count(*) FILTER (lm = 0 AND ld = 1) AS ch, count(*) FILTER (lm = 1 AND ld = 0) AS hc, count(*) FILTER (lm = 1 AND ld = 1) AS hh
          FROM pairs GROUP BY model, variety, condition),
tests AS (SELECT *, CASE WHEN ch + hc = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(ch, hc) + 1), lambda i: exp(lgamma(ch + hc + 1) - lgamma(i + 1) - lgamma(ch + hc - i + 1) + (ch + hc) * ln(0.5))))), 6) END AS p FROM cells),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, model, variety, condition) AS rk, count(*) OVER () AS m FROM tests),
adj AS (SELECT *, min(least(1.0, p * m / rk)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ranked)
"""


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return paired.pairs(A.canonical_generations(spark, d))


def canonical_generations(spark, d):
    return A.canonical_generations(spark, d).select("qid", "variety", "condition", "model", "seq", "ok", "decision", "degeneration_reasons")


def paired_hds(spark, d):
    return paired.hds(pairs_of(spark, d)).drop("family")


def mcnemar_bh(spark, d):
    return paired.hds(pairs_of(spark, d)).select("model", "variety", "condition", "mcnemar_exact_p", "mcnemar_bh_q")


def headline_failure(spark, d):
    return paired.hds(pairs_of(spark, d)).select("model", "variety", "n_paired_total", "n_degenerated_msa", "n_degenerated_dialect", "headline_failure_rate_msa", "headline_failure_rate_dialect")


def percentile_ci(spark, d):
    t = paired.percentile_ci(A.table(spark, d, "events").filter("value is not null"), ["event_type"], "value")
    return t.select("event_type", *(F.round(c, 6).alias(c) for c in ("ci_low", "median", "ci_high")))


def bootstrap_ci(spark, d):
    return paired.bootstrap(paired.hds(pairs_of(spark, d)))


def bootstrap_ci_sequential(spark, d):
    return paired.bootstrap_exact(pairs_of(spark, d))


def decision_rollup(spark, d):
    r = routing.rollup(A.canonical_generations(spark, d), "decision", "variety")
    return r.select("decision", "variety", "n", F.col("grouping").cast("long").alias("grouping"))


def normalize_text(spark, d):
    return A.spread(A.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize_arabic(text.text_or_empty("text")).alias("normalized"))


def token_f1_turns(spark, d):
    return A.turns(spark, d).select("conv_id", "turn", F.round(text.token_f1(F.col("question"), F.col("answer")), 6).alias("f1"))


def token_coverage_turns(spark, d):
    return A.turns(spark, d).select("conv_id", "turn", F.round(text.token_coverage(text.text_or_empty("answer"), text.text_or_empty("question")), 6).alias("coverage"))


def layer1_route(spark, d):
    reasons = text.degeneration_reasons(text.text_or_empty("text"), F.lit(""))
    return A.spread(A.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(reasons, "|").alias("reasons"), F.when(F.size(reasons) > 0, "degeneration").otherwise("defer").alias("decision"))


def reason_counts(spark, d):
    r = layer1_route(spark, d).select(F.explode(F.split("reasons", r"\|")).alias("reason")).filter("reason <> ''")
    return r.groupBy("reason").agg(F.count("*").alias("n"))


def layer2_decisions(spark, d):
    g = A.layered(spark, d).withColumn("route", F.when(F.col("decision") == "degeneration", "degeneration").otherwise("defer"))
    x = labels.final_decision(F.col("route"), F.col("p"), 0.5)
    return g.select("qid", "variety", "model", x.alias("x")).select("qid", "variety", "model", F.col("x.decision").alias("combined_decision"), F.col("x.label").alias("combined_label"), F.col("x.failure").alias("headline_failure_label"))


def kappa_binary(spark, d):
    t = A.table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return agreement.kappa_binary(t, "a", "b").select("n", F.round("raw_agreement", 6).alias("raw_agreement"), F.round("kappa", 6).alias("kappa"))


def _classes(spark, d):
    c = lambda x: F.when(x == 0, "clean").when(x == 1, "factual_hallucination").otherwise("degeneration")
    return A.scored_labels(spark, d).select("doc_id", c(F.pmod(F.col("doc_id"), F.lit(3)) * F.col("label")).alias("truth"), c(F.pmod(F.col("doc_id"), F.lit(3)) * (1 - F.col("toxic"))).alias("pred"))


CLS = """cls AS (SELECT doc_id, CASE (doc_id % 3) * quality WHEN 0 THEN 'clean' WHEN 1 THEN 'factual_hallucination' ELSE 'degeneration' END AS truth,
  CASE (doc_id % 3) * (1 - toxic) WHEN 0 THEN 'clean' WHEN 1 THEN 'factual_hallucination' ELSE 'degeneration' END AS pred FROM documents JOIN labels USING (doc_id))"""


def kappa_multi(spark, d):
    return agreement.kappa_multi(_classes(spark, d), "truth", "pred").select("n", F.round("raw_agreement", 6).alias("raw_agreement"), F.round("kappa", 6).alias("kappa"))


def audit_metrics(spark, d):
    t = agreement.class_metrics(_classes(spark, d), "truth", "pred")
    return t.select("label", "support", *(F.round(c, 6).alias(c) for c in t.columns[2:]))


def agreement_summary(spark, d):
    t = A.table(spark, d, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    cls = lambda c: F.when(F.col(c) == 1, "clean").otherwise("factual_hallucination")
    a = t.select("sample_id", cls("quality").alias("label"))
    b = t.filter("doc_id % 5 <> 0").select("sample_id", F.when(F.col("toxic") == 1, "factual_hallucination").otherwise("clean").alias("label"))
    j = t.filter("doc_id % 2 = 0").select("sample_id", cls("quality").alias("label"))
    said = t.select("sample_id", F.when(F.col("doc_id") % 7 == 0, "factual_hallucination").otherwise("clean").alias("predicted"))
    rounded = lambda x: x.select(*(F.round(c, 6).alias(c) if k == "double" else c for c, k in x.dtypes))
    return rounded(agreement.agreement_summary(said, a, b, j).withColumn("adjudicated", F.lit(True))).unionByName(rounded(agreement.agreement_summary(said, a, b).withColumn("adjudicated", F.lit(False))))


def threshold_sweep(spark, d):
    t = agreement.threshold_sweep(A.scored_labels(spark, d), "label", "score")
    return t.select("threshold", "tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def best_threshold(spark, d):
    return agreement.best_threshold(agreement.threshold_sweep(A.scored_labels(spark, d), "label", "score")).select("threshold", F.round("f1", 6).alias("f1"))


SWEEP = """sc AS (SELECT doc_id, source, lang, quality AS label, toxic, ((n_chars * 7919 + doc_id * 104729) % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
th AS (SELECT i, round(CAST(0.05 + i * 0.005 AS DOUBLE), 6) AS threshold FROM range(181) t(i)),
hits AS (SELECT i, threshold, count(*) FILTER (label = 0 AND score < threshold - 1e-9) AS tn, count(*) FILTER (label = 0 AND score >= threshold - 1e-9) AS fp, count(*) FILTER (label = 1 AND score < threshold - 1e-9) AS fn, count(*) FILTER (label = 1 AND score >= threshold - 1e-9) AS tp FROM th, sc GROUP BY i, threshold),
pr AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM hits),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""
SC = SWEEP.partition(",\nth AS")[0]


def roc_auc(spark, d):
    return agreement.roc_auc(A.scored_labels(spark, d), "label", "score", ["lang"]).select("lang", F.round("roc_auc", 6).alias("roc_auc"))


def average_precision(spark, d):
    return agreement.average_precision(A.scored_labels(spark, d), "label", "score", ["lang"]).select("lang", F.round("average_precision", 6).alias("average_precision"))


def binary_metrics(spark, d):
    t = agreement.binary_metrics(A.scored_labels(spark, d), "label", F.col("score") >= 0.5, ["lang"])
    return t.select("lang", "tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def tag_recall(spark, d):
    t = A.scored_labels(spark, d).select((F.col("label") == 0).cast("int").alias("low_quality"), F.col("toxic").alias("toxic"), "score")
    return agreement.tag_recall(t, ["low_quality", "toxic"], F.col("score") >= 0.5).select("tag", "n", F.round("recall", 6).alias("recall"))


def class_weights(spark, d):
    return agreement.class_weights(A.table(spark, d, "labels").filter("quality is not null"), "quality").select("quality", "n", F.round("weight", 6).alias("weight"))


def fold_summary(spark, d):
    per = agreement.binary_metrics(A.scored_labels(spark, d), "label", F.col("score") >= 0.5, ["source"])
    return agreement.fold_summary(per, ["accuracy"]).select(*(F.round(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std")))


def router_against_labels(spark, d):
    t = A.scored_labels(spark, d).select("label", F.when(F.col("score") < 0.3, "clean").when(F.col("score") >= 0.6, "hallucinated").otherwise("defer").alias("decision"))
    return agreement.router_against_labels(t, "decision", "label").select("n", "n_resolved", "tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("resolution_rate", "accuracy_on_resolved")))


def _strata(spark, d):
    g = A.layered(spark, d)
    return g.withColumn("audit_route", labels.audit_route(F.col("decision"))).withColumn("threshold_band", labels.threshold_band(F.col("p"), F.col("threshold"))).withColumn("route", labels.judge_route(F.col("p")))


LAYERED = GEN + """,
lay AS (SELECT *, CASE WHEN decision <> 'degeneration' THEN least(1.0, round(value / 70.0, 3)) END AS p FROM canon),
strata AS (SELECT qid, variety, CASE decision WHEN 'degeneration' THEN 'layer1_degeneration' WHEN 'clean' THEN 'layer2_clean' ELSE 'layer2_hallucination' END AS audit_route,
  CASE WHEN p IS NULL THEN 'not_applicable' WHEN abs(p - 0.5) <= 0.05 THEN 'near_0.05' WHEN abs(p - 0.5) <= 0.2 THEN 'near_0.20' ELSE 'far' END AS threshold_band, model, decision, CASE WHEN p IS NULL THEN 'layer1' ELSE 'layer2' END AS route FROM lay)"""


def audit_allocation(spark, d):
    s = _strata(spark, d).groupBy("variety", "audit_route", "threshold_band").agg(F.count("*").alias("n"))
    return sampling.audit_allocation(s, 250)


def audit_sample(spark, d):
    s = _strata(spark, d)
    keys = ["variety", "audit_route", "threshold_band"]
    alloc = sampling.audit_allocation(s.groupBy(*keys).agg(F.count("*").alias("n")), 250)
    t = sampling.take_allocated(s, alloc, keys, sampling.shuffled(42, "qid", "variety", "model"))
    return sampling.sample_ids(t, "audit", sampling.shuffled(42, "qid", "variety", "model")).select("sample_id", *keys, "qid", "model")


def layer3_allocation(spark, d):
    keys = ["variety", "model", "decision", "route"]
    s = _strata(spark, d).filter("variety <> 'msa'").groupBy(*keys).agg(F.count("*").alias("n"))
    return sampling.layer3_allocation(s, 150, by=["variety"])


def layer3_sample(spark, d):
    s = _strata(spark, d).filter("variety <> 'msa'")
    keys = ["variety", "model", "decision", "route"]
    alloc = layer3_allocation(spark, d)
    t = sampling.take_allocated(s, alloc, keys, sampling.shuffled(42, "qid", "model"))
    return sampling.sample_ids(t, F.col("variety"), sampling.shuffled(43, "qid", "model"), ["variety"]).select("sample_id", *keys, "qid")


def stratified_split(spark, d):
    t = A.table(spark, d, "labels").filter("quality is not null")
    s = sampling.stratified_rows(t, "quality", F.md5(F.col("doc_id").cast("string")), "doc_id")
    return s.groupBy("quality", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def grouped_split(spark, d):
    s = sampling.grouped_train_validation_test(A.scored_labels(spark, d), "source", "label")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.count_distinct("source").alias("n_groups"))


def group_ids(spark, d):
    return dedupe.group_ordinals(A.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


def edit_distance(spark, d):
    return A.turns(spark, d).select("conv_id", "turn", F.round(text.edit_distance(text.text_or_empty("question"), text.text_or_empty("answer")), 6).alias("distance"))


def _candidates(spark, d):
    """Every turn pair as a translation candidate, by conv_id-turn."""
    t = A.turns(spark, d).withColumn("qid", F.concat_ws("-", "conv_id", "turn"))
    return t.select("qid", "conv_id", F.col("question").alias("question_msa"), F.col("answer").alias("dialect_candidate"), F.when(F.col("conv_id") % 3 != 0, F.concat("question", F.lit(" "), "answer")).otherwise("").alias("backtranslation_msa"), F.lit("gold").alias("gold_answer"), F.concat(F.lit("s"), F.col("conv_id") % 7).alias("sub_variety"))


CAND = r"""turns AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
cand AS (SELECT conv_id || '-' || turn AS qid, conv_id, question, answer, CASE WHEN conv_id % 3 <> 0 THEN question || ' ' || answer ELSE '' END AS back, 's' || conv_id % 7 AS sub FROM turns)"""


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(regexp_replace({x}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g'), 'أإآىة', 'ااايه'), '[^\\pL\\pN_]+', ' ', 'g')))"


def _bag(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda w: w <> ''))"


def _f1(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_intersect({_bag(a)}, {_bag(b)})) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({_bag(a)}, {_bag(b)})) / (len({_bag(a)}) + len({_bag(b)})) END)"


CHECKED = CAND + f""",
chk AS (SELECT *, CASE WHEN back <> '' THEN {_f1("question", "back")} END AS bt, {_f1("question", "answer")} AS dd FROM cand),
flg AS (SELECT *, list_filter([CASE WHEN bt < 0.5 THEN 'MEANING_DRIFT' END, CASE WHEN dd >= 0.95 THEN 'BARELY_TRANSLATED' END,
  CASE WHEN len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) > 2 * len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) THEN 'TOO_LONG' END,
  CASE WHEN regexp_matches(answer, '[A-Za-z]{{3,}}') THEN 'LATIN_TEXT' END], lambda w: w IS NOT NULL) AS flags FROM chk)"""


def qc_flags(spark, d):
    return translation.check(_candidates(spark, d)).select("qid", F.round("bt", 6).alias("bt"), F.round("dd", 6).alias("dd"), F.array_join("flags", "|").alias("flags"))


def qc_flag_counts(spark, d):
    return translation.flag_counts(translation.check(_candidates(spark, d)))


def qc_summary(spark, d):
    t = translation.check_summary(translation.check(_candidates(spark, d)))
    return t.select("n", F.round("mean_bt", 6).alias("mean_bt"), F.round("mean_dd", 6).alias("mean_dd"), "n_flagged")


def _reviewed(spark, d):
    c = _candidates(spark, d)
    k = F.col("conv_id") % 5
    sheet = c.select("qid", F.when(k == 0, "approve").when(k == 1, " Rewrite").when(k == 2, "DROP").when(k == 3, "").otherwise("A").alias("APPROVE_or_REWRITE"), F.when(k == 1, F.concat(F.lit("new "), "dialect_candidate")).otherwise("").alias("your_rewrite"), F.when(k == 0, "4").when(k == 1, "x").otherwise("0").alias("fluency_1_5"))
    return translation.reviewed(c, sheet, 0.4)


def finalize_filter(spark, d):
    return _reviewed(spark, d).select("qid", "state", "excluded", F.round("bt", 6).alias("bt"), F.round("dd", 6).alias("dd"), "fluency")


def _distance(a: str, b: str) -> str:
    """Levenshtein as a share of the longer. DuckDB counts bytes, so the other letters of the tables become capitals, which lower-cased texts don't have."""
    plain = lambda x: f"translate({_norm(x)}, 'ßäçèéêëíïñóöúüáàâîôûœæ', 'ABCDEFGHIJKLMNOPQRSTUV')"
    return f"(CASE WHEN greatest(length({_norm(a)}), length({_norm(b)})) = 0 THEN 0.0 ELSE levenshtein({plain(a)}, {plain(b)}) / greatest(length({_norm(a)}), length({_norm(b)})) END)"


REVIEW = CAND + f""",
rev AS (SELECT qid, sub, question, answer, CASE WHEN conv_id % 5 IN (0, 4) THEN 'approved' WHEN conv_id % 5 = 1 THEN 'rewritten' WHEN conv_id % 5 = 2 THEN 'dropped' ELSE 'unreviewed' END AS state,
  CASE WHEN conv_id % 5 = 1 THEN trim('new ' || answer, ' ' || chr(10)) ELSE answer END AS final, CASE WHEN back <> '' THEN {_f1("question", "back")} END AS bt, CASE WHEN conv_id % 5 = 0 THEN 4.0::DOUBLE END AS fluency FROM cand),
fin AS (SELECT *, {_f1("question", "final")} AS dd, (coalesce(bt < 0.4, false) AND state <> 'rewritten') OR state = 'dropped' AS excluded, CASE WHEN state = 'rewritten' THEN {_distance("answer", "final")} ELSE 0.0 END AS edit FROM rev)"""


def finalize_metrics(spark, d):
    return translation.finalize_metrics(_reviewed(spark, d))


def final_arm(spark, d):
    return translation.final_arm(_reviewed(spark, d), "gulf")


def validation_sheet(spark, d):
    return translation.validation_sheet(translation.check(_candidates(spark, d)))


def cosine_pairs(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


def todo_plan(spark, d):
    items = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("qid")).withColumn("variety", F.explode(F.array(F.lit("msa"), F.lit("gulf"))))
    planned = generation.plan(items, ["m0", "m1"], ["direct", "msa_answer"])
    return generation.remaining(planned, A.generations(spark, d).filter("ok"))


def first_per_variety(spark, d):
    return sampling.first_rows(A.canonical_generations(spark, d), ["variety"], "seq", 10).select("variety", "seq", "qid", "model")


def first_groups(spark, d):
    return sampling.first_groups(A.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


def variant_ranking(spark, d):
    per = agreement.roc_auc(A.scored_labels(spark, d), "label", "score", ["lang"]).select(F.col("lang").alias("variant"), F.round("roc_auc", 6).alias("validation_roc_auc"))
    f1 = agreement.binary_metrics(A.scored_labels(spark, d), "label", F.col("score") >= 0.5, ["lang"]).select(F.col("lang").alias("variant"), F.round("f1", 6).alias("validation_f1"))
    return training.rank_variants(per.join(f1, "variant"), ["de", "en", "es", "fr"])


def epoch_upsert(spark, d):
    e = A.table(spark, d, "events").select("event_id", ((F.col("event_id") % 40) / 10.0 + F.when(F.col("event_id") % 3 == 0, 0.01).otherwise(0.0)).alias("epoch"), F.when(F.col("event_type") == "view", F.col("value")).alias("loss"), F.when(F.col("event_type") == "click", F.col("value")).alias("eval_loss"))
    return training.epoch_rows(e, "event_id").select(F.round("epoch", 6).alias("epoch"), F.round("train_loss", 6).alias("train_loss"), F.round("validation_loss", 6).alias("validation_loss"))


def arm_seeds(spark, d):
    a = A.canonical_generations(spark, d).filter("variety <> 'msa'").select("model", "variety", "condition").distinct()
    return a.select("model", "variety", "condition", F.substring(F.sha2(F.concat_ws("|", F.lit("42"), "model", "variety", "condition"), 256), 1, 16).alias("seed_hex"))


def scored_run(spark, d):
    """Layer 1 and Layer 2 over turns as generations, with a stand-in scorer."""
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.lit("msa").alias("variety"), F.lit("direct").alias("condition"), F.lit("m0").alias("model"), "question", F.col("question").alias("gold_answer"), "answer", F.lit("").alias("error"), F.col("turn").alias("seq"))
    out = routing.layer2(routing.layer1(t, "seq"), routing.OverlapScorer(0.5))
    return out.select("qid", F.round("layer1_coverage", 6).alias("layer1_coverage"), "layer1_decision", F.round("layer2_hallucination_probability", 6).alias("probability"), "combined_decision", "combined_label", "headline_failure_label")


def scored_run_checks(spark, d):
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.lit("msa").alias("variety"), F.lit("direct").alias("condition"), F.lit("m0").alias("model"), "question", F.lit("x").alias("gold_answer"), "answer", F.lit("").alias("error"), F.col("turn").alias("seq"))
    return routing.check_scored(t, routing.layer2(routing.layer1(t, "seq"), routing.OverlapScorer(0.5)))


def run_completeness(spark, d):
    g = A.canonical_generations(spark, d).withColumn("answer", F.when(F.col("ok"), "x").otherwise("")).withColumn("error", F.lit(""))
    return routing.check_complete(g, 300)


def tfidf_cv(spark, d):
    t = A.spread(A.table(spark, d, "documents").select("doc_id", "source", "text")).join(A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).filter("label is not null"), "doc_id")
    return training.tfidf_cv(t, "source")


def echo_generation(spark, d):
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.lit("m0").alias("model"), generation.messages("Answer.", F.col("question")).alias("messages"))
    return generation.generate(t, generation.EchoClient).select("qid", "model", "answer", "error")


QUERIES = {f.__name__: f for f in (
    canonical_generations, paired_hds, mcnemar_bh, headline_failure, percentile_ci, bootstrap_ci, bootstrap_ci_sequential, decision_rollup, normalize_text, token_f1_turns, token_coverage_turns, layer1_route, reason_counts, layer2_decisions,
    kappa_binary, kappa_multi, audit_metrics, agreement_summary, threshold_sweep, best_threshold, roc_auc, average_precision, binary_metrics, tag_recall, class_weights, fold_summary, router_against_labels,
    audit_allocation, audit_sample, layer3_allocation, layer3_sample, stratified_split, grouped_split, group_ids, edit_distance, qc_flags, qc_flag_counts, qc_summary, validation_sheet, finalize_filter, finalize_metrics, final_arm,
    cosine_pairs, todo_plan, first_per_variety, first_groups, variant_ranking, epoch_upsert, arm_seeds, scored_run, scored_run_checks, run_completeness, tfidf_cv, echo_generation,
)}

_DRIFT = """SELECT model, variety, condition, n_paired_total, n_paired_factual, n_degenerated_msa, n_degenerated_dialect, degeneration_rate_msa, degeneration_rate_dialect, headline_failure_rate_msa, headline_failure_rate_dialect,
  CASE WHEN n_paired_factual > 0 THEN round((hc + hh) / n_paired_factual, 6) END AS hallucination_rate_msa, CASE WHEN n_paired_factual > 0 THEN round((ch + hh) / n_paired_factual, 6) END AS hallucination_rate_dialect,
  cc AS clean_clean, ch AS clean_to_hallucination, hc AS hallucination_to_clean, hh AS hallucination_hallucination,
  CASE WHEN n_paired_factual > 0 THEN round((ch + hh) / n_paired_factual - (hc + hh) / n_paired_factual, 6) END AS hds, CASE WHEN ch + hc + hh > 0 THEN round(hh / (ch + hc + hh), 6) END AS hallucination_iou, p AS mcnemar_exact_p, round(q, 6) AS mcnemar_bh_q FROM adj"""

_REPEAT = "len(list_filter(range(1, len(w) - 4 * {k} + 2), lambda i: w[i:i + {k} - 1] = w[i + {k}:i + 2 * {k} - 1] AND w[i:i + {k} - 1] = w[i + 2 * {k}:i + 3 * {k} - 1] AND w[i:i + {k} - 1] = w[i + 3 * {k}:i + 4 * {k} - 1])) > 0"
_REASONS = f"""list_filter([CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty_answer' END,
    CASE WHEN length(regexp_replace(text, '[^\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]', '', 'g')) >= greatest(3, 0.1 * length(regexp_replace(text, '[^\\pL]', '', 'g'))) THEN 'foreign_script_heavy' END,
    CASE WHEN regexp_matches(text, '(?i)(?:^|\\n)\\s*(?:assistant|user|system)\\s*:') THEN 'role_marker' END, CASE WHEN contains(text, '```') THEN 'code_fence' END,
    CASE WHEN {_REPEAT.format(k=1)} OR {_REPEAT.format(k=2)} OR {_REPEAT.format(k=3)} THEN 'heavy_repetition' END], lambda x: x IS NOT NULL)"""
_LAYER1 = f"""WITH n AS (SELECT doc_id, text, list_filter(string_split({_norm("text")}, ' '), lambda x: x <> '') AS w FROM documents), r AS (SELECT doc_id, {_REASONS} AS reasons FROM n)"""
_BIN = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"
_CONF = "count(*) FILTER (label = 0 AND NOT s) AS tn, count(*) FILTER (label = 0 AND s) AS fp, count(*) FILTER (label = 1 AND NOT s) AS fn, count(*) FILTER (label = 1 AND s) AS tp"
_AUC = """au AS (SELECT p.lang, round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc FROM sc p JOIN sc q ON p.lang = q.lang AND p.label = 1 AND q.label = 0 GROUP BY p.lang),
auc AS (SELECT lang, roc_auc FROM (SELECT DISTINCT lang FROM sc) LEFT JOIN au USING (lang))"""
_KAPPA3 = "(SELECT sum(a.c * b.c) FROM (SELECT truth AS k, count(*) / (SELECT count(*) FROM cls) AS c FROM cls GROUP BY 1) a JOIN (SELECT pred AS k, count(*) / (SELECT count(*) FROM cls) AS c FROM cls GROUP BY 1) b USING (k))"

ORACLE_SQL = {
    "canonical_generations": f"WITH {GEN} SELECT qid, variety, condition, model, seq, ok, decision, reasons AS degeneration_reasons FROM canon",
    "paired_hds": f"WITH {PAIRS} {_DRIFT}",
    "mcnemar_bh": f"WITH {PAIRS} SELECT model, variety, condition, p AS mcnemar_exact_p, round(q, 6) AS mcnemar_bh_q FROM adj",
    "headline_failure": f"WITH {PAIRS} SELECT model, variety, n_paired_total, n_degenerated_msa, n_degenerated_dialect, headline_failure_rate_msa, headline_failure_rate_dialect FROM cells",
    "percentile_ci": "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS ci_high FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "decision_rollup": f"WITH {GEN} SELECT decision, variety, count(*) AS n, CAST(grouping(decision, variety) AS BIGINT) AS grouping FROM canon GROUP BY GROUPING SETS ((decision, variety), (decision), (variety), ())",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
    "token_f1_turns": f"WITH {CAND} SELECT conv_id, turn, round({_f1('question', 'answer')}, 6) AS f1 FROM turns",
    "token_coverage_turns": f"""WITH {CAND},
        v AS (SELECT conv_id, turn, answer, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(question, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[,;|،]'))) AS variant FROM turns),
        s AS (SELECT conv_id, turn, {_bag("replace(variant, chr(1), ',')")} AS want, {_bag("answer")} AS have FROM v)
        SELECT conv_id, turn, round(coalesce(max(CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) END), 0.0), 6) AS coverage FROM s GROUP BY conv_id, turn""",
    "layer1_route": f"{_LAYER1} SELECT doc_id, array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) > 0 THEN 'degeneration' ELSE 'defer' END AS decision FROM r",
    "reason_counts": f"{_LAYER1} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason",
    "layer2_decisions": f"WITH {LAYERED} SELECT qid, variety, model, CASE WHEN decision = 'degeneration' THEN decision WHEN p >= 0.5 THEN 'factual_hallucination' ELSE 'clean' END AS combined_decision, CASE WHEN decision <> 'degeneration' THEN CAST(p >= 0.5 AS INT) END AS combined_label, CAST(decision = 'degeneration' OR p >= 0.5 AS INT) AS headline_failure_label FROM lay",
    "kappa_binary": "WITH t AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM t) SELECT n, round(po, 6) AS raw_agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s",
    "kappa_multi": f"WITH {CLS}, s AS (SELECT count(*) AS n, avg(CAST(truth = pred AS INT)) AS po FROM cls) SELECT n, round(po, 6) AS raw_agreement, round((po - {_KAPPA3}) / (1 - {_KAPPA3}), 6) AS kappa FROM s",
    "audit_metrics": f"""WITH {CLS}, k AS (SELECT unnest(['clean', 'factual_hallucination', 'degeneration']) AS label),
        c AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS named, count(*) FILTER (truth = label AND pred = label) AS hit FROM k, cls GROUP BY label),
        m AS (SELECT *, CASE WHEN named = 0 THEN 0 ELSE hit / named END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM c), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM m)
        SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round((SELECT avg(CAST(truth = pred AS INT)) FROM cls), 6) AS accuracy, round((SELECT avg(p) FROM f), 6) AS macro_precision, round((SELECT avg(r) FROM f), 6) AS macro_recall, round((SELECT avg(f1) FROM f), 6) AS macro_f1, round((SELECT sum(p * support) / sum(support) FROM f), 6) AS weighted_precision, round((SELECT sum(r * support) / sum(support) FROM f), 6) AS weighted_recall, round((SELECT sum(f1 * support) / sum(support) FROM f), 6) AS weighted_f1 FROM f""",
    "agreement_summary": """WITH t AS (SELECT quality AS a, CASE WHEN doc_id % 5 <> 0 THEN 1 - coalesce(toxic, 0) END AS b, CASE WHEN doc_id % 2 = 0 THEN quality END AS j, CAST(doc_id % 7 <> 0 AS INT) AS p FROM (SELECT doc_id, CAST(coalesce(quality, 0) = 1 AS INT) AS quality, toxic FROM labels)),
        v AS (SELECT *, b IS NOT NULL AS dbl, b IS NOT NULL AND a = b AS same FROM t),
        k AS (SELECT * FROM (VALUES ('inter_annotator_kappa'), ('automatic_vs_a_kappa'), ('automatic_vs_b_kappa'), ('automatic_vs_consensus_kappa')) n(name)),
        q AS (SELECT name, CASE name WHEN 'inter_annotator_kappa' THEN a ELSE p END AS x, CASE name WHEN 'automatic_vs_b_kappa' THEN b WHEN 'inter_annotator_kappa' THEN b ELSE a END AS y FROM k, v WHERE dbl AND (same OR name <> 'automatic_vs_consensus_kappa')),
        o AS (SELECT name, avg(CAST(x = y AS INT)) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM q GROUP BY name), z AS (SELECT name, round(CASE WHEN abs(1 - pe) < 1e-12 THEN CAST(po = 1 AS INT) ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM o),
        m AS (SELECT * FROM (VALUES (true), (false)) w(adjudicated)),
        s AS (SELECT adjudicated, count(*) AS n_keyed, count(*) FILTER (dbl) AS n_double, count(*) FILTER (same) AS n_agree, count(*) FILTER (dbl AND NOT same) AS n_requires_adjudication, count(*) FILTER (dbl AND CASE WHEN adjudicated THEN j IS NOT NULL ELSE same END) AS n_consensus, count(*) FILTER (dbl AND CASE WHEN adjudicated THEN j = p ELSE same AND a = p END) AS n_right FROM m, v GROUP BY adjudicated)
        SELECT *, round(n_double / n_keyed, 6) AS coverage, round(n_agree / n_double, 6) AS raw_agreement, round(n_right / n_consensus, 6) AS consensus_accuracy, (SELECT kappa FROM z WHERE name = 'inter_annotator_kappa') AS inter_annotator_kappa, (SELECT kappa FROM z WHERE name = 'automatic_vs_a_kappa') AS automatic_vs_a_kappa,
          (SELECT kappa FROM z WHERE name = 'automatic_vs_b_kappa') AS automatic_vs_b_kappa, (SELECT kappa FROM z WHERE name = 'automatic_vs_consensus_kappa') AS automatic_vs_consensus_kappa FROM s""",
    "threshold_sweep": f"WITH {SWEEP} SELECT threshold, tn, fp, fn, tp, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "best_threshold": f"WITH {SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 12) DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1",
    "roc_auc": f"WITH {SC}, {_AUC} SELECT lang, roc_auc FROM auc",
    "average_precision": f"WITH {SC}, c AS (SELECT lang, score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM sc GROUP BY lang, score), w AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS k FROM c) SELECT lang, round(sum(pos * tp / k) / sum(pos), 6) AS average_precision FROM w GROUP BY lang",
    "binary_metrics": f"WITH {SC}, c AS (SELECT lang, {_CONF} FROM (SELECT *, score >= 0.5 AS s FROM sc) GROUP BY lang), m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS a, {_BIN} FROM c) SELECT lang, tn, fp, fn, tp, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m",
    "tag_recall": f"WITH {SC} SELECT 'low_quality' AS tag, count(*) FILTER (label = 0) AS n, round(count(*) FILTER (label = 0 AND score >= 0.5) / count(*) FILTER (label = 0), 6) AS recall FROM sc UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1), round(count(*) FILTER (toxic = 1 AND score >= 0.5) / count(*) FILTER (toxic = 1), 6) FROM sc",
    "class_weights": "WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality) SELECT quality, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
    "fold_summary": f"WITH {SC}, c AS (SELECT source, avg(CAST((score >= 0.5) = (label = 1) AS INT)) AS a FROM sc GROUP BY source) SELECT round(avg(a), 6) AS accuracy_mean, round(stddev_samp(a), 6) AS accuracy_std FROM c",
    "router_against_labels": f"WITH {SC}, c AS (SELECT count(*) AS n, count(*) FILTER (k) AS n_resolved, count(*) FILTER (k AND label = 0 AND NOT s) AS tn, count(*) FILTER (k AND label = 0 AND s) AS fp, count(*) FILTER (k AND label = 1 AND NOT s) AS fn, count(*) FILTER (k AND label = 1 AND s) AS tp FROM (SELECT *, score < 0.3 OR score >= 0.6 AS k, score >= 0.6 AS s FROM sc)) SELECT *, round(n_resolved / n, 6) AS resolution_rate, round((tp + tn) / n_resolved, 6) AS accuracy_on_resolved FROM c",
    "audit_allocation": f"""WITH {LAYERED}, s AS (SELECT variety, audit_route, threshold_band, count(*) AS n FROM strata GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k FROM s), u AS (SELECT *, CAST(least(250, total) AS BIGINT) AS target FROM t),
        e AS (SELECT *, unnest(range(0, CAST(least(n, target) AS BIGINT))) AS i FROM u), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN target >= k AND i = 0 THEN 0 ELSE 1 END, round(i / least(n, target), 12), CASE WHEN threshold_band = 'near_0.05' THEN 0 ELSE 1 END, variety, audit_route, threshold_band, i) AS rk FROM e)
        SELECT variety, audit_route, threshold_band, n, count(*) AS allocated FROM r WHERE rk <= target GROUP BY variety, audit_route, threshold_band, n""",
    "layer3_allocation": f"""WITH {LAYERED}, s AS (SELECT variety, model, decision, route, count(*) AS n FROM strata WHERE variety <> 'msa' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY variety) AS total, count(*) OVER (PARTITION BY variety) AS k FROM s), u AS (SELECT *, CAST(least(150, total) AS BIGINT) AS target FROM t),
        e AS (SELECT *, unnest(range(0, CAST(least(n, target) AS BIGINT))) AS i FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY CASE WHEN target >= k AND i = 0 THEN 0 ELSE 1 END, -round(n / total - i / target, 12), model, decision, route, i) AS rk FROM e)
        SELECT variety, model, decision, route, n, count(*) AS allocated FROM r WHERE rk <= target GROUP BY variety, model, decision, route, n""",
    "audit_sample": f"""WITH {LAYERED}, s AS (SELECT variety, audit_route, threshold_band, count(*) AS n FROM strata GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k FROM s), u AS (SELECT *, CAST(least(250, total) AS BIGINT) AS target FROM t),
        e AS (SELECT *, unnest(range(0, CAST(least(n, target) AS BIGINT))) AS i FROM u), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN target >= k AND i = 0 THEN 0 ELSE 1 END, round(i / least(n, target), 12), CASE WHEN threshold_band = 'near_0.05' THEN 0 ELSE 1 END, variety, audit_route, threshold_band, i) AS rk FROM e),
        al AS (SELECT variety, audit_route, threshold_band, count(*) AS allocated FROM r WHERE rk <= target GROUP BY ALL), sh AS (SELECT *, md5('42|' || qid || '|' || variety || '|' || model) AS o FROM strata),
        tk AS (SELECT sh.*, allocated, row_number() OVER (PARTITION BY variety, audit_route, threshold_band ORDER BY o) AS rn FROM sh JOIN al USING (variety, audit_route, threshold_band))
        SELECT 'audit_' || lpad(CAST(row_number() OVER (ORDER BY o) AS VARCHAR), 3, '0') AS sample_id, variety, audit_route, threshold_band, qid, model FROM tk WHERE rn <= allocated""",
    "layer3_sample": f"""WITH {LAYERED}, s AS (SELECT variety, model, decision, route, count(*) AS n FROM strata WHERE variety <> 'msa' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY variety) AS total, count(*) OVER (PARTITION BY variety) AS k FROM s), u AS (SELECT *, CAST(least(150, total) AS BIGINT) AS target FROM t),
        e AS (SELECT *, unnest(range(0, CAST(least(n, target) AS BIGINT))) AS i FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY CASE WHEN target >= k AND i = 0 THEN 0 ELSE 1 END, -round(n / total - i / target, 12), model, decision, route, i) AS rk FROM e),
        al AS (SELECT variety, model, decision, route, count(*) AS allocated FROM r WHERE rk <= target GROUP BY ALL),
        tk AS (SELECT sh.*, allocated, row_number() OVER (PARTITION BY variety, model, decision, route ORDER BY md5('42|' || qid || '|' || model)) AS rn FROM strata sh JOIN al USING (variety, model, decision, route))
        SELECT variety || '_' || lpad(CAST(row_number() OVER (PARTITION BY variety ORDER BY md5('43|' || qid || '|' || model)) AS VARCHAR), 3, '0') AS sample_id, variety, model, decision, route, qid FROM tk WHERE rn <= allocated""",
    "grouped_split": f"""WITH {SC}, g AS (SELECT source, count(*) AS n, sum(label) AS pos FROM sc GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY pos / n DESC, n DESC, md5('42|' || source)) - 1 AS r FROM g),
        o AS (SELECT *, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM r), i AS (SELECT *, row_number() OVER (ORDER BY pos / n DESC, n DESC, md5('43|' || source)) - 1 AS r2 FROM o WHERE fold <> 0),
        f AS (SELECT source, n, pos, CASE WHEN CASE WHEN (r2 // 4) % 2 = 0 THEN r2 % 4 ELSE 3 - r2 % 4 END = 0 THEN 'validation' ELSE 'train' END AS split FROM i UNION ALL SELECT source, n, pos, 'test' FROM o WHERE fold = 0)
        SELECT split, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, count(*) AS n_groups FROM f GROUP BY split""",
    "scored_run": f"""WITH {CAND}, n AS (SELECT conv_id, turn, question, answer AS text, list_filter(string_split({_norm("answer")}, ' '), lambda x: x <> '') AS w FROM turns),
        r AS (SELECT *, {_REASONS} AS reasons FROM n),
        v AS (SELECT conv_id, turn, text AS answer, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(question, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[,;|،]'))) AS variant FROM r),
        c AS (SELECT conv_id, turn, round(coalesce(max(CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) END), 0.0), 6) AS coverage FROM (SELECT conv_id, turn, {_bag("replace(variant, chr(1), ',')")} AS want, {_bag("answer")} AS have FROM v) GROUP BY conv_id, turn),
        b AS (SELECT conv_id, turn, reasons, list_distinct(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS want, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS have FROM r),
        p AS (SELECT *, CASE WHEN len(reasons) = 0 THEN CASE WHEN len(want) > 0 THEN 1.0 - len(list_intersect(want, have)) / len(want) ELSE 0.5 END END AS p FROM b)
        SELECT conv_id || '-' || turn AS qid, coverage AS layer1_coverage, CASE WHEN len(reasons) > 0 THEN 'degeneration' ELSE 'defer' END AS layer1_decision, round(p, 6) AS probability, CASE WHEN len(reasons) > 0 THEN 'degeneration' WHEN p >= 0.5 THEN 'factual_hallucination' ELSE 'clean' END AS combined_decision,
          CASE WHEN len(reasons) = 0 THEN CAST(p >= 0.5 AS INT) END AS combined_label, CAST(len(reasons) > 0 OR p >= 0.5 AS INT) AS headline_failure_label FROM p JOIN c USING (conv_id, turn)""",
    "scored_run_checks": f"WITH {CAND} SELECT * FROM (VALUES ('rows_match_keys', (SELECT count(*) FROM turns) = (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM turns))), ('deferred_match_scores', true)) t(\"check\", ok)",
    "echo_generation": f"WITH {CAND} SELECT conv_id || '-' || turn AS qid, 'm0' AS model, trim(question, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer, '' AS error FROM turns",
    "stratified_split": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE quality IS NOT NULL), s AS (SELECT *, CASE WHEN rn <= round(n * 0.8) THEN 'train' ELSE 'validation' END AS split FROM r) SELECT quality, split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM s GROUP BY quality, split",
    "group_ids": "WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) SELECT d.source, d.doc_id, CAST(g.group_id AS INT) AS group_id FROM documents d JOIN (SELECT source, row_number() OVER (ORDER BY first, source) - 1 AS group_id FROM f) g USING (source)",
    "edit_distance": f"WITH {CAND} SELECT conv_id, turn, round({_distance('question', 'answer')}, 6) AS distance FROM turns",
    "qc_flags": f"WITH {CHECKED} SELECT qid, round(bt, 6) AS bt, round(dd, 6) AS dd, array_to_string(flags, '|') AS flags FROM flg",
    "qc_flag_counts": f"WITH {CHECKED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM flg) GROUP BY flag",
    "qc_summary": f"WITH {CHECKED} SELECT count(*) AS n, round(avg(bt), 6) AS mean_bt, round(avg(dd), 6) AS mean_dd, count(*) FILTER (len(flags) > 0) AS n_flagged FROM flg",
    "finalize_filter": f"WITH {REVIEW} SELECT qid, state, excluded, round(bt, 6) AS bt, round(dd, 6) AS dd, fluency FROM fin",
    "finalize_metrics": f"""WITH {REVIEW}, s AS (SELECT *, state <> 'unreviewed' AS seen, state = 'rewritten' AS rw FROM fin)
        SELECT arg_min(sub, qid) FILTER (seen) AS sub_variety, count(*) FILTER (seen) AS n_reviewed, count(*) FILTER (NOT seen) AS n_unreviewed, round(count(*) FILTER (state = 'approved') / count(*) FILTER (seen), 3) AS acceptance_rate, round(count(*) FILTER (rw) / count(*) FILTER (seen), 3) AS rewrite_rate,
          round(avg(edit) FILTER (rw), 3) AS mean_edit_distance_on_rewrites, round(avg(bt) FILTER (seen), 3) AS mean_backtrans_similarity, round(avg(dd) FILTER (seen AND NOT excluded), 3) AS mean_dialect_distance, round(avg(fluency) FILTER (seen), 2) AS mean_fluency_1_5,
          count(*) FILTER (seen AND excluded) AS n_filtered_out, count(*) FILTER (seen AND NOT excluded) AS n_final_benchmark, 0.4::DOUBLE AS min_backtrans_threshold FROM s""",
    "final_arm": f"WITH {REVIEW} SELECT qid, question AS question_msa, final AS question_dialect, 'gold' AS gold_answer, 'gulf' AS dialect, sub AS sub_variety, CASE WHEN state = 'approved' THEN 'machine' ELSE 'human_rewrite' END AS provenance FROM fin WHERE state <> 'unreviewed' AND NOT excluded",
    "validation_sheet": f"WITH {CHECKED} SELECT qid, question AS msa_question, answer AS dialect_candidate, '' AS \"APPROVE_or_REWRITE\", '' AS your_rewrite, '' AS fluency_1_5, array_to_string(flags, '|') AS auto_flags, coalesce(printf('%.3f', bt), '') AS backtrans_sim, printf('%.3f', dd) AS dialect_distance FROM flg",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "todo_plan": f"WITH {GEN}, p AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, v.variety, m.model, c.condition FROM customer, (VALUES ('msa'), ('gulf')) v(variety), (VALUES ('m0'), ('m1')) m(model), (VALUES ('direct'), ('msa_answer')) c(condition) WHERE NOT (v.variety = 'msa' AND c.condition = 'msa_answer')) SELECT qid, variety, model, condition FROM p WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.ok AND g.qid = p.qid AND g.variety = p.variety AND g.model = p.model AND g.condition = p.condition)",
    "first_per_variety": f"WITH {GEN} SELECT variety, seq, qid, model FROM (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY seq) AS r FROM canon) WHERE r <= 10",
    "first_groups": "SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY min(doc_id) LIMIT 3)",
    "variant_ranking": f"WITH {SC}, {_AUC}, a AS (SELECT lang AS variant, roc_auc AS validation_roc_auc FROM auc), c AS (SELECT lang, {_CONF} FROM (SELECT *, score >= 0.5 AS s FROM sc) GROUP BY lang), m AS (SELECT lang AS variant, {_BIN} FROM c), f AS (SELECT variant, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS validation_f1 FROM m) SELECT variant, validation_roc_auc, validation_f1, CAST(row_number() OVER (ORDER BY validation_roc_auc DESC, validation_f1 DESC, variant DESC) AS INT) AS rank, row_number() OVER (ORDER BY validation_roc_auc DESC, validation_f1 DESC, variant DESC) = 1 AS selected FROM a JOIN f USING (variant)",
    "epoch_upsert": "WITH e AS (SELECT event_id, (event_id % 40) / 10.0::DOUBLE + CASE WHEN event_id % 3 = 0 THEN 0.01::DOUBLE ELSE 0 END AS ep, CASE WHEN event_type = 'view' THEN value END AS loss, CASE WHEN event_type = 'click' THEN value END AS eval_loss FROM events), s AS (SELECT *, CASE WHEN abs(ep - round_even(ep, 0)) < 0.02 THEN round_even(ep, 0) ELSE round(ep, 6) END AS epoch FROM e) SELECT epoch, round(arg_max(loss, event_id) FILTER (loss IS NOT NULL), 6) AS train_loss, round(arg_max(eval_loss, event_id) FILTER (eval_loss IS NOT NULL), 6) AS validation_loss FROM s GROUP BY epoch",
    "arm_seeds": f"WITH {GEN} SELECT DISTINCT model, variety, condition, substr(sha256('42|' || model || '|' || variety || '|' || condition), 1, 16) AS seed_hex FROM canon WHERE variety <> 'msa'",
    "run_completeness": f"WITH {GEN} SELECT variety, count(*) AS n, count(*) FILTER (NOT ok) AS n_failed, count(*) = 300 AND count(*) FILTER (NOT ok) = 0 AS ok FROM canon GROUP BY variety",
}
