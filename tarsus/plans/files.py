"""Registered queries that go through files: readers, sinks and whole stages, with SQL for what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import agreement, dedupe, generation, routing, training, translation
from ..sources import readers, shared, sinks
from . import adapters as A
from . import catalogue as C
from . import stages


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if k == "double" else c for c, k in df.dtypes))


# ---- readers and sinks -----------------------------------------------------------------


def csv_round_trip(spark, d):
    path = shared.folder(spark, "csv")
    sinks.csv(A.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.csv(spark, path)


def arms_of_files(spark, d):
    root = shared.folder(spark, "arms")
    c = A.table(spark, d, "conversations").select("conv_id", "text", "role")
    for role in ("user", "assistant"):
        sinks.csv(c.filter(F.col("role") == role).drop("role") if role == "user" else c.filter(F.col("role") == role), f"{root}/{role}")
    folders = sorted({p.rpartition("/")[0] for p in readers.find(spark, root, "part-*.csv")})
    t = readers.many(spark, folders, seq="_seq")
    return t.groupBy("analysis_run").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("role") == "").alias("n_without_role"))


def json_round_trip(spark, d):
    stem = f"{shared.folder(spark, 'json')}/nations"
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    sinks.json_and_csv(n, stem)
    back = readers.json(spark, f"{stem}.json", "n_nationkey long, n_name string, n_regionkey long")
    again = readers.csv(spark, f"{stem}.csv").select(F.col("n_nationkey").cast("long"), F.col("n_name").alias("name_in_csv"))
    return back.join(again, "n_nationkey")


def json_summary_of_a_run(spark, d):
    path = f"{shared.folder(spark, 'summary')}/summary.json"
    sinks.json_summary(A.canonical_generations(spark, d).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_distinct("model").alias("n_models")), path)
    return readers.json(spark, path, "n long, n_ok long, n_models long")


def _log(spark, d):
    g = A.generations(spark, d)
    return g.select("qid", "variety", "condition", "model", F.when(F.col("ok"), "said").otherwise(" ").alias("answer"), F.when(F.col("ok"), "").otherwise("failed").alias("error"), "seq")


def resume_set(spark, d):
    path, g = shared.folder(spark, "log") + "/log", _log(spark, d)
    for odd in (0, 1):
        sinks.append_log(g.filter(F.col("seq") % 2 == odd), path, g.columns)
    return generation.done_keys(spark.read.parquet(path))


def snapshot_manifest(spark, d):
    return _snapshot(spark, d)[0]


def _snapshot(spark, d):
    root = shared.folder(spark, "snapshot")
    for r in A.table(spark, d, "nation").select("n_name").collect():  # 25 rows
        sinks.text(spark, f"{root}/source/{r[0].replace(' ', '_')}.txt", f"about {r[0]}")
    readers.snapshot(spark, f"{root}/source", f"{root}/copy/source")
    return readers.json(spark, f"{root}/copy/source.manifest.json", "path string, size long, sha256 string"), root


def snapshot_problems(spark, d):
    stated, root = _snapshot(spark, d)
    sinks.text(spark, f"{root}/copy/source/NATION_3.txt", "other")
    sinks.text(spark, f"{root}/copy/source/ATLANTIS.txt", "extra")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/copy/source/NATION_4.txt")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    return readers.verify_manifest(stated, readers.manifest(spark, f"{root}/copy/source"))


def snapshot_size(spark, d):
    return readers.total_size(_snapshot(spark, d)[0])


def judge_labels(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", "text").join(A.table(spark, d, "labels"), "doc_id")
    k = F.col("doc_id") % 11
    rows = t.select(
        "doc_id", F.concat(F.lit("q"), F.col("doc_id") % 50).alias("question"), F.col("text").alias("answer"),
        F.when(k == 0, "x").when(F.coalesce("quality", F.lit(1)) == 0, " 1").otherwise("0").alias(labels.TAGS[0]), F.when(F.coalesce("toxic", F.lit(0)) == 1, "1").otherwise("").alias(labels.TAGS[1]),
    )
    return readers.judge_rows(rows, "doc_id").select("doc_id", "question", "label", "group_id")


def benchmark_arms(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.col("c_name").alias("question_msa"), F.col("c_mktsegment").alias("gold_answer"), "c_custkey")
    arm = c.filter("c_custkey % 3 = 0").withColumnRenamed("question_msa", "question_dialect")
    return readers.benchmark(c, {"gulf": arm, "egyptian": None, "sudanese": arm.filter("c_custkey % 2 = 0")}, 40, "c_custkey").drop("c_custkey")


def exemplar_pairs(spark, d):
    t = A.turns(spark, d).select(F.concat(F.lit(" "), "question").alias("msa_question"), F.when(F.col("turn") % 4 == 0, F.col("answer")).otherwise(" ").alias("dialect_question"), F.when(F.col("conv_id") > 2, F.concat(F.lit("s"), "conv_id")).otherwise(" ").alias("sub_variety"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    pairs, sub = readers.exemplars(t, "seq")
    return pairs.withColumn("sub_variety", F.lit(sub))


_SAID = ("1", " Hallucinated", "h", "0", "Clean ", "c", "2", "Degenerate", "?")


def annotations(spark, d):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 9 + 1).cast("int"))
    rows = A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), said.alias("human_label"), "event_id")
    two = readers.annotation(rows, labels.binary_annotation, seq="event_id").withColumnRenamed("label", "binary_label")
    return two.join(readers.annotation(rows, labels.class_annotation, seq="event_id").withColumnRenamed("label", "class_label"), "sample_id")


def prediction_sheet(spark, d):
    s = A.scored_labels(spark, d).select(F.col("doc_id").alias("row_index"), F.col("source").alias("sample_index"), F.lit("q").alias("question"), F.lit("g").alias("gold_answer"), F.col("lang").alias("answer"), "label", F.col("score").alias("probability"))
    path = shared.folder(spark, "predictions")
    sinks.csv(training.predictions(s, 0.5), path)
    return readers.csv(spark, path).select("row_index", "sample_index", "answer", "gold_label", F.col("hallucination_probability").cast("double"), "predicted_label")


# ---- expressions -----------------------------------------------------------------------


def judge_inputs(spark, d):
    t = A.turns(spark, d)
    out = None
    for v in training.VARIANTS:
        x = labels.judge_input(v, F.col("question"), F.col("answer"), F.concat(F.lit("a"), "conv_id"))
        one = t.select("conv_id", "turn", F.lit(v).alias("variant"), x["context"].alias("context"), x["answer"].alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out


def positive_probability(spark, d):
    v = F.col("value") / 10
    return A.table(spark, d, "events").filter("value is not null").select("event_id", F.round(labels.positive_probability(v, 3 - v), 6).alias("p"))


def char_similarity(spark, d):
    n = A.table(spark, d, "nation").select("n_regionkey", "n_name")
    pairs = n.alias("a").join(n.alias("b"), "n_regionkey").filter("a.n_name < b.n_name")
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.round(text.sequence_ratio(F.col("a.n_name"), F.col("b.n_name")), 6).alias("similarity"))


def provisional_arm(spark, d):
    return generation.promote(C._candidates(spark, d), "gulf")


class _Grudging:
    """A client that answers with the budget it was given: model m0 at once, m1 only with 4096, m2 never, and m3 fails."""

    def __call__(self, model: str, turns: list[dict], tokens: int) -> str:
        if model == "m3":
            raise RuntimeError("no such model")
        return str(tokens) if model == "m0" or model == "m1" and tokens >= 4096 else " "


def answer_budgets(spark, d):
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(F.lit("m"), F.col("conv_id") % 4).alias("model"), generation.messages("", F.col("question")).alias("messages"))
    out = generation.generate(t, _Grudging, wait=0.0)
    return out.select("qid", "model", "answer", "error", "resolved_model_id", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("has_time"))


def distinct_arms(spark, d):
    return A.canonical_generations(spark, d).agg(*(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in ("variety", "condition", "model")))


# ---- stages ----------------------------------------------------------------------------


def _turn_log(spark, d):
    """Turns as a generation log: conversations divisible by 4 fail first and, if divisible by 8, answer later."""
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.lit("msa").alias("variety"), F.lit("direct").alias("condition"), F.lit("m0").alias("model"), F.lit("f").alias("family"), "question", F.col("question").alias("gold_answer"), "answer", F.lit("").alias("error"), "conv_id")
    failed = t.filter("conv_id % 4 = 0").withColumns({"answer": F.lit(""), "error": F.lit("timeout")})
    return failed.drop("conv_id"), t.filter("conv_id % 4 <> 0 or conv_id % 8 = 0").drop("conv_id")


def _write_log(spark, d, path):
    first, later = _turn_log(spark, d)
    sinks.csv(first, f"{path}/a")
    sinks.csv(later, f"{path}/b")
    return [f"{path}/a", f"{path}/b"]


_ATTEMPTS = C.CAND + """,
att AS (SELECT qid, conv_id, turn, question, CASE WHEN conv_id % 4 = 0 AND conv_id % 8 <> 0 THEN '' ELSE answer END AS answer, CASE WHEN conv_id % 4 = 0 AND conv_id % 8 <> 0 THEN 'timeout' ELSE '' END AS error FROM (SELECT qid, conv_id, turn, question, answer FROM cand JOIN (SELECT conv_id AS c, turn, conv_id || '-' || turn AS q FROM turns) x ON x.q = cand.qid))"""
_L1 = f"""WITH {_ATTEMPTS}, n AS (SELECT *, answer AS text, list_filter(string_split({C._norm("answer")}, ' '), lambda x: x <> '') AS w FROM att),
r AS (SELECT *, list_filter(list_prepend(CASE WHEN error <> '' THEN 'generation_error' END, {C._REASONS}), lambda x: x IS NOT NULL) AS reasons FROM n),
v AS (SELECT qid, answer, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(question, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[,;|،]'))) AS variant FROM r),
c AS (SELECT qid, coalesce(max(CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) END), 0.0) AS coverage FROM (SELECT qid, {C._bag("replace(variant, chr(1), ',')")} AS want, {C._bag("answer")} AS have FROM v) GROUP BY qid),
b AS (SELECT qid, reasons, list_distinct(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS want, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS have FROM r),
p AS (SELECT *, CASE WHEN len(reasons) = 0 THEN CASE WHEN len(want) > 0 THEN 1.0 - len(list_intersect(want, have)) / len(want) ELSE 0.5 END END AS p FROM b)"""


def layer1_stage(spark, d):
    root = shared.folder(spark, "layer1")
    log = _write_log(spark, d, f"{root}/log")
    stages.run_layer1(spark, log, f"{root}/out")
    return readers.csv(spark, f"{root}/out").select("qid", "error", F.col("layer1_coverage").cast("double").alias("coverage"), "layer1_decision", "degeneration_reasons")


def layer2_stage(spark, d):
    root = shared.folder(spark, "layer2")
    stages.run_layer1(spark, _write_log(spark, d, f"{root}/log"), f"{root}/one")
    stages.run_layer2(spark, f"{root}/one", f"{root}/two", routing.OverlapScorer(0.5), override=0.4, acknowledged=True)
    t = readers.csv(spark, f"{root}/two")
    return t.select("qid", F.nullif("layer2_hallucination_probability", F.lit("")).cast("double").alias("p"), "layer2_decision_threshold", "combined_decision", "combined_label", "headline_failure_label")


def rescored_runs(spark, d):
    root = shared.folder(spark, "rescore")
    first, later = _turn_log(spark, d)
    sinks.csv(first, f"{root}/in/run1")
    sinks.csv(later, f"{root}/in/run2")
    got = stages.rescore_all(spark, f"{root}/in", f"{root}/out", routing.OverlapScorer(0.5), name="part-*.csv")
    if stages.rescore_all(spark, f"{root}/in", f"{root}/out", routing.OverlapScorer(0.5), name="part-*.csv"):
        raise AssertionError("runs were scored again")
    out = None
    for run in sorted(got):
        one = readers.csv(spark, f"{root}/out/{run}").groupBy("combined_decision").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


def drift_stage(spark, d):
    root = shared.folder(spark, "drift")
    g = A.canonical_generations(spark, d).select("qid", "variety", "condition", "model", F.concat(F.lit("f"), F.col("qid").cast("int") % 3).alias("family"), F.col("decision").alias("combined_decision"), F.lit("").alias("layer1_decision"), "degeneration_reasons")
    sinks.csv(g, f"{root}/scored")
    t = stages.run_analysis(spark, [f"{root}/scored"], f"{root}/analysis", iterations=2)
    back = readers.json(spark, f"{root}/analysis.json").select("model", "dialect", "condition", F.col("hds").alias("hds_in_json"))
    return t.join(back, ["model", "dialect", "condition"]).drop(*(c for c in t.columns if "_ci_" in c))


def _write_candidates(spark, d):
    root = shared.folder(spark, "candidates")
    sinks.csv(C._candidates(spark, d), f"{root}/candidates")
    return root


def check_stage(spark, d):
    root = _write_candidates(spark, d)
    return rounded(stages.run_check(spark, f"{root}/candidates", f"{root}/sheet"))


def finalize_stage(spark, d):
    root = _write_candidates(spark, d)
    k = F.col("conv_id") % 5
    sheet = C._candidates(spark, d).select("qid", F.when(k == 0, "approve").when(k == 1, "r").when(k == 2, "D").otherwise("").alias("APPROVE_or_REWRITE"), F.when(k == 1, F.concat(F.lit("new "), "dialect_candidate")).otherwise("").alias("your_rewrite"), F.when(k == 0, "4").otherwise("").alias("fluency_1_5"))
    sinks.csv(sheet, f"{root}/reviewed")
    stages.run_finalize(spark, f"{root}/candidates", f"{root}/reviewed", f"{root}/final", f"{root}/metrics.json", "gulf")
    m = readers.json(spark, f"{root}/metrics.json", "dialect string, n_reviewed long, n_unreviewed long, n_final_benchmark long")
    return readers.csv(spark, f"{root}/final").groupBy("provenance", "dialect").agg(F.count("*").alias("n")).join(m, "dialect")


class _Lengths(training.TextMetric):
    """A stand-in for a learned similarity: the shorter length over the longer."""

    def load(self):
        return lambda a, b: [min(len(x), len(y)) / max(len(x), len(y)) for x, y in zip(a, b)]


def translation_score_stage(spark, d):
    root = _write_candidates(spark, d)
    return stages.run_translation_scores(spark, f"{root}/candidates", f"{root}/scores", {"bertscore_f1": _Lengths()})


def _replies(spark, d):
    k, q = F.col("event_id") % 5, F.col("event_id") % 3
    said = F.concat(F.lit("Here:\nQuality: "), k, F.lit(" of 5\n fluency - "), q, F.lit(".5\nCOHERENCE: 2\n"), F.when(F.col("event_id") % 7 != 0, "Understandability: 4 or 5").otherwise("none"))
    return A.table(spark, d, "events").select(F.col("event_id").cast("string").alias("qid"), said.alias("raw_response"))


def judge_stage(spark, d):
    root = shared.folder(spark, "judged")
    return stages.run_judge(spark, _replies(spark, d), root)


def judge_replies(spark, d):
    root = shared.folder(spark, "judged")
    stages.run_judge(spark, _replies(spark, d), root)
    return readers.csv(spark, root).select("qid", *(F.nullif(c, F.lit("")).cast("double").alias(c) for c in ("quality", "fluency", "coherence", "understandability")))


def _scored(spark, d):
    g = A.layered(spark, d)
    return g.select("qid", "variety", "condition", "model", F.lit("q").alias("question"), F.lit("g").alias("gold_answer"), F.lit("a").alias("answer"), F.col("decision").alias("combined_decision"), F.col("p").alias("layer2_hallucination_probability"), F.when(F.col("p").isNotNull(), F.col("threshold")).alias("layer2_decision_threshold"))


def audit_packet(spark, d):
    root = shared.folder(spark, "audit")
    sinks.csv(_scored(spark, d), f"{root}/scored")
    stages.prepare_audit(spark, [f"{root}/scored"], f"{root}/packet", 250)
    a, b, key = (readers.csv(spark, f"{root}/packet/{n}") for n in ("validator_a", "validator_b", "key"))
    return a.join(b.select("sample_id", F.col("comments").alias("b_comments")), "sample_id").join(key.select("sample_id", "threshold_band"), "sample_id").select("sample_id", "qid", "variety", "threshold_band", F.concat("human_label", "error_type", "comments", "b_comments").alias("blanks"))


def layer3_packet(spark, d):
    root = shared.folder(spark, "layer3")
    sinks.csv(_scored(spark, d), f"{root}/scored")
    stages.prepare_layer3(spark, f"{root}/scored", f"{root}/packets", 100)
    out = None
    for v in ("egyptian", "gulf", "levantine", "sudanese"):
        one = readers.csv(spark, f"{root}/packets/{v}/validator_a").select(F.regexp_extract("sample_id", "^(.*)_", 1).alias("variety"), "human_label")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("variety", "human_label").agg(F.count("*").alias("n"))


def packet_evaluation(spark, d):
    """The evaluation stage over the sheets of two raters, with and without adjudication."""
    root = shared.folder(spark, "packet")
    t = A.table(spark, d, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    cls = lambda c: F.when(F.col(c) == 1, "Clean").otherwise("hallucinated")
    sinks.csv(t.select("sample_id", F.when(F.col("doc_id") % 7 == 0, "factual_hallucination").otherwise("clean").alias("combined_decision")), f"{root}/key")
    sinks.csv(t.select("sample_id", cls("quality").alias("human_label")), f"{root}/a")
    sinks.csv(t.select("sample_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.when(F.col("toxic") == 1, "1").otherwise("0")).alias("human_label")), f"{root}/b")
    sinks.csv(t.filter("doc_id % 2 = 0").select("sample_id", cls("quality").alias("human_label")), f"{root}/j")
    out = None
    for j in (None, f"{root}/j"):
        s, m = stages.evaluate_packet(spark, f"{root}/key", (f"{root}/a", f"{root}/b"), j)
        one = rounded(s.crossJoin(m.filter("label = 'clean'").select("precision", "recall", "accuracy"))).withColumn("adjudicated", F.lit(j is not None))  # single rows
        out = one if out is None else out.unionByName(one)
    return out


def epoch_report(spark, d):
    root = shared.folder(spark, "epochs")
    e = A.table(spark, d, "events").filter("event_id % 10 < 4").agg(F.array_sort(F.collect_list(F.struct("event_id", ((F.col("event_id") % 40) / 10.0).alias("epoch"), F.when(F.col("event_type") == "view", F.col("value")).alias("loss"), F.when(F.col("event_type") == "click", F.col("value")).alias("eval_loss")))).alias("log_history"))
    sinks.parquet(e.select(F.to_json(F.struct("log_history")).alias("value")), f"{root}/doc")
    spark.read.parquet(f"{root}/doc").write.text(f"{root}/state")
    stages.training_report(spark, f"{root}/state", f"{root}/report")
    t = readers.csv(spark, f"{root}/report")
    return t.select(*(F.round(F.nullif(c, F.lit("")).cast("double"), 6).alias(c) for c in ("epoch", "train_loss", "validation_loss")))


def test_report(spark, d):
    one, _ = stages.evaluate_test(A.scored_labels(spark, d).withColumnRenamed("score", "probability"), 0.5)
    return rounded(one)


def test_tag_report(spark, d):
    t = A.scored_labels(spark, d).select("label", F.col("score").alias("probability"), F.col("toxic").cast("string").alias("toxic"))
    return rounded(stages.evaluate_test(t, 0.5, ["toxic"])[1])


def generate_stage(spark, d):
    """Every condition for some items and two models, asked twice: the second run finds nothing to do."""
    log = shared.folder(spark, "generate") + "/log"
    items = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.when(F.col("conv_id") % 2 == 0, "msa").otherwise("gulf").alias("variety"), "question", F.lit("g").alias("gold_answer"))
    registry = {"m0": {"model_id": "org/m0", "family": "f0"}, "m1": {"family": "f1"}}
    for _ in range(2):
        stages.run_generate(spark, items, registry, generation.CONDITIONS, log, _Systems)
    return spark.read.parquet(log).select("qid", "variety", "condition", "model", "family", "answer", F.length("pivot_question").alias("pivot_chars"), "model_id", "resolved_model_id", "pivot_model_id", "error")


class _Systems:
    """A client that says how many turns it was given, and the last one's length; its own name is that of the model."""

    def __call__(self, model: str, turns: list[dict], tokens: int) -> tuple[str, str]:
        return f"{len(turns)} {turns[-1]['role']} {len(turns[-1]['content'])}", f"{model}@1"


def translate_stage(spark, d):
    root = shared.folder(spark, "translate")
    t = A.turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(F.lit(" "), "question").alias("question_msa"), F.lit("g").alias("gold_answer"))
    sinks.csv(t, f"{root}/seed")
    sinks.csv(spark.createDataFrame([("سؤال", "سوال", ""), ("ثان", "تاني", "Najdi"), ("ثالث", "", "x")], "msa_question string, dialect_question string, sub_variety string").coalesce(1), f"{root}/exemplars")
    for _ in range(2):
        stages.run_translate(spark, f"{root}/seed", f"{root}/exemplars", f"{root}/log", "gulf", _Systems, "m")
    return spark.read.parquet(f"{root}/log").select("qid", "dialect_candidate", "backtranslation_msa", "sub_variety", "requested_model", "translation_model", "backtranslation_model", "n_exemplars", "coda", "temperature")


def layer1_against_labels(spark, d):
    root = shared.folder(spark, "judged-labels")
    t = A.spread(A.table(spark, d, "documents").select("doc_id", "text")).join(A.table(spark, d, "labels").filter("quality is not null"), "doc_id")
    sinks.csv(t.select(F.concat(F.lit("q"), "doc_id").alias("question"), F.lit("g").alias("gold_answer"), F.col("text").alias("answer"), (1 - F.col("quality")).alias("hallucinated")), f"{root}/data")
    stages.evaluate_layer1(spark, f"{root}/data", f"{root}/layer1.json")
    return readers.json(spark, f"{root}/layer1.json", "n long, n_resolved long, n_deferred long, resolution_rate double, reasons map<string,long>").select("n", "n_resolved", "n_deferred", "resolution_rate", F.coalesce(F.col("reasons")["heavy_repetition"], F.lit(0)).alias("n_heavy_repetition"))


QUERIES = {f.__name__: f for f in (
    csv_round_trip, arms_of_files, json_round_trip, json_summary_of_a_run, resume_set, snapshot_manifest, snapshot_problems, snapshot_size, judge_labels, benchmark_arms, exemplar_pairs, annotations, prediction_sheet,
    judge_inputs, positive_probability, char_similarity, provisional_arm, answer_budgets, distinct_arms, layer1_stage, layer2_stage, rescored_runs, drift_stage, check_stage, finalize_stage, translation_score_stage, judge_stage, judge_replies,
    audit_packet, layer3_packet, packet_evaluation, epoch_report, test_report, test_tag_report, generate_stage, translate_stage, layer1_against_labels,
)}

_RUN = "CASE WHEN len(reasons) > 0 THEN 'degeneration' WHEN p >= {t} THEN 'factual_hallucination' ELSE 'clean' END"
_F1_CASED = C._f1("question", "{other}").replace("lower(", "(")
_METRIC_NAMES = ("quality", "fluency", "coherence", "understandability")
_PARSED = """SELECT CAST(event_id AS VARCHAR) AS qid, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS quality, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 + 0.5::DOUBLE END AS fluency, CASE WHEN event_id % 7 <> 0 THEN 2.0::DOUBLE END AS coherence, CASE WHEN event_id % 7 <> 0 THEN 4.0::DOUBLE END AS understandability FROM events"""

ORACLE_SQL = {
    "csv_round_trip": "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, coalesce(text, '') AS text FROM conversations",
    "arms_of_files": "SELECT role AS analysis_run, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, count(*) FILTER (role = 'user') AS n_without_role FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role",
    "json_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name AS name_in_csv FROM nation",
    "json_summary_of_a_run": f"WITH {C.GEN} SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, count(DISTINCT model) AS n_models FROM canon",
    "resume_set": f"WITH {C.GEN} SELECT DISTINCT qid, variety, condition, model FROM gen WHERE ok",
    "snapshot_manifest": "SELECT replace(n_name, ' ', '_') || '.txt' AS path, CAST(octet_length(encode('about ' || n_name)) AS BIGINT) AS size, sha256('about ' || n_name) AS sha256 FROM nation",
    "snapshot_problems": "SELECT n_name || '.txt' AS path, CASE n_name WHEN 'NATION_4' THEN 'missing' ELSE 'size' END AS problem FROM nation WHERE n_name IN ('NATION_4', 'NATION_3') UNION ALL SELECT 'ATLANTIS.txt', 'extra'",
    "snapshot_size": "SELECT count(*) AS n_files, CAST(sum(octet_length(encode('about ' || n_name))) AS BIGINT) AS n_bytes FROM nation",
    "judge_labels": """WITH t AS (SELECT doc_id, 'q' || doc_id % 50 AS question, CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT) AS label FROM documents JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0 AND trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
        g AS (SELECT question, row_number() OVER (ORDER BY min(doc_id), question) - 1 AS group_id FROM t GROUP BY question) SELECT doc_id, question, label, CAST(group_id AS INT) AS group_id FROM t JOIN g USING (question)""",
    "benchmark_arms": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, c_name, c_mktsegment, c_custkey FROM customer), a AS (SELECT *, 'msa' AS variety FROM c UNION ALL SELECT *, 'gulf' FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT *, 'sudanese' FROM c WHERE c_custkey % 6 = 0)
        SELECT qid, variety, c_name AS question, c_mktsegment AS gold_answer FROM a QUALIFY row_number() OVER (PARTITION BY variety ORDER BY c_custkey) <= 40""",
    "exemplar_pairs": f"WITH {C.CAND}, t AS (SELECT conv_id, turn, trim(question, ' ' || chr(9) || chr(10)) AS q, CASE WHEN turn % 4 = 0 THEN trim(answer, ' ' || chr(9) || chr(10)) ELSE '' END AS a FROM turns) SELECT q AS msa_question, a AS dialect_question, (SELECT 's' || min(conv_id) FROM turns WHERE conv_id > 2) AS sub_variety FROM t WHERE q <> '' AND a <> ''",
    "annotations": """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, arg_max(event_id % 9, event_id) AS k FROM events GROUP BY user_id)
        SELECT sample_id, CASE WHEN k < 3 THEN 1 WHEN k < 6 THEN 0 END AS binary_label, CASE WHEN k < 3 THEN 'factual_hallucination' WHEN k < 6 THEN 'clean' WHEN k < 8 THEN 'degeneration' END AS class_label FROM l""",
    "prediction_sheet": f"WITH {C.SC} SELECT CAST(doc_id AS VARCHAR) AS row_index, source AS sample_index, lang AS answer, CAST(label AS VARCHAR) AS gold_label, round(score, 8) AS hallucination_probability, CAST(CAST(score >= 0.5 AS INT) AS VARCHAR) AS predicted_label FROM sc",
    "judge_inputs": f"WITH {C.CAND} SELECT conv_id, turn, variant, CASE variant WHEN 'answer_only' THEN '' WHEN 'gold_answer' THEN answer ELSE question || chr(10) || answer END AS context, 'a' || conv_id AS answer FROM turns, (VALUES ('answer_only'), ('gold_answer'), ('question_gold_answer')) v(variant)",
    "positive_probability": "SELECT event_id, round(1 / (1 + exp(value / 10 - (3 - value / 10))), 6) AS p FROM events WHERE value IS NOT NULL",
    "provisional_arm": f"WITH {C.CAND} SELECT qid, question AS question_msa, answer AS question_dialect, 'gold' AS gold_answer, 'gulf' AS dialect, sub AS sub_variety, 'provisional_unreviewed' AS provenance FROM cand",
    "answer_budgets": f"WITH {C.CAND} SELECT qid, 'm' || conv_id % 4 AS model, CASE conv_id % 4 WHEN 0 THEN '2048' WHEN 1 THEN '4096' ELSE '' END AS answer, CASE conv_id % 4 WHEN 3 THEN 'no such model' ELSE '' END AS error, CASE WHEN conv_id % 4 < 3 THEN 'm' || conv_id % 4 ELSE '' END AS resolved_model_id, true AS has_time FROM cand",
    "distinct_arms": f"WITH {C.GEN} SELECT string_agg(DISTINCT variety, ',' ORDER BY variety) AS variety, string_agg(DISTINCT condition, ',' ORDER BY condition) AS condition, string_agg(DISTINCT model, ',' ORDER BY model) AS model FROM canon",
    "layer1_stage": f"{_L1} SELECT p.qid, error, round_even(coverage, 4) AS coverage, CASE WHEN len(p.reasons) > 0 THEN 'degeneration' ELSE 'defer' END AS layer1_decision, array_to_string(p.reasons, '|') AS degeneration_reasons FROM p JOIN c USING (qid) JOIN att USING (qid)",
    "layer2_stage": f"{_L1} SELECT qid, round_even(p, 6) AS p, CASE WHEN p IS NOT NULL THEN '0.4' ELSE '' END AS layer2_decision_threshold, {_RUN.format(t=0.4)} AS combined_decision, CASE WHEN p IS NOT NULL THEN CAST(CAST(p >= 0.4 AS INT) AS VARCHAR) ELSE '' END AS combined_label, CAST(CAST(len(reasons) > 0 OR p >= 0.4 AS INT) AS VARCHAR) AS headline_failure_label FROM p",
    "rescored_runs": f"{_L1}, x AS (SELECT p.*, att.conv_id FROM p JOIN att USING (qid)) SELECT 'run2' AS run, {_RUN.format(t=0.5)} AS combined_decision, count(*) AS n FROM x WHERE conv_id % 4 <> 0 OR conv_id % 8 = 0 GROUP BY ALL UNION ALL SELECT 'run1', 'degeneration', count(*) FROM cand WHERE conv_id % 4 = 0",
    "drift_stage": f"WITH {C.PAIRS}, fam AS (SELECT model, variety, condition, arg_min('f' || CAST(qid AS INT) % 3, qid) AS family FROM pairs GROUP BY ALL), t AS ({C._DRIFT}) SELECT t.* EXCLUDE (variety), t.variety AS dialect, family, hds AS hds_in_json, 2 AS bootstrap_iterations, 42 AS bootstrap_seed FROM t JOIN fam USING (model, variety, condition)",
    "check_stage": f"WITH {C.CHECKED} SELECT count(*) AS n, round(avg(bt), 6) AS mean_bt, round(avg(dd), 6) AS mean_dd, count(*) FILTER (len(flags) > 0) AS n_flagged FROM flg",
    "finalize_stage": f"""WITH {C.CAND}, s AS (SELECT conv_id % 5 AS k, back <> '' AND {C._f1("question", "back")} < 0.4 AS low FROM cand), f AS (SELECT *, CASE k WHEN 0 THEN NOT low WHEN 1 THEN true ELSE false END AS kept FROM s)
        SELECT CASE k WHEN 0 THEN 'machine' ELSE 'human_rewrite' END AS provenance, 'gulf' AS dialect, count(*) AS n, (SELECT count(*) FROM f WHERE k < 3) AS n_reviewed, (SELECT count(*) FROM f WHERE k >= 3) AS n_unreviewed, (SELECT count(*) FROM f WHERE kept) AS n_final_benchmark FROM f WHERE kept GROUP BY k""",
    "translation_score_stage": f"""WITH {C.CAND}, s AS (SELECT CASE WHEN back <> '' THEN {_F1_CASED.replace("{other}", "back")} END AS b, {_F1_CASED.replace("{other}", "answer")} AS dd, CASE WHEN trim(question) <> '' AND trim(back) <> '' THEN least(length(question), length(back)) / greatest(length(question), length(back)) END AS m FROM cand)
        SELECT count(*) AS n, round_even(avg(b), 4) AS mean_backtrans_similarity, round_even(avg(dd), 4) AS mean_dialect_distance, round_even(avg(m), 4) AS mean_bertscore_f1, count(*) FILTER (dd >= 0.95) AS n_unchanged, count(*) FILTER (b < 0.4) AS n_drifted FROM s""",
    "judge_replies": _PARSED,
    "judge_stage": f"SELECT {', '.join(f'round_even(avg({n}), 2) AS mean_{n}' for n in _METRIC_NAMES)}, count(*) FILTER (quality IS NULL) AS n_failed FROM ({_PARSED})",
    "layer3_packet": f"WITH {C.GEN} SELECT variety, '' AS human_label, least(100, count(*)) AS n FROM canon WHERE variety <> 'msa' GROUP BY variety",
    "test_report": f"WITH {C.SWEEP.partition(chr(10) + 'hits AS')[0].rstrip(',')}, c AS (SELECT {C._CONF} FROM (SELECT *, score >= 0.5 AS s FROM sc)), m AS (SELECT *, {C._BIN} FROM c), auc AS (SELECT sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) AS a FROM sc x JOIN sc y ON x.label = 1 AND y.label = 0), g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM sc GROUP BY score), w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS up, sum(n) OVER (ORDER BY score DESC) AS k FROM g), ap AS (SELECT sum(pos * up / k) / sum(pos) AS a FROM w) SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(auc.a, 6) AS roc_auc, round(ap.a, 6) AS average_precision FROM m, auc, ap",
    "test_tag_report": f"WITH {C.SC} SELECT 'toxic' AS tag, count(*) FILTER (toxic = 1) AS n, round(count(*) FILTER (toxic = 1 AND score >= 0.5) / count(*) FILTER (toxic = 1), 6) AS recall FROM sc",
    "packet_evaluation": C.ORACLE_SQL["agreement_summary"].replace("SELECT *, round(n_double", "SELECT s.*, round(n_double").rstrip().removesuffix("FROM s") + """, pr.precision, pr.recall, pr.accuracy FROM s JOIN (SELECT adjudicated, round(count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (p = 1), 6) AS precision, round(count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (t = 1), 6) AS recall, round(avg(CAST(t = p AS INT)), 6) AS accuracy
        FROM (SELECT adjudicated, p, CASE WHEN adjudicated THEN j ELSE a END AS t FROM m, v WHERE dbl AND CASE WHEN adjudicated THEN j IS NOT NULL ELSE same END) GROUP BY adjudicated) pr USING (adjudicated)""",
    "audit_packet": C.ORACLE_SQL["audit_sample"].replace("md5('42|' || qid || '|' || variety || '|' || model)", "md5('42|' || qid || '|' || variety || '|direct|' || model)").replace("variety, audit_route, threshold_band, qid, model FROM tk", "qid, variety, threshold_band, '' AS blanks FROM tk"),
    "epoch_report": "WITH e AS (SELECT event_id, (event_id % 40) / 10.0::DOUBLE AS epoch, CASE WHEN event_type = 'view' THEN value END AS loss, CASE WHEN event_type = 'click' THEN value END AS eval_loss FROM events WHERE event_id % 10 < 4) SELECT round(epoch, 6) AS epoch, round(arg_max(loss, event_id) FILTER (loss IS NOT NULL), 6) AS train_loss, round(arg_max(eval_loss, event_id) FILTER (eval_loss IS NOT NULL), 6) AS validation_loss FROM e GROUP BY epoch",
    "generate_stage": f"""WITH {C.CAND}, i AS (SELECT conv_id || '-' || turn AS qid, CASE WHEN conv_id % 2 = 0 THEN 'msa' ELSE 'gulf' END AS variety, length(question) AS n FROM turns), w AS (SELECT * FROM (VALUES ('direct'), ('msa_answer'), ('dialect_aware'), ('msa_pivot'), ('msa_restate')) c(condition), (VALUES ('m0', 'org/m0', 'f0'), ('m1', 'm1', 'f1')) m(model, model_id, family)),
        t AS (SELECT *, '2 user ' || n AS pv FROM i, w WHERE NOT (variety = 'msa' AND condition = 'msa_answer'))
        SELECT qid, variety, condition, model, family, CASE condition WHEN 'direct' THEN '1 user ' || n WHEN 'msa_pivot' THEN '2 user ' || length(pv) ELSE '2 user ' || n END AS answer, CAST(CASE condition WHEN 'msa_pivot' THEN length(pv) ELSE 0 END AS INT) AS pivot_chars, model_id, model_id || '@1' AS resolved_model_id, CASE condition WHEN 'msa_pivot' THEN model_id || '@1' ELSE '' END AS pivot_model_id, '' AS error FROM t""",
    "translate_stage": f"WITH {C.CAND}, t AS (SELECT conv_id || '-' || turn AS qid, '6 user ' || length(trim(question, ' ' || chr(9) || chr(10))) AS dialect_candidate FROM turns) SELECT qid, dialect_candidate, '2 user ' || length(dialect_candidate) AS backtranslation_msa, 'Najdi' AS sub_variety, 'm' AS requested_model, 'm@1' AS translation_model, 'm@1' AS backtranslation_model, '2' AS n_exemplars, '1' AS coda, '0.3' AS temperature FROM t",
    "layer1_against_labels": f"{C._LAYER1}, j AS (SELECT doc_id, reasons FROM r JOIN labels USING (doc_id) JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND trim(coalesce(d.text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') SELECT count(*) AS n, 0 AS n_resolved, count(*) AS n_deferred, 0.0::DOUBLE AS resolution_rate, count(*) FILTER (list_contains(reasons, 'heavy_repetition')) AS n_heavy_repetition FROM j",
}
