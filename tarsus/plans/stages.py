"""Whole stages over files: text tables in, tables and summaries out.

Inputs and outputs are folders or files that every executor can reach. Each stage reads with
the empty-is-missing rule and writes CSV tables and JSON summaries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, prompts, text
from ..operators import agreement, dedupe, generation, paired, routing, sampling, training, translation
from ..sources import readers, sinks

_ordered = readers.with_sequence


def run_translate(spark: SparkSession, seed: str, exemplars: str, log: str, dialect: str, client: Callable[[], generation.Client], model: str, coda: bool = True, temperature: float = 0.3, back: bool = True, limit: int | None = None, wording: prompts.Translation = prompts.Translation()) -> DataFrame:  # noqa: B008
    """Translate the seed questions that the log of candidates lacks, and append them; returns the whole log.

    Exemplars are earlier turns of the prompt. A log of another model, sub-variety, spelling rule
    or temperature is an error. ``limit`` takes the first rows of the seed file.
    """
    pairs, sub = readers.exemplars(_ordered(readers.csv(spark, exemplars)), "_seq")
    shots = [tuple(r) for r in pairs.collect()]  # written by hand
    rows = _ordered(readers.csv(spark, seed))
    rows = rows.orderBy("_seq").limit(limit) if limit is not None else rows
    if sinks.exists(spark, log):
        have = spark.read.parquet(log)
        other = have.filter((F.col("requested_model") != model) | (F.col("sub_variety") != sub) | (F.col("coda") != str(int(coda))) | (F.col("temperature").cast("double") != temperature))
        if not other.isEmpty():
            raise ValueError(f"the log at {log} is of another setup")
        rows = rows.join(have.filter(text.ws_trim(F.col("dialect_candidate")) != "").select("qid"), "qid", "left_anti")
    asked = rows.select("qid", text.ws_trim(F.col("question_msa")).alias("question_msa"), "gold_answer", F.lit(model).alias("model"), prompts.few_shot(wording.translator(dialect, sub, coda), shots, F.col("question_msa")).alias("messages"))
    said = generation.generate(asked, client).select("qid", "question_msa", "gold_answer", "model", F.col("answer").alias("dialect_candidate"), F.col("resolved_model_id").alias("translation_model"))
    if back:
        again = labels.chat(("system", F.lit(wording.back_translator(dialect))), ("user", F.col("dialect_candidate")))
        said = generation.generate(said.withColumn("messages", again), client).withColumnsRenamed({"answer": "backtranslation_msa", "resolved_model_id": "backtranslation_model"})
    else:
        said = said.withColumns({"backtranslation_msa": F.lit(""), "backtranslation_model": F.lit("")})
    setup = {"sub_variety": sub, "requested_model": model, "n_exemplars": str(len(shots)), "coda": str(int(coda)), "temperature": str(temperature)}
    sinks.append_log(said.withColumns({n: F.lit(v) for n, v in setup.items()}).select(*readers.CANDIDATE), log, readers.CANDIDATE)
    return spark.read.parquet(log)


def run_generate(spark: SparkSession, items: DataFrame, registry: dict[str, dict], conditions: Sequence[str], log: str, client: Callable[[], generation.Client], temperature: float = 0.0, wording: prompts.Conditions = prompts.Conditions()) -> DataFrame:  # noqa: B008
    """Ask every model for every item (qid, variety, question, gold_answer) under every condition, but for what the log has already; append, and return the log.

    Attempts that failed stay in the log with their error and are made again by a later run.
    """
    todo = generation.plan(items, sorted(registry), conditions)
    if sinks.exists(spark, log):
        todo = generation.remaining(todo, generation.done_keys(spark.read.parquet(log)))
    todo = todo.join(F.broadcast(generation.models(spark, registry)), "model")  # a handful of models
    c, q = F.col("condition"), F.col("question")
    asked = todo.withColumns({"messages": wording.messages(c, F.col("variety"), q), "pivot_messages": wording.pivot_messages(c, q), "temperature": F.lit(str(temperature))})
    sinks.append_log(generation.generate(asked, client).select(*readers.GENERATION), log, readers.GENERATION)
    return spark.read.parquet(log)


def run_layer1(spark: SparkSession, log: str | Sequence[str], out: str) -> DataFrame:
    """Canonical rows of a generation log, or of several in order, with coverage, decision and reasons."""
    parts = [log] if isinstance(log, str) else list(log)
    rows = routing.layer1(readers.many(spark, parts, seq="_seq").drop("source_file", "analysis_run"), "_seq").drop("_seq")
    sinks.csv(rows.withColumn("layer1_coverage", text.fixed(F.col("layer1_coverage"), 4)), out)
    return rows


def run_layer2(spark: SparkSession, scores: str, out: str, scorer: routing.Scorer, override: float | None = None, acknowledged: bool = False) -> DataFrame:
    """Layer-1 scores with the classifier's probabilities and combined decisions."""
    rows = routing.layer2(readers.csv(spark, scores), scorer, override=override, acknowledged=acknowledged)
    sinks.csv(rows.withColumn("layer2_hallucination_probability", text.fixed(F.col("layer2_hallucination_probability"), 6)), out)
    return rows


def run_analysis(spark: SparkSession, paths: Sequence[str], stem: str, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """The drift table of one or more scored runs, with intervals, as JSON and CSV."""
    rows = readers.many(spark, list(paths), seq="_seq")
    first = F.col("layer1_decision") if "layer1_decision" in rows.columns else F.lit(None).cast("string")
    combined = F.col("combined_decision") if "combined_decision" in rows.columns else F.lit(None).cast("string")
    model = F.coalesce(F.nullif(F.col("analysis_run"), F.lit("")), F.col("model")) if "analysis_run" in rows.columns else F.col("model")
    keyed = rows.select("qid", "variety", "condition", model.alias("model"), "family", labels.decision(combined, first).alias("decision"), "degeneration_reasons", "_seq")
    one = dedupe.last_wins(keyed, dedupe.KEY, "_seq").drop("_seq")
    t = paired.hds(paired.pairs(one))
    out = t.join(paired.bootstrap(t, iterations, seed), list(paired.ARM), "left").withColumnsRenamed({"variety": "dialect"}).withColumns({"bootstrap_iterations": F.lit(iterations), "bootstrap_seed": F.lit(seed)}).orderBy("model", "dialect", "condition")
    sinks.json_and_csv(out, stem)
    return out


def run_check(spark: SparkSession, candidates: str, out: str, drift_below: float = 0.5) -> DataFrame:
    """A validation sheet of translation candidates, and its summary."""
    checked = translation.check(readers.csv(spark, candidates), drift_below)
    sinks.csv(translation.validation_sheet(checked), out)
    return translation.check_summary(checked)


def run_finalize(spark: SparkSession, candidates: str, sheet: str, out: str, metrics: str, dialect: str, min_back: float = 0.4) -> dict:
    """The final arm of a reviewed sheet, and its metrics."""
    rows = translation.reviewed(_ordered(readers.csv(spark, candidates)), readers.csv(spark, sheet), min_back, "_seq")
    summary = translation.finalize_metrics(rows, min_back).withColumn("dialect", F.lit(dialect))
    if not summary.first()["n_reviewed"]:
        raise ValueError("no reviewed rows; the decision column is empty")
    sinks.csv(translation.final_arm(rows, dialect), out)
    return sinks.json_summary(summary, metrics)


def run_translation_scores(spark: SparkSession, candidates: str, out: str, metrics: dict[str, training.TextMetric] | None = None) -> DataFrame:
    """Similarity, distance and learned metrics a row, and their summary."""
    c = readers.csv(spark, candidates)
    s = c.withColumn("backtrans_similarity", F.when(F.col("backtranslation_msa") != "", text.token_f1(F.col("question_msa"), F.col("backtranslation_msa"), lower=False))).withColumn("dialect_distance", text.token_f1(F.col("question_msa"), F.col("dialect_candidate"), lower=False))
    for name, metric in (metrics or {}).items():
        s = training.metric_column(s, metric, "question_msa", "backtranslation_msa", name)
    sinks.csv(s, out)
    return translation.score_summary(s)


def run_judge(spark: SparkSession, answers: DataFrame, out: str) -> DataFrame:
    """Scores parsed from an LLM judge's replies (qid, raw_response), and their means."""
    p = answers.withColumn("__p", text.parse_scores(text.text_or_empty("raw_response")))
    s = p.select(*answers.columns, *(F.col(f"__p.{n}").alias(n) for n in ("quality", "fluency", "coherence", "understandability")))
    sinks.csv(s, out)
    return translation.judged_summary(s)


def prepare_layer3(spark: SparkSession, scored: str, folder: str, size: int = 100, seed: int = 42, conditions: Sequence[str] = ("direct",)) -> DataFrame:
    """A blinded packet for each dialect: a key and two validators' sheets."""
    rows = readers.csv(spark, scored).filter((F.col("variety") != "msa") & F.col("condition").isin(*conditions)).withColumn("judge_route", labels.judge_route(F.nullif("layer2_hallucination_probability", F.lit(""))))
    strata = ["model", "combined_decision", "judge_route"]
    key = None
    varieties = [r[0] for r in rows.select("variety").distinct().orderBy("variety").collect()]  # a handful of dialects
    for d, v in enumerate(varieties):
        mine = rows.filter(F.col("variety") == v)
        alloc = sampling.layer3_allocation(mine.groupBy(*strata).agg(F.count("*").alias("n")), size, strata)
        got = sampling.sample_ids(sampling.take_allocated(mine, alloc, strata, sampling.shuffled(seed + d, *dedupe.KEY)), v, sampling.shuffled(seed + d + 1, *dedupe.KEY))
        sinks.packet(got, ["sample_id", "qid", "question", "gold_answer", "answer"], ["human_label", "comments"], f"{folder}/{v}", [seed + 10 * d, seed + 10 * d + 1], f"# Packet for {v}\n\nLabel each row without the key: 1 hallucinated, 0 clean.\n")
        key = got if key is None else key.unionByName(got)
    return key


def prepare_audit(spark: SparkSession, scored: Sequence[str], folder: str, size: int = 250, seed: int = 42) -> DataFrame:
    """A blinded packet over varieties, routes and bands of probability near the threshold."""
    rows = readers.many(spark, list(scored))
    number = lambda c: F.nullif(text.ws_trim(F.col(c)), F.lit("")).try_cast("double")
    rows = rows.withColumn("audit_route", labels.audit_route(F.col("combined_decision"))).withColumn("threshold_band", labels.threshold_band(number("layer2_hallucination_probability"), number("layer2_decision_threshold")))
    strata = ["variety", "audit_route", "threshold_band"]
    alloc = sampling.audit_allocation(rows.groupBy(*strata).agg(F.count("*").alias("n")), size)
    order = sampling.shuffled(seed, *dedupe.KEY)
    got = sampling.sample_ids(sampling.take_allocated(rows, alloc, strata, order), "audit", order)
    sinks.packet(got, ["sample_id", "qid", "variety", "question", "gold_answer", "answer"], ["human_label", "error_type", "comments"], folder, [seed, seed + 1], "# Audit packet\n\nLabel each row clean, factual_hallucination or degeneration.\n")
    return got


def evaluate_packet(spark: SparkSession, key: str, sheets: tuple[str, str], adjudicated: str | None = None, classes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Agreement of two validators, and the pipeline against what both say, or against the adjudicated rows: (summary, class metrics)."""
    parse = labels.class_annotation if classes else labels.binary_annotation
    a, b = (readers.annotation(_ordered(readers.csv(spark, s)), parse, seq="_seq") for s in sheets)
    j = readers.annotation(_ordered(readers.csv(spark, adjudicated)), parse, seq="_seq").filter("label is not null") if adjudicated else None
    said = readers.csv(spark, key).select("sample_id", parse(F.col("combined_decision")).alias("predicted"))
    values = labels.CLASSES if classes else (0, 1)
    both = a.withColumnRenamed("label", "x").join(b.withColumnRenamed("label", "y"), "sample_id").filter("x is not null and y is not null")
    summary = agreement.agreement_summary(said, a, b, j, classes=values)
    truth = both.join(j.withColumnRenamed("label", "truth"), "sample_id") if j is not None else both.filter("x = y").withColumn("truth", F.col("x"))
    return summary, agreement.class_metrics(truth.select("sample_id", "truth").join(said, "sample_id"), "truth", "predicted", values)


def evaluate_test(scored: DataFrame, threshold: float, tags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Metrics at a threshold with rank metrics, and recall by tag, of rows with label and probability."""
    p = F.col("probability") >= threshold
    one = agreement.binary_metrics(scored, "label", p)
    for extra in (agreement.roc_auc(scored, "label", "probability"), agreement.average_precision(scored, "label", "probability")):
        one = one.crossJoin(extra)  # single rows
    return one, agreement.tag_recall(scored, list(tags), p) if tags else None


def train_judge(spark: SparkSession, data: str, out: str, variant: str = "gold_answer", trainer: training.Trainer = training.TfidfTrainer(), seed: int = 42, smoke_groups: int | None = None) -> dict:  # noqa: B008
    """Fit a judge on the training groups, choose its threshold on the validation groups, and keep the test groups unseen.

    Writes the model, validation predictions, and metadata with the split's group ids, by which
    ``evaluate_test_once`` knows its test rows. ``smoke_groups`` takes the first groups of each split.
    """
    rows = readers.judge_rows(_numbered(spark, data), "row_index")
    split = sampling.grouped_train_validation_test(rows, "group_id", "label", seed)
    if smoke_groups is not None:
        first = [sampling.first_groups(split.filter(F.col("split") == p), "group_id", "row_index", smoke_groups) for p in ("train", "validation", "test")]
        split = first[0].unionByName(first[1]).unionByName(first[2])
    split = split.persist()
    d = training.weighted(training.judge_text(split, variant), False)
    part = lambda p: d.filter(F.col("split") == p)
    judge = trainer.fit(part("train"), part("validation"))
    judge.save(f"{out}/model")
    sinks.parquet(judge.score(part("validation")).select("row_index", "sample_index", "question", "gold_answer", "answer", "label", "probability", *_tags(split)), f"{out}/validation_scores")
    scored = spark.read.parquet(f"{out}/validation_scores")
    threshold = agreement.best_threshold(agreement.threshold_sweep(scored, "label", "probability")).first()["threshold"]
    metrics, tags = evaluate_test(scored, threshold, _tags(split))
    sinks.csv(training.predictions(scored, threshold), f"{out}/validation_predictions")
    ids = {f"{p}_group_ids": [r[0] for r in split.filter(F.col("split") == p).select("group_id").distinct().orderBy("group_id").collect()] for p in ("train", "validation", "test")}
    counts = {f"n_{r['split']}": r["count"] for r in split.groupBy("split").count().collect()}
    doc = {"input_variant": variant, "data_sha256": readers.sha256(spark, data), "seed": seed, "smoke_test": smoke_groups is not None, "decision_threshold": threshold, "validation_metrics": metrics.first().asDict(), "validation_per_tag_recall": {r.tag: r.recall for r in tags.collect()} if tags is not None else {}, "test_metrics": None, **counts, **ids}
    sinks.text(spark, f"{out}/metadata.json", json.dumps(doc, indent=2, ensure_ascii=False) + "\n")
    split.unpersist()
    return doc


def _numbered(spark: SparkSession, data: str) -> DataFrame:
    """Rows of a data file with ``row_index`` from 0 in file order, and ``sample_index``."""
    from pyspark.sql import Window as W

    rows = _ordered(readers.csv(spark, data))
    # a judge's data are answers that people labelled: they fit one task
    rows = rows.withColumn("row_index", F.row_number().over(W.orderBy("_seq")) - 1).drop("_seq")
    return rows if "sample_index" in rows.columns else rows.withColumn("sample_index", F.col("row_index").cast("string"))


def _tags(rows: DataFrame) -> list[str]:
    return [t for t in labels.TAGS if t in rows.columns]


def train_variants(spark: SparkSession, data: str, out: str, variants: Sequence[str] = ("answer_only", "gold_answer"), trainer: training.Trainer = training.TfidfTrainer(), share: float = 0.8) -> dict:  # noqa: B008
    """Fit each input variant with balanced class weights on stratified rows, report on the held-out rest, and name the one of largest ROC-AUC.

    Rows of a question may part here, so its figures flatter; ``train_judge`` keeps groups whole.
    """
    rows = readers.judge_rows(_numbered(spark, data), "row_index")
    split = sampling.stratified_rows(rows, "label", F.md5(F.col("row_index").cast("string")), "row_index", share).persist()
    found = {}
    for v in variants:
        d = training.judge_text(split, v)
        judge = trainer.fit(training.weighted(d.filter("split = 'train'"), True), d.filter("split <> 'train'"))
        judge.save(f"{out}/{v}/model")
        sinks.parquet(judge.score(training.weighted(d.filter("split <> 'train'"), False)).select("row_index", "label", "probability"), f"{out}/{v}/scores")
        scored = spark.read.parquet(f"{out}/{v}/scores").withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
        report = [r.asDict() for r in agreement.class_metrics(scored, "label", "predicted", (0, 1)).collect()]
        auc = agreement.roc_auc(scored, "label", "probability").first()["roc_auc"]
        found[v] = {"variant": v, "classification_report": report, "accuracy": report[0]["accuracy"], "f1_hallucinated": report[1]["f1"], "roc_auc": auc}
        sinks.text(spark, f"{out}/{v}/metadata.json", json.dumps(found[v], indent=2) + "\n")
    winner = max(found, key=lambda v: found[v]["roc_auc"])
    doc = {**{f"{v}_auc": found[v]["roc_auc"] for v in variants}, "winner": winner, "winner_path": f"{out}/{winner}"}
    sinks.text(spark, f"{out}/summary.json", json.dumps(doc, indent=2) + "\n")
    split.unpersist()
    return doc


def select_variant(spark: SparkSession, root: str, out: str, variants: Sequence[str] = training.VARIANTS) -> dict:
    """Rank the judges below ``root`` (a folder a variant) by their validation metrics; an error if one has seen its test rows."""
    found = {v: sinks.read_json(spark, f"{root}/{v}/metadata.json") for v in variants}
    for v, m in found.items():
        if m.get("test_metrics") is not None:
            raise ValueError(f"{v} was evaluated on its test set before a variant was chosen")
        if m["input_variant"] != v:
            raise ValueError(f"the folder {v} has a judge of variant {m['input_variant']}")
    rows = spark.createDataFrame([(v, float(m["validation_metrics"]["roc_auc"]), float(m["validation_metrics"]["f1"])) for v, m in found.items()], "variant string, validation_roc_auc double, validation_f1 double")
    ranking = [r["variant"] for r in training.rank_variants(rows, variants).orderBy("rank").collect()]
    doc = {"selection_partition": "validation", "winner": ranking[0], "ranking": ranking, "validation_results": {v: {"decision_threshold": found[v]["decision_threshold"], **found[v]["validation_metrics"]} for v in ranking}}
    sinks.text(spark, out, json.dumps(doc, indent=2) + "\n")
    return doc


def evaluate_test_once(spark: SparkSession, data: str, folder: str, trainer: training.Trainer = training.TfidfTrainer()) -> dict:  # noqa: B008
    """Score a judge's test rows, once: an error if it was done before, or if the data or the split aren't those it was trained on."""
    meta = sinks.read_json(spark, f"{folder}/metadata.json")
    rows = readers.judge_rows(_numbered(spark, data), "row_index")
    test = sampling.grouped_train_validation_test(rows, "group_id", "label", meta["seed"]).filter("split = 'test'")
    stated = spark.createDataFrame([(int(g),) for g in meta["test_group_ids"]], "group_id int")
    training.guard_test(meta, readers.sha256(spark, data), test.select("group_id"), stated, "group_id")
    scored = trainer.load(f"{folder}/model").score(training.weighted(training.judge_text(test, meta["input_variant"]), False))
    sinks.parquet(scored.select("row_index", "sample_index", "question", "gold_answer", "answer", "label", "probability", *_tags(test)), f"{folder}/test_scores")
    scored = spark.read.parquet(f"{folder}/test_scores")
    metrics, tags = evaluate_test(scored, meta["decision_threshold"], _tags(test))
    sinks.csv(training.predictions(scored, meta["decision_threshold"]), f"{folder}/test_predictions")
    meta |= {"test_metrics": metrics.first().asDict(), "test_per_tag_recall": {r.tag: r.recall for r in tags.collect()} if tags is not None else {}, "test_evaluated_after_variant_selection": True}
    sinks.text(spark, f"{folder}/metadata.json", json.dumps(meta, indent=2, ensure_ascii=False) + "\n")
    return meta["test_metrics"]


def evaluate_layer1(spark: SparkSession, data: str, out: str) -> dict:
    """The mechanical router against human labels of answers: what it resolves, how well, and how often each fault occurs.

    Coverage never decides, so this router only defers or finds faults, and resolves no label by itself.
    """
    rows = readers.labelled_rows(readers.csv(spark, data))  # the order of rows and groups of questions don't matter here
    s = text.score_answer(text.text_or_empty("answer"), text.text_or_empty("gold_answer"), F.lit(""))
    routed = rows.select("label", s.alias("s")).select("label", F.col("s.decision").alias("decision"), F.col("s.reasons").alias("reasons")).persist()
    counts = {r[0]: r[1] for r in routed.select(F.explode("reasons").alias("r")).groupBy("r").count().collect()}  # a handful of faults
    found = agreement.router_against_labels(routed, "decision", "label").withColumn("n_deferred", F.col("n") - F.col("n_resolved"))
    doc = sinks.json_summary(found.withColumn("reasons", F.create_map(*(F.lit(x) for kv in sorted(counts.items()) for x in kv)) if counts else F.create_map().cast("map<string,long>")), out)
    routed.unpersist()
    return doc


def training_report(spark: SparkSession, state: str, out: str) -> DataFrame:
    """Epoch metrics of a trainer's log (log_history: an array of events)."""
    fields = ", ".join(f"{k}: double" for k in training.EPOCH_FIELDS)
    d = readers.json(spark, state, f"log_history array<struct<epoch: double, {fields}>>").select(F.posexplode("log_history").alias("i", "e")).select("i", "e.*")
    rows = training.epoch_rows(d, "i")
    if rows.isEmpty():
        raise ValueError("the log has no event with an epoch")
    sinks.csv(rows.orderBy("epoch"), out)
    return rows


def rescore_all(spark: SparkSession, root: str, out: str, scorer: routing.Scorer, name: str = "log.csv") -> dict[str, DataFrame]:
    """Every run below a folder that isn't scored yet: both layers, integrity checks, counts. The runs are a short list.

    A run is scored once, into a folder that takes its name only after its checks; at the end every run must have one.
    """
    counts, runs = {}, {}
    for p in readers.find(spark, root, name):
        runs.setdefault(p.rsplit("/", 2)[-2], []).append(p)
    for run, p in runs.items():
        if sinks.exists(spark, f"{out}/{run}/_SUCCESS"):
            continue
        log = _ordered(readers.csv(spark, p))
        sinks.parquet(routing.layer2(routing.layer1(log, "_seq").drop("_seq"), scorer), f"{out}/_scored/{run}")
        scored = spark.read.parquet(f"{out}/_scored/{run}")
        bad = routing.check_scored(log, scored).filter("not ok").select("check").collect()
        if bad:
            raise ValueError(f"{run}: {[r['check'] for r in bad]}")
        sinks.csv(scored, f"{out}/{run}")
        counts[run] = routing.rollup(readers.csv(spark, f"{out}/{run}"))
    missing = [r for r in runs if not sinks.exists(spark, f"{out}/{r}/_SUCCESS")]
    if missing:
        raise ValueError(f"generation files without scores: {missing}")
    return counts
