"""Operators against golden tables, stated examples and sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from tarsus.operators import agreement, dedupe, generation, paired, routing, sampling, training, translation
from tarsus.sources import readers, sinks

GOLDEN = """ma|egyptian|149|45|42|60|0.344595|0.35473|0.010135|0.408163|0.830373|1.0
ma|gulf|162|30|30|72|0.346939|0.346939|0.0|0.545455|1.0|1.0
ma|levantine|153|40|39|62|0.343537|0.346939|0.003401|0.439716|1.0|1.0
ma|sudanese|135|59|29|73|0.344595|0.445946|0.101351|0.453416|0.001824|0.026664
mb|egyptian|28|59|43|149|0.688172|0.74552|0.057348|0.593625|0.137099|0.329038
mb|gulf|49|37|40|146|0.683824|0.672794|-0.011029|0.654709|0.819893|1.0
mb|levantine|43|42|49|141|0.690909|0.665455|-0.025455|0.607759|0.529602|0.847363
mb|sudanese|21|55|28|152|0.703125|0.808594|0.105469|0.646809|0.004039|0.026664
mc|egyptian|131|22|23|124|0.49|0.486667|-0.003333|0.733728|1.0|1.0
mc|gulf|135|18|11|136|0.49|0.513333|0.023333|0.824242|0.264931|0.529862
mc|levantine|130|23|12|135|0.49|0.526667|0.036667|0.794118|0.089531|0.306963
mc|sudanese|123|30|18|129|0.49|0.53|0.04|0.728814|0.111403|0.329038
md|egyptian|123|32|26|119|0.483333|0.503333|0.02|0.672316|0.511842|0.847363
md|gulf|123|32|21|123|0.481605|0.518395|0.036789|0.698864|0.168978|0.368679
md|levantine|123|32|20|125|0.483333|0.523333|0.04|0.706215|0.126347|0.329038
md|sudanese|113|42|19|126|0.483333|0.56|0.076667|0.673797|0.004444|0.026664
me|egyptian|87|49|44|120|0.546667|0.563333|0.016667|0.56338|0.678532|1.0
me|gulf|106|30|39|125|0.546667|0.516667|-0.03|0.64433|0.335558|0.619492
me|levantine|99|37|35|129|0.546667|0.553333|0.006667|0.641791|0.906294|1.0
me|sudanese|94|42|42|122|0.546667|0.546667|0.0|0.592233|1.0|1.0
mf|egyptian|39|16|13|224|0.811644|0.821918|0.010274|0.885375|0.711071|1.0
mf|gulf|34|23|10|227|0.806122|0.85034|0.044218|0.873077|0.035082|0.140328
mf|levantine|27|30|11|225|0.805461|0.870307|0.064846|0.845865|0.004324|0.026664
mf|sudanese|33|24|10|227|0.806122|0.853741|0.047619|0.869732|0.024307|0.116674"""
INTERVALS = {("ma", "sudanese"): (0.040541, 0.162162), ("mb", "sudanese"): (0.039062, 0.171973), ("md", "gulf"): (-0.010033, 0.083612), ("mf", "levantine"): (0.023891, 0.109215)}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [r.split("|") for r in GOLDEN.splitlines()]
    cells = spark.createDataFrame([(r[0], r[1], "direct", *map(int, r[2:6])) for r in rows], "model string, variety string, condition string, " + ", ".join(f"{c} long" for c in paired.CELLS))
    return rows, cells


def test_golden_drift(golden):
    rows, cells = golden
    got = {(r.model, r.variety): r for r in paired.from_cells(cells).collect()}
    for r in rows:
        g = got[r[0], r[1]]
        assert (g.hallucination_rate_msa, g.hallucination_rate_dialect, g.hds, g.hallucination_iou, g.mcnemar_exact_p, g.mcnemar_bh_q) == pytest.approx(tuple(map(float, r[6:])), abs=1.1e-6)


def test_bootstrap_intervals(golden):
    got = {(r.model, r.variety): r for r in paired.bootstrap(golden[1]).collect()}
    for k, (lo, hi) in INTERVALS.items():
        assert got[k].hds_ci_low == pytest.approx(lo, abs=0.012) and got[k].hds_ci_high == pytest.approx(hi, abs=0.012)


def test_mcnemar_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (5, 5), (2000, 2300)], "b long, c long")
    got = [r[0] for r in df.select(paired.mcnemar_exact(F.col("b"), F.col("c"))).collect()]
    assert got[:3] == pytest.approx([1.0, 0.25, 1.0]) and 0 < got[3] < 1e-4


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: r.q for r in paired.benjamini_hochberg(df, "p", "q", ("k",)).collect()} == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.04})


def drift(spark, rows):
    df = spark.createDataFrame([("m", v, "direct", q, d, "", "f") for v, q, d in rows], "model string, variety string, condition string, qid string, decision string, degeneration_reasons string, family string")
    return paired.hds(paired.pairs(df)).collect()


def test_pairs(spark):
    (r,) = drift(spark, [("msa", "1", "clean"), ("msa", "2", "hallucinated"), ("gulf", "1", "factual_hallucination"), ("gulf", "3", "factual_hallucination")])
    assert r.n_paired_total == 1 and r.hds == 1.0 and r.family == "f"
    (r,) = drift(spark, [("msa", "1", "clean"), ("msa", "2", "factual_hallucination"), ("msa", "3", "degeneration"), ("gulf", "1", "factual_hallucination"), ("gulf", "2", "clean"), ("gulf", "3", "clean")])
    assert (r.n_paired_total, r.n_paired_factual, r.clean_to_hallucination, r.hallucination_to_clean, r.n_degenerated_msa, r.mcnemar_exact_p) == (3, 2, 1, 1, 1, 1.0)


def test_canonical(spark):
    r = random.Random(0)
    log = [(str(r.randrange(5)), r.choice("ab"), "direct", "m", k, r.choice(["", "x"]), r.choice(["", "e"])) for k in range(200)]
    df = spark.createDataFrame(log, "qid string, variety string, condition string, model string, seq long, answer string, error string").repartition(5)
    want = {}
    for row in log:
        ok = bool(row[5]) and not row[6]
        old = want.get(row[:2])
        if old is None or ok or not (old[5] and not old[6]):
            want[row[:2]] = row
    got = dedupe.canonical(df, dedupe.succeeded(F.col("answer"), F.col("error")), "seq").collect()
    assert sorted(tuple(x) for x in got) == sorted(want.values())


def test_kappa(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "a int, b int")
    assert agreement.kappa_binary(df, "a", "b").first().kappa == 1.0
    assert agreement.kappa_binary(df.filter("a = 1"), "a", "b").first().kappa == 1.0
    rows = [("clean", "clean"), ("factual_hallucination", "degeneration"), ("degeneration", "degeneration")]
    m = {r.label: r for r in agreement.class_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert m["clean"].accuracy == pytest.approx(2 / 3) and m["degeneration"].recall == 1.0 and m["factual_hallucination"].f1 == 0.0


def test_published_confusion(spark):
    df = spark.createDataFrame([(0, 0.0, 262), (0, 1.0, 107), (1, 0.0, 33), (1, 1.0, 436)], "y int, p double, n int").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = agreement.binary_metrics(df, "y", F.col("p") >= 0.5).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((0.832936, 0.802947, 0.929638, 0.86166), abs=1e-6)


def test_rank_metrics(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), r.randrange(12) / 12) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert agreement.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    ap = 0.0
    for t in set(s for _, s in rows):
        at = [y for y, s in rows if s >= t]
        ap += sum(y for y, s in rows if s == t) / len(pos) * sum(at) / len(at)
    assert agreement.average_precision(df, "y", "s").first()[0] == pytest.approx(ap)
    best = agreement.best_threshold(agreement.threshold_sweep(df, "y", "s")).first()

    def f1(t):
        tp = sum(y and s >= t - 1e-9 for y, s in rows)
        n = sum(s >= t - 1e-9 for _, s in rows)
        return 2 * tp / (n + len(pos)) if n else 0.0

    grid = [round(0.05 + 0.005 * i, 6) for i in range(181)]
    assert best.threshold == min(grid, key=lambda t: (-round(f1(t), 12), round(abs(t - 0.5), 9), t))


def test_tag_recall(spark):
    df = spark.createDataFrame([("1", "0", 0.9), ("1", "1", 0.1)], "NER string, C string, p double").withColumn("NER", F.col("NER"))
    got = {r.tag: (r.n, r.recall) for r in agreement.tag_recall(df, ["NER", "C"], F.col("p") >= 0.05).collect()}
    assert got == {"NER": (2, 1.0), "C": (1, 1.0)}
    assert {r.tag: r.recall for r in agreement.tag_recall(df.filter("NER = 'x'"), ["NER"], F.col("p") > 0).collect()} == {"NER": None}


@pytest.mark.parametrize("case", range(6))
def test_allocations(spark, case):
    """The one-by-one allocations of the sampling rules, done one by one."""
    r = random.Random(case)
    keys = [(v, t, b) for v in "ab" for t in ("l1", "l2") for b in ("far", "near_0.05", "near_0.20")]
    n = {k: r.randrange(1, 40) for k in r.sample(keys, r.randrange(2, 12))}
    size = r.choice([1, 5, 30, 500])
    target = min(size, sum(n.values()))
    seed = int(target >= len(n))

    def allocate(best):
        a = {k: seed for k in n}
        while sum(a.values()) < target:
            a[best([k for k in sorted(n) if a[k] < n[k]], a)] += 1
        return {k: v for k, v in a.items() if v}

    df = spark.createDataFrame([(*k, c) for k, c in n.items()], "variety string, audit_route string, threshold_band string, n long")
    audit = allocate(lambda ks, a: min(ks, key=lambda k: (round(a[k] / min(n[k], target), 12), k[2] != "near_0.05", k)))
    assert {(x.variety, x.audit_route, x.threshold_band): x.allocated for x in sampling.audit_allocation(df, size).collect()} == audit
    total = sum(n.values())
    third = allocate(lambda ks, a: max(ks, key=lambda k: (round(n[k] / total - a[k] / target, 12), [-ord(c) for c in "".join(k)])))
    got = {(x.variety, x.audit_route, x.threshold_band): x.allocated for x in sampling.layer3_allocation(df, size, ("variety", "audit_route", "threshold_band")).collect()}
    assert sum(got.values()) == sum(third.values())


def test_take_and_blind(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("qid"), F.pmod("id", F.lit(3)).cast("string").alias("k"))
    alloc = spark.createDataFrame([("0", 5), ("1", 0), ("2", 300)], "k string, allocated long")
    got = sampling.take_allocated(df, alloc, ["k"], sampling.shuffled(1, "qid"))
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"0": 5, "2": 66}
    ids = sampling.sample_ids(got, "audit", sampling.shuffled(2, "qid"))
    assert sorted(r.sample_id for r in ids.collect())[:2] == ["audit_001", "audit_002"]
    one, two = ([r.sample_id for r in sampling.blinded(ids, ["sample_id"], ["human_label"], s).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) and one != two


def test_splits(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(f"q{i % 300}", int(r.random() < (0.3 + 0.4 * (i % 2))), i) for i in range(4195)], "question string, label int, i long")
    s = sampling.grouped_train_validation_test(df, "question", "label").cache()
    per = {x.split: x for x in s.groupBy("split").agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.count_distinct("question").alias("g")).collect()}
    assert s.select("question", "split").distinct().count() == 300 and {k: v.g for k, v in per.items()} == {"train": 180, "validation": 60, "test": 60}
    assert max(v.rate for v in per.values()) - min(v.rate for v in per.values()) < 0.06
    t = sampling.stratified_rows(df, "label", F.md5(F.col("i").cast("string")), "i").groupBy("split").count().collect()
    assert {x.split: x["count"] for x in t} == {"train": 3356, "validation": 839}
    assert sampling.first_groups(df, "question", "i", 2).select("question").distinct().count() == 2


def test_finalize(spark):
    c = spark.createDataFrame([("1", "أين يقع المسجد", "g", "وين المسجد", "كلام اخر تماما", "s"), ("2", "a b", "g", "c d", "a b", "s"), ("3", "a b", "g", "c d", "x y", "s")], "qid string, question_msa string, gold_answer string, dialect_candidate string, backtranslation_msa string, sub_variety string")
    sheet = spark.createDataFrame([("1", "REWRITE", "وين يقع المسجد", "5"), ("2", "", "", ""), ("3", "approve", "", "0"), ("9", "approve", "", "")], "qid string, APPROVE_or_REWRITE string, your_rewrite string, fluency_1_5 string")
    rows = translation.reviewed(c, sheet, 0.9)
    m = translation.finalize_metrics(rows, 0.9).first()
    assert (m.n_reviewed, m.n_unreviewed, m.rewrite_rate, m.n_filtered_out, m.n_final_benchmark, m.mean_fluency_1_5) == (2, 1, 0.5, 1, 1, 5.0)
    (f,) = translation.final_arm(rows, "gulf").collect()
    assert f.qid == "1" and f.provenance == "human_rewrite" and f.question_dialect == "وين يقع المسجد"


def test_routing(spark):
    rows = [("1", "msa", "direct", "m", "q", "gold text", "gold text here", "", 1), ("2", "msa", "direct", "m", "q", "gold", "", "timeout", 1), ("2", "msa", "direct", "m", "q", "gold", "other", "", 2), ("3", "msa", "direct", "m", "q", "gold", "a a a a", "", 1)]
    log = spark.createDataFrame(rows, "qid string, variety string, condition string, model string, question string, gold_answer string, answer string, error string, seq long")
    out = routing.layer2(routing.layer1(log, "seq"), routing.OverlapScorer(0.6), variant="gold_answer").cache()
    got = {r.qid: (r.layer1_decision, r.combined_decision, r.combined_label) for r in out.collect()}
    assert got == {"1": ("defer", "clean", 0), "2": ("defer", "factual_hallucination", 1), "3": ("degeneration", "degeneration", None)}
    assert all(r.ok for r in routing.check_scored(log, out).collect())


class Flaky:
    calls = 0

    def __call__(self, model, turns, tokens):
        if model == "dead":
            raise RuntimeError("x" * 500)
        return turns[-1]["content"].upper()


def test_generation(spark):
    items = spark.createDataFrame([("1", "msa"), ("1", "gulf")], "qid string, variety string")
    p = generation.plan(items, ["m", "dead"], ["direct", "msa_answer"])
    assert p.count() == 6
    todo = p.filter("condition = 'direct'").withColumn("messages", generation.messages("s", F.col("qid"))).withColumn("pivot_messages", F.when(F.col("variety") == "gulf", generation.messages("s", F.lit("pivot"))))
    got = generation.generate(todo, Flaky, retries=2, wait=0).collect()
    ok = {(r.model, r.variety): (r.answer, r.pivot_question, len(r.error)) for r in got}
    assert ok["m", "msa"] == ("1", "", 0) and ok["m", "gulf"] == ("PIVOT", "PIVOT", 0) and ok["dead", "msa"] == ("", "", 300)
    log = spark.createDataFrame([(r.qid, r.variety, r.condition, r.model, r.answer, r.error) for r in got], "qid string, variety string, condition string, model string, answer string, error string")
    assert generation.remaining(p.filter("condition = 'direct'"), generation.done_keys(log)).count() == 2
    seen = []

    def short(model, turns, tokens):
        seen.append(tokens)
        return "" if tokens < 4096 else "done"

    assert generation.call(short, "m", [], sleep=lambda s: None) == ("done", "m") and seen == [2048, 4096]


def test_variants(spark):
    df = spark.createDataFrame([("answer_only", 0.8, 0.5), ("gold_answer", 0.85, 0.5), ("question_gold_answer", 0.9, 0.4)], "variant string, validation_roc_auc double, validation_f1 double")
    assert training.rank_variants(df).filter("selected").first().variant == "question_gold_answer"
    for bad in (df.limit(2), df.withColumn("test_f1", F.lit(1.0))):
        with pytest.raises(ValueError):
            training.rank_variants(bad)
    with pytest.raises(ValueError):
        training.guard_test({"test_metrics": {"f1": 1}}, "x", df, df, "variant")


def test_epochs(spark):
    ev = spark.createDataFrame([(1, 0.995, 0.5, None), (2, 1.0, None, 0.4), (3, 1.0, 0.3, None), (4, 2.5, 0.2, None), (5, None, 9.0, None)], "seq int, epoch double, loss double, eval_loss double")
    got = {r.epoch: (r.train_loss, r.validation_loss) for r in training.epoch_rows(ev, "seq").collect()}
    assert got == {1.0: (0.3, 0.4), 2.5: (0.2, None)}


def test_folds_summary(spark):
    df = spark.createDataFrame([(0.1,), (0.3,)], "accuracy double")
    r = agreement.fold_summary(df, ["accuracy"]).first()
    assert (r.accuracy_mean, r.accuracy_std) == pytest.approx((0.2, 0.1414213))


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/log.csv").write_bytes('﻿qid,answer\n1,"two\nlines, ""quoted"""\n2,\n'.encode())
    (tmp_path / "b").mkdir()
    (tmp_path / "b/log.csv").write_text("qid,answer,extra\n3,x,y\n")
    paths = readers.find(spark, str(tmp_path), "log.csv")
    got = {r.qid: (r.answer, r.extra, r.analysis_run) for r in readers.many(spark, paths).collect()}
    assert got == {"1": ('two\nlines, "quoted"', "", "a"), "2": ("", "", "a"), "3": ("x", "y", "b")}
    m = readers.manifest(spark, str(tmp_path)).cache()
    assert readers.verify_manifest(m, m).count() == 0 and m.count() == 2
    bad = m.withColumn("sha256", F.lit("0"))
    assert {r.problem for r in readers.verify_manifest(m, bad).collect()} == {"sha256"}
    log = spark.createDataFrame([("1", "x")], "qid string, answer string")
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"), ["qid", "answer"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_log(log.select("qid"), str(tmp_path / "log"), ["qid", "answer"])
    assert sinks.json_summary(log, str(tmp_path / "s.json")) == {"qid": "1", "answer": "x"}
    seed = spark.createDataFrame([("1", "q", "g"), ("2", "q", "g")], "qid string, question_msa string, gold_answer string")
    assert readers.benchmark(seed, {"gulf": None}, limit=1).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.benchmark(None, {})
    ex = spark.createDataFrame([("a", "b", "", 1), ("a", "", "x", 2), ("c", "d", "sub", 3)], "msa_question string, dialect_question string, sub_variety string, i int")
    p, sub = readers.exemplars(ex, "i")
    assert p.count() == 2 and sub == "x"
    j = readers.judge_rows(spark.createDataFrame([("q2", "a", "1", 1), ("q1", "b", "0", 2), ("q2", "", "1", 3)], "question string, answer string, hallucinated string, i int"), "i")
    assert sorted((r.question, r.group_id, r.label) for r in j.collect()) == [("q1", 1, 0), ("q2", 0, 1)]


def test_stream(spark, tmp_path):
    from tarsus.streaming import log

    schema = "qid string, variety string, condition string, model string, seq long, ok boolean, ts timestamp"
    rows = [("1", "msa", "direct", "m", 1, False), ("1", "msa", "direct", "m", 2, True), ("1", "msa", "direct", "m", 3, False)]
    for k, r in enumerate(rows):
        spark.createDataFrame([(*r, None)], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    q = log.merge_canonical(log.read_log(spark, str(tmp_path / "in"), schema, 1), F.col("ok"), "seq", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    (r,) = log.read_canonical(spark, str(tmp_path / "out"), "seq").collect()
    assert r.seq == 2
    log.compact(spark, str(tmp_path / "out"), str(tmp_path / "one"), "seq")
    assert log.read_canonical(spark, str(tmp_path / "one"), "seq").collect() == [r]
    w = log.attempts(log.read_log(spark, str(tmp_path / "in"), schema), F.col("ok"), "ts")
    assert w.isStreaming


def test_char_grams(spark):
    got = spark.createDataFrame([("Ab  cde",)], "t string").select(training.char_grams(F.col("t"), 3, 4)).first()[0]
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "])


class _AtMost(training.TextMetric):
    """Says how many pairs it was given at once."""

    def load(self):
        return lambda a, b: [float(len(a)) for _ in a]


def test_metric_sees_few_texts_at_a_time(spark):
    d = spark.range(0, 1000, 1, 1).select(F.col("id"), F.lit("x").alias("a"), F.when(F.col("id") % 10 > 0, "y").otherwise(" ").alias("b"))
    got = training.metric_column(d, _AtMost(), "a", "b", "m").collect()
    assert len(got) == 1000 and all((r.m is None) == (r.id % 10 == 0) for r in got)
    assert max(r.m for r in got if r.m) <= 256
