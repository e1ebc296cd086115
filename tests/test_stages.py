"""Whole stages on small files."""

import csv
import json
import random

from pyspark.sql import functions as F

from tarsus.operators.routing import OverlapScorer
from tarsus.plans import stages
from tarsus.sources import readers


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return str(path)


def log(n=40):
    r = random.Random(0)
    out = []
    for v in ("msa", "gulf"):
        for q in range(n):
            gold = f"gold answer {q}"
            out.append({"qid": str(q), "variety": v, "condition": "direct", "model": "m", "family": "f", "question": f"question {q}", "gold_answer": gold, "answer": r.choice([f"question {q} " + gold, "something else", "x x x x x", ""]), "error": ""})
    return out + [dict(out[0], answer="question 0 gold answer 0")]


def test_scoring_to_audit(spark, tmp_path):
    p = put(tmp_path / "run1/log.csv", log())
    one = stages.run_layer1(spark, p, str(tmp_path / "l1"))
    assert one.count() == 80
    two = stages.run_layer2(spark, str(tmp_path / "l1"), str(tmp_path / "l2"), OverlapScorer(0.5))
    assert {r[0] for r in two.select("combined_decision").distinct().collect()} == {"clean", "factual_hallucination", "degeneration"}
    t = stages.run_analysis(spark, [str(tmp_path / "l2")], str(tmp_path / "analysis"), iterations=50)
    (r,) = t.collect()
    assert r.n_paired_total == 40 and r.dialect == "gulf" and r.hds_ci_low <= r.hds <= r.hds_ci_high
    assert json.loads((tmp_path / "analysis.json").read_text())[0]["dialect"] == "gulf"
    key = stages.prepare_audit(spark, [str(tmp_path / "l2")], str(tmp_path / "audit"), size=20)
    assert key.count() == 20 and readers.csv(spark, str(tmp_path / "audit/validator_a")).select("human_label").distinct().collect()[0][0] == ""
    stages.prepare_layer3(spark, str(tmp_path / "l2"), str(tmp_path / "l3"), size=10)
    k = readers.csv(spark, str(tmp_path / "audit/key"))
    filled = k.select("sample_id", F.col("combined_decision").alias("human_label"))
    for n in "ab":
        filled.write.option("header", True).csv(str(tmp_path / f"sheet_{n}"))
    s, m = stages.evaluate_packet(spark, str(tmp_path / "audit/key"), (str(tmp_path / "sheet_a"), str(tmp_path / "sheet_b")))
    s = s.first()
    assert (s.n_double, s.raw_agreement, s.consensus_accuracy, s.inter_annotator_kappa) == (20, 1.0, 1.0, 1.0) and all(x.f1 == 1.0 for x in m.collect())


def test_rescore_all(spark, tmp_path):
    put(tmp_path / "in/run1/log.csv", log(5))
    put(tmp_path / "in/run2/log.csv", log(5))
    out = str(tmp_path / "out")
    assert set(stages.rescore_all(spark, str(tmp_path / "in"), out, OverlapScorer())) == {"run1", "run2"}
    assert stages.rescore_all(spark, str(tmp_path / "in"), out, OverlapScorer()) == {}


def test_translation(spark, tmp_path):
    c = put(tmp_path / "c.csv", [{"qid": str(i), "question_msa": f"a b {i}", "gold_answer": "g", "dialect_candidate": f"x y {i}", "backtranslation_msa": f"a b {i}" if i else "", "sub_variety": "s"} for i in range(4)])
    assert stages.run_check(spark, c, str(tmp_path / "v")).first().n == 4
    v = put(tmp_path / "v.csv", [{"qid": str(i), "APPROVE_or_REWRITE": "A" if i else "", "your_rewrite": "", "fluency_1_5": "4"} for i in range(4)])
    m = stages.run_finalize(spark, c, v, str(tmp_path / "final"), str(tmp_path / "m.json"), "gulf")
    assert m["n_reviewed"] == 3 and m["acceptance_rate"] == 1.0 and readers.csv(spark, str(tmp_path / "final")).count() == 3
    assert stages.run_translation_scores(spark, c, str(tmp_path / "s")).first().n == 4
    a = spark.createDataFrame([("1", "Quality: 4\nFluency: 3\nCoherence: 2\nUnderstandability: 1"), ("2", "no")], "qid string, raw_response string")
    r = stages.run_judge(spark, a, str(tmp_path / "j")).first()
    assert r.mean_quality == 4.0 and r.n_failed == 1


def test_reports(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"epoch": 0.999, "loss": 0.5}, {"epoch": 1.0, "eval_f1": 0.8}, {"step": 3}]}))
    (r,) = stages.training_report(spark, str(tmp_path / "state.json"), str(tmp_path / "e")).collect()
    assert (r.epoch, r.train_loss, r.validation_f1) == (1.0, 0.5, 0.8)
    df = spark.createDataFrame([(1, 0.9, "1"), (0, 0.2, "0"), (1, 0.4, "0")], "label int, probability double, T string")
    one, tags = stages.evaluate_test(df, 0.5, ["T"])
    assert one.first().tp == 1 and one.first().roc_auc == 1.0 and tags.first().recall == 1.0


def test_the_latest_attempt_is_that_of_the_later_file(spark, tmp_path):
    """Spark packs files by size; the order of a log is that of its files' names."""
    one = dict(log(1)[0], answer="first")
    put(tmp_path / "log/a.csv", [one])
    put(tmp_path / "log/b.csv", [dict(one, qid=str(100 + i), answer="filler " * 200) for i in range(50)] + [dict(one, answer="second")])
    rows = stages.run_layer1(spark, str(tmp_path / "log"), str(tmp_path / "out")).filter("qid = '0'").collect()
    assert [r.answer for r in rows] == ["second"]
    put(tmp_path / "other/z.csv", [dict(one, answer="third")])
    rows = stages.run_layer1(spark, [str(tmp_path / "log"), str(tmp_path / "other")], str(tmp_path / "out2")).filter("qid = '0'").collect()
    assert [r.answer for r in rows] == ["third"]


def test_adjudication_takes_the_place_of_agreement(spark, tmp_path):
    sheet = lambda name, labels: put(tmp_path / name, [{"sample_id": str(i), "human_label": x} for i, x in enumerate(labels)])
    key = put(tmp_path / "key.csv", [{"sample_id": str(i), "combined_decision": x} for i, x in enumerate(["clean", "clean", "degeneration", "factual_hallucination", "clean"])])
    a, b = sheet("a.csv", ["0", "0", "2", "1", ""]), sheet("b.csv", ["0", "1", "2", "1", "0"])
    s, _ = stages.evaluate_packet(spark, key, (a, b))
    s = s.first()
    assert (s.n_keyed, s.n_double, s.n_agree, s.n_requires_adjudication, s.n_consensus, s.n_right, s.automatic_vs_consensus_kappa) == (5, 4, 3, 1, 3, 3, 1.0)
    s, m = stages.evaluate_packet(spark, key, (a, b), sheet("j.csv", ["", "1", "1", "", "0"]))
    s = s.first()
    assert (s.n_consensus, s.n_right, s.consensus_accuracy) == (2, 0, 0.0)  # rows 1 and 2 alone; row 4 lacks a label
    assert {r.label: r.support for r in m.collect()} == {"clean": 0, "factual_hallucination": 2, "degeneration": 0}
    s, _ = stages.evaluate_packet(spark, key, (sheet("c.csv", ["0", "0", "?", "1", "h"]), sheet("d.csv", ["0", "1", "0", "1", "h"])), classes=False)
    s = s.first()
    x, y, z = [0, 0, 1, 1], [0, 1, 1, 1], [0, 0, 1, 0]
    kappa = lambda p, q: (sum(i == j for i, j in zip(p, q)) / len(p) - (e := sum(p) * sum(q) / len(p) ** 2 + (1 - sum(p) / len(p)) * (1 - sum(q) / len(q)))) / (1 - e)
    assert abs(s.inter_annotator_kappa - kappa(x, y)) < 1e-12 and abs(s.automatic_vs_a_kappa - kappa(z, x)) < 1e-12 and abs(s.automatic_vs_b_kappa - kappa(z, y)) < 1e-12
    assert abs(s.automatic_vs_consensus_kappa - kappa([0, 1, 0], [0, 1, 1])) < 1e-12


class Talk:
    """A client: it fails for questions with 'bad', else repeats the number of turns and the last."""

    def __call__(self, model, turns, tokens):
        if "bad" in turns[-1]["content"]:
            raise RuntimeError("refused")
        return f"{len(turns)}:{turns[-1]['content']}", f"{model}-x"


def test_generate_and_translate(spark, tmp_path):
    import pytest

    from tarsus.functions import prompts

    items = spark.createDataFrame([("1", "gulf", "q1", "g"), ("1", "msa", "q1", "g"), ("2", "gulf", "bad", "g")], "qid string, variety string, question string, gold_answer string")
    out = str(tmp_path / "log")
    stages.run_generate(spark, items, {"m": {"model_id": "org/m", "family": "f"}}, ("direct", "msa_answer", "msa_pivot"), out, Talk)
    got = {(r.qid, r.variety, r.condition): r for r in stages.run_generate(spark, items.filter("qid = '1'"), {"m": {"model_id": "org/m"}}, ("direct",), out, Talk).collect()}
    assert len(got) == 8 and ("1", "msa", "msa_answer") not in got
    assert got["1", "gulf", "direct"].answer == "1:q1" and got["1", "gulf", "msa_answer"].answer == "2:q1"
    p = got["1", "gulf", "msa_pivot"]
    assert (p.pivot_question, p.answer, p.pivot_model_id, p.resolved_model_id, p.family) == ("2:q1", "2:2:q1", "org/m-x", "org/m-x", "f")
    assert got["2", "gulf", "direct"].error == "refused" and got["2", "gulf", "direct"].answer == ""
    again = stages.run_generate(spark, items, {"m": {}}, ("direct",), out, Talk)  # only the failed one is asked again
    assert again.filter("qid = '2' and condition = 'direct'").count() == 2 and again.count() == 9

    seed = put(tmp_path / "seed.csv", [{"qid": str(i), "question_msa": f" q{i} ", "gold_answer": "g"} for i in range(5)])
    shots = put(tmp_path / "shots.csv", [{"msa_question": "a", "dialect_question": "b", "sub_variety": ""}, {"msa_question": "c", "dialect_question": "", "sub_variety": "Najdi"}])
    log_ = str(tmp_path / "candidates")
    t = stages.run_translate(spark, seed, shots, log_, "gulf", Talk, "m", limit=2).collect()
    assert sorted((r.qid, r.dialect_candidate, r.backtranslation_msa, r.sub_variety, r.n_exemplars) for r in t) == [("0", "4:q0", "2:4:q0", "Najdi", "1"), ("1", "4:q1", "2:4:q1", "Najdi", "1")]
    assert stages.run_translate(spark, seed, shots, log_, "gulf", Talk, "m").count() == 5
    with pytest.raises(ValueError, match="another setup"):
        stages.run_translate(spark, seed, shots, log_, "gulf", Talk, "m", temperature=0.7)
    with pytest.raises(ValueError, match="exemplars"):
        stages.run_translate(spark, seed, put(tmp_path / "none.csv", [{"msa_question": "a", "dialect_question": ""}]), log_, "gulf", Talk, "m")
    w = prompts.Translation()
    assert "CODA" in w.translator("gulf", "Najdi") and "Najdi Gulf Arabic" in w.translator("gulf", "Najdi") and "CODA" not in w.translator("gulf", coda=False)


def test_training_to_one_test(spark, tmp_path):
    import pytest

    r = random.Random(4)
    rows = []
    for i in range(240):
        bad = r.random() < 0.5
        rows.append({"question": f"question {i // 3}", "gold_answer": f"gold {i % 7}", "answer": " ".join(r.choice(["wrong", "odd", "made"] if bad else ["right", "true", "plain"]) for _ in range(6)), "hallucinated": str(int(bad)), "sample_index": str(i // 3)})
    rows.append(dict(rows[0], answer=" "))
    data = put(tmp_path / "judge.csv", rows)
    root = str(tmp_path / "judges")
    small = stages.training.TfidfTrainer(1, 500)
    for v in ("answer_only", "gold_answer"):
        meta = stages.train_judge(spark, data, f"{root}/{v}", v, small)
        ids = [set(meta[f"{p}_group_ids"]) for p in ("train", "validation", "test")]
        assert sum(map(len, ids)) == 80 and not ids[0] & ids[1] | ids[0] & ids[2] | ids[1] & ids[2]
        assert meta["test_metrics"] is None and meta["validation_metrics"]["roc_auc"] > 0.95 and sum(meta[f"n_{p}"] for p in ("train", "validation", "test")) == 240
    sheet = readers.csv(spark, f"{root}/gold_answer/validation_predictions")
    assert sheet.columns == ["row_index", "sample_index", "question", "gold_answer", "answer", "gold_label", "hallucination_probability", "predicted_label"] and sheet.count() == meta["n_validation"]
    chosen = stages.select_variant(spark, root, str(tmp_path / "selection.json"), ("answer_only", "gold_answer"))
    assert chosen["winner"] in chosen["ranking"] and len(chosen["ranking"]) == 2
    other = put(tmp_path / "other.csv", rows[:-2])
    with pytest.raises(ValueError, match="data differ"):
        stages.evaluate_test_once(spark, other, f"{root}/gold_answer", small)
    m = stages.evaluate_test_once(spark, data, f"{root}/gold_answer", small)
    assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == meta["n_test"] and m["accuracy"] > 0.9
    with pytest.raises(ValueError, match="before"):
        stages.evaluate_test_once(spark, data, f"{root}/gold_answer", small)
    with pytest.raises(ValueError, match="before a variant"):
        stages.select_variant(spark, root, str(tmp_path / "selection.json"), ("answer_only", "gold_answer"))
    best = stages.train_variants(spark, data, str(tmp_path / "variants"), trainer=small)
    assert best["answer_only_auc"] > 0.95 and best["winner"] in ("answer_only", "gold_answer")
    smoke = stages.train_judge(spark, data, str(tmp_path / "smoke"), "answer_only", small, smoke_groups=5)
    assert smoke["smoke_test"] and [len(smoke[f"{p}_group_ids"]) for p in ("train", "validation", "test")] == [5, 5, 5]


def test_answers_against_labels_are_not_numbered_in_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "_numbered", None)
    rows = [("q1", "g", "fine", "0"), ("q1", "g", "a a a a", "1"), ("q2", "g", " ", "1"), ("q3", "g", "漢字かな a a a a", "1")]
    stages.sinks.csv(spark.createDataFrame(rows, "question string, gold_answer string, answer string, hallucinated string"), f"{tmp_path}/data")
    got = stages.evaluate_layer1(spark, f"{tmp_path}/data", f"{tmp_path}/out.json")
    assert (got["n"], got["n_resolved"], got["n_deferred"]) == (3, 0, 3) and got["reasons"] == {"foreign_script_heavy": 1, "heavy_repetition": 2}
