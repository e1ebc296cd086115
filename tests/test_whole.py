"""Queries that use whole texts and all rows, on small tables of their own."""

import os
import re

import pytest

from tarsus.operators import paired, training
from tarsus.plans import adapters, catalogue

from .oracle import SMALL

tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def conversations(spark, folder, rows):
    """Writes the table: (conv_id, turn, text), even turns are the user's."""
    t = [(c, n, "assistant" if n % 2 else "user", x) for c, n, x in rows]
    spark.createDataFrame(t, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_whole_texts(spark, tmp_path):
    same = "the same opening " * 10  # over 120 characters
    pairs = [(same + "left", same + "another end"), ("سؤال طويل", "جواب"), ("", ""), (None, "x"), ("A b", "a  B!")]
    d = conversations(spark, tmp_path, [(i, k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)])
    norm = lambda x: re.sub(r"[^\w]+", " ", x or "").strip().lower()
    want = {i: round(levenshtein(norm(a), norm(b)) / max(1, len(norm(a)), len(norm(b))), 6) for i, (a, b) in enumerate(pairs)}
    assert {r.conv_id: r.distance for r in catalogue.QUERIES["edit_distance"](spark, d).collect()} == want
    assert want[0] > 0


def test_every_turn_pair_is_checked(spark, tmp_path):
    from .oracle import same

    d = conversations(spark, tmp_path, [(c, n, f"text {c} of turn {n} here") for c in range(7) for n in range(2 * c + 2)])
    n = sum(c + 1 for c in range(7))
    q = {k: catalogue.QUERIES[k](spark, d) for k in ("qc_flags", "qc_summary", "qc_flag_counts", "finalize_filter", "finalize_metrics", "final_arm", "validation_sheet", "echo_generation")}
    for k in ("qc_flags", "finalize_filter", "echo_generation"):
        got = [r.qid for r in q[k].collect()]
        assert len(got) == n and set(got) == {f"{c}-{2 * k}" for c in range(7) for k in range(c + 1)}
    assert q["qc_summary"].first().n == n
    for k in ("finalize_metrics",):
        r = q[k].first()
        assert r.n_reviewed + r.n_unreviewed == n
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    for k in set(q) & set(catalogue.ORACLE_SQL):
        same(q[k], c, catalogue.ORACLE_SQL[k])


@tables
def test_layer3_samples_every_dialect(spark):
    g = {r.variety: r.n for r in adapters.canonical_generations(spark, SMALL).groupBy("variety").agg({"*": "count"}).toDF("variety", "n").collect() if r.variety not in (None, "msa")}
    rows = catalogue.QUERIES["layer3_sample"](spark, SMALL).collect()
    assert set(g) == {"gulf", "egyptian", "levantine", "sudanese"}
    assert {v: sum(r.variety == v for r in rows) for v in g} == {v: min(150, n) for v, n in g.items()}
    assert len({r.sample_id for r in rows}) == len(rows) and all(r.sample_id.startswith(r.variety + "_") for r in rows)


@tables
def test_all_iterations_and_folds(spark, monkeypatch):
    want = paired.bootstrap_exact(catalogue.pairs_of(spark, SMALL), iterations=2000)
    assert sorted(map(tuple, catalogue.QUERIES["bootstrap_ci_sequential"](spark, SMALL).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(training, "tfidf_fold", lambda d, train, test: d.agg({"doc_id": "count"}))
    assert [r.fold for r in catalogue.QUERIES["tfidf_cv"](spark, SMALL).collect()] == [0, 1, 2, 3, 4]


def test_scored_run_covers_whole_questions(spark, tmp_path):
    head, tail = " ".join(f"h{i}" for i in range(40)), " ".join(f"t{i}" for i in range(40))
    d = conversations(spark, tmp_path, [(0, 0, f"{head} {tail}"), (0, 1, tail), (1, 0, f"{head} {tail}"), (1, 1, head)])
    got = {r.qid: r.layer1_coverage for r in catalogue.QUERIES["scored_run"](spark, d).collect()}
    assert got == {"0-0": 0.5, "1-0": 0.5}
