"""Term counts for cross-validation against the pipeline that is fitted fold by fold."""

import random

from pyspark.sql import functions as F

from tarsus.operators import grams, sampling, training


def table(spark):
    r = random.Random(3)
    said = ["", "a", "Ａb c", "naïve ﬁn", "x_1  y", "سؤال طويل", "漢字 かな", "be or not to be"]
    rows = [(i, f"s{i % 9}", None if i == 50 else " ".join(r.choice((f"w{r.randrange(40)}", f"Q{i % 2}z{r.randrange(6)}", r.choice(said))) for _ in range(r.randrange(0, 40))), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, label int")


def test_features_are_those_of_the_pipeline(spark):
    t = table(spark)
    d = t.join(sampling.grouped_folds(t, "source", "label", 3, 1), "source")
    found = training._fold_features(grams.tokens(d), 3, 2, 60_000)
    for k in range(3):
        rows = training.weighted(d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__chars", training.char_grams(F.col("text"))), False)
        model = training.tfidf_pipeline().fit(rows.filter(F.col("fold") != k))
        want = {r.doc_id: (sorted(round(float(v), 9) for v in r.features.toArray() if v), r.features.size) for r in model.transform(rows).select("doc_id", "features").collect()}
        got = {r.doc_id: (sorted(round(float(v), 9) for v in r.features.toArray() if v), r.features.size) for r in found[k].select("doc_id", "features").collect()}
        assert got == want


def test_texts_are_not_cut_anew_for_every_fold(spark, monkeypatch):
    monkeypatch.setattr(training, "tfidf_pipeline", None)
    monkeypatch.setattr(training, "char_grams", None)
    rows = training.tfidf_cv(table(spark), "source", 3).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all(0 <= r.accuracy <= 1 for r in rows)
