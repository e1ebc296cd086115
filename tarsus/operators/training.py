"""Classifier development: baseline pipeline, selection, guarded evaluation, and training reports."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import agreement, grams, sampling

EPOCH_FIELDS = {"loss": "train_loss", "learning_rate": "learning_rate", "grad_norm": "grad_norm", **{f"eval_{m}": f"validation_{m}" for m in ("loss", "accuracy", "precision", "recall", "f1", "roc_auc")}}
VARIANTS = ("answer_only", "gold_answer", "question_gold_answer")


class Judge(Protocol):
    """A fitted classifier: rows (with text) get a column ``probability``; it is saved to and loaded from a folder."""

    def score(self, rows: DataFrame) -> DataFrame: ...

    def save(self, path: str) -> None: ...


class Trainer(Protocol):
    """Fits a judge on rows with text, label and weight. Transformers aren't installed here; TfidfTrainer stands in for them."""

    def fit(self, train: DataFrame, validation: DataFrame) -> Judge: ...

    def load(self, path: str) -> Judge: ...


class TfidfJudge:
    def __init__(self, model) -> None:  # noqa: ANN001
        self.model = model

    def score(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = self.model.transform(rows.withColumn("__chars", char_grams(F.col("text"))))
        return p.select(*rows.columns, vector_to_array("probability")[1].alias("probability"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


class TfidfTrainer:
    """The tf-idf baseline as a trainer."""

    def __init__(self, min_df: int = 2, size: int = 60_000) -> None:
        self.min_df, self.size = min_df, size

    def fit(self, train: DataFrame, validation: DataFrame) -> TfidfJudge:  # noqa: ARG002 - it has no epochs to choose from
        return TfidfJudge(tfidf_pipeline(self.min_df, self.size).fit(train.withColumn("__chars", char_grams(F.col("text")))))

    def load(self, path: str) -> TfidfJudge:
        from pyspark.ml import PipelineModel

        return TfidfJudge(PipelineModel.load(path))


def judge_text(rows: DataFrame, variant: str) -> DataFrame:
    """Rows with ``text``: what a judge of this variant sees of question, gold_answer and answer."""
    from ..functions.labels import judge_input

    pair = judge_input(variant, F.col("question"), F.col("gold_answer"), F.col("answer"))
    return rows.withColumn("text", F.trim(F.concat_ws("\n", pair["context"], pair["answer"])))


def weighted(rows: DataFrame, balanced: bool) -> DataFrame:
    """Rows with ``weight``: that of their class, or 1."""
    return rows.join(F.broadcast(agreement.class_weights(rows, "label").select("label", "weight")), "label") if balanced else rows.withColumn("weight", F.lit(1.0))


class TextMetric(Protocol):
    """A learned similarity (BERTScore, BARTScore, a sentence encoder): None where it isn't installed."""

    def load(self) -> object | None: ...


def metric_column(df: DataFrame, metric: TextMetric, left: str, right: str, name: str, rows: int = 256) -> DataFrame:
    """A column of a learned metric, null where the metric can't be loaded or a side is blank; one load a task, ``rows`` pairs at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        fn = metric.load()
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):  # the other columns pass as they are, and few texts are Python's at a time
                b = whole.slice(lo, rows)
                pairs = list(zip(b.column(left).to_pylist(), b.column(right).to_pylist()))
                ok = [i for i, (x, y) in enumerate(pairs) if (x or "").strip() and (y or "").strip()] if fn is not None else []
                out = [None] * len(pairs)
                if ok:
                    for i, v in zip(ok, fn([pairs[i][0] for i in ok], [pairs[i][1] for i in ok])):
                        out[i] = None if v is None or v != v else float(v)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def char_grams(c, low: int = 3, high: int = 5):
    """Character n-grams inside words padded with a space, as an array column."""
    padded = F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int):
        return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n))))))

    return F.concat(*map(of, range(low, high + 1)))


def tfidf_pipeline(min_df: int = 2, size: int = 60_000):
    """Word 1-2-grams and character 3-5-grams, each tf-idf with unit length, into a logistic regression with weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer, VectorAssembler

    stages = [SQLTransformer(statement="SELECT *, filter(split(lower(text), '[^\\\\p{L}\\\\p{N}_]+'), w -> length(w) > 1) AS __w FROM __THIS__"), SQLTransformer(statement="SELECT *, concat(__w, transform(filter(sequence(1, greatest(size(__w) - 1, 1)), i -> i < size(__w)), i -> concat(__w[i - 1], ' ', __w[i]))) AS __words FROM __THIS__")]
    for name in ("__words", "__chars"):
        stages += [CountVectorizer(inputCol=name, outputCol=f"{name}_tf", minDF=min_df, vocabSize=size), IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf"), Normalizer(inputCol=f"{name}_idf", outputCol=f"{name}_v")]
    stages += [VectorAssembler(inputCols=["__words_v", "__chars_v"], outputCol="features"), _logistic()]
    return Pipeline(stages=stages)


def _logistic():
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="label", weightCol="weight", maxIter=50, regParam=0.0005)


def tfidf_fold(rows: DataFrame, train, test) -> DataFrame:
    """accuracy, f1 and roc_auc of the baseline on one fold; rows have label and features."""
    from pyspark.ml.functions import vector_to_array

    model = _logistic().fit(weighted(rows.filter(train), True))
    p = model.transform(rows.filter(test)).select("label", vector_to_array("probability")[1].alias("p")).persist()  # read by every metric; released with the session
    m = agreement.binary_metrics(p, "label", F.col("p") >= 0.5).select("accuracy", "precision", "recall", "f1")
    return m.crossJoin(agreement.roc_auc(p, "label", "p"))  # two single rows


def tfidf_cv(rows: DataFrame, group: str, folds: int = 5, seed: int = 42, min_df: int = 2, size: int = 60_000) -> DataFrame:
    """A row a fold, groups kept whole. The features of ``tfidf_pipeline``, from terms that are counted for all folds at once."""
    f = sampling.grouped_folds(rows, group, "label", folds, seed)
    # the join by group may leave all texts of a few groups in one partition
    d = grams.tokens(rows.join(f, group).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))
    out = None
    for k, features in enumerate(_fold_features(d, folds, min_df, size)):
        one = tfidf_fold(features, F.col("fold") != k, F.col("fold") == k).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _fold_features(d: DataFrame, folds: int, min_df: int, size: int) -> list[DataFrame]:
    """For each fold all rows with the features of its training rows' vocabulary and document frequencies."""
    import numpy as np

    stats = grams.statistics(d, folds).persist()
    n = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}
    kept = [[grams.vocabulary(stats, folds, k, kind, min_df, size) for kind in "wc"] for k in range(folds)]
    stats.unpersist()
    terms = sorted({t for both in kept for one in both for t, _ in one})
    number = {t: i for i, t in enumerate(terms)}
    counted = grams.counts(d, terms).persist()  # every fold reads all of it; it is released with the session
    out = []
    for k, (words, chars) in enumerate(kept):
        at, weight = np.full(len(terms), -1, np.int32), np.zeros(len(terms))
        rows = sum(v for f, v in n.items() if f != k)
        for i, (t, df) in enumerate([*words, *chars]):
            at[number[t]], weight[number[t]] = i, np.log((rows + 1) / (df + 1))
        out.append(grams.vectors(counted, at, weight, len(words), len(words) + len(chars)))
    return out


def rank_variants(summaries: DataFrame, required: Sequence[str] = VARIANTS) -> DataFrame:
    """(variant, validation_roc_auc, validation_f1) ranked; an error if a variant is missing or test metrics are shown."""
    shown = [c for c in summaries.columns if c.startswith("test_")]
    if shown:
        raise ValueError(f"test metrics must not be seen before a variant is chosen: {shown}")
    from pyspark.sql import Window as W

    have = summaries.agg(F.array_sort(F.collect_set("variant")).alias("v")).first()["v"]  # a handful of variants
    if have != sorted(required):
        raise ValueError(f"variants {have} instead of {sorted(required)}")
    order = [F.desc("validation_roc_auc"), F.desc("validation_f1"), F.desc("variant")]
    return summaries.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("selected", F.col("rank") == 1)


def same_rows(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables have the same set of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def guard_test(metadata: dict, data_sha256: str, test_ids: DataFrame, stated_ids: DataFrame, key: str) -> None:
    """A test set is used once, on the data and the split that the model was made with."""
    if metadata.get("test_metrics"):
        raise ValueError("this model was evaluated on its test set before")
    if metadata.get("data_sha256") != data_sha256:
        raise ValueError("the data differ from those the model was trained on")
    if not same_rows(test_ids, stated_ids, key):
        raise ValueError("the test split differs from the model's")


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("row_index", "sample_index", "question", "gold_answer", "answer", F.col("label").alias("gold_label"), F.round("probability", 8).alias("hallucination_probability"), (F.col("probability") >= threshold).cast("int").alias("predicted_label"))


def epoch_rows(events: DataFrame, seq: str, fields: dict[str, str] = EPOCH_FIELDS) -> DataFrame:
    """One row an epoch from a training log: later values replace earlier ones; epochs within 0.02 of a whole number are that."""
    e = F.col("epoch").cast("double")
    whole = F.bround(e)
    d = events.filter(e.isNotNull()).withColumn("epoch", F.when(F.abs(e - whole) < 0.02, whole).otherwise(F.bround(e, 6)))
    have = {k: v for k, v in fields.items() if k in events.columns}
    return d.groupBy("epoch").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col(seq))).alias(v) for k, v in have.items()))
