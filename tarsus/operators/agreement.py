"""Agreement and classifier metrics as single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from . import ranks


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def kappa_binary(df: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two 0/1 raters; 1 or 0 where chance alone agrees fully, null of no rows."""
    l, r = F.col(left).cast("double"), F.col(right).cast("double")
    t = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(left) == F.col(right)).cast("int")).alias("raw_agreement"), F.avg(l).alias("__l"), F.avg(r).alias("__r"))
    pe = F.col("__l") * F.col("__r") + (1 - F.col("__l")) * (1 - F.col("__r"))
    k = F.when(F.abs(1 - pe) < 1e-12, F.when(F.abs(F.col("raw_agreement") - 1) < 1e-12, 1.0).otherwise(0.0)).otherwise((F.col("raw_agreement") - pe) / (1 - pe))
    return t.withColumn("kappa", F.when(F.col("n") > 0, k)).drop("__l", "__r")


def confusion_counts(df: DataFrame, truth: str, predicted: str, classes: Sequence = CLASSES) -> DataFrame:
    """One row: n_<truth>__<predicted> for each pair of classes, and n."""
    cells = [F.count_if((F.col(truth) == a) & (F.col(predicted) == b)).alias(f"n_{a}__{b}") for a in classes for b in classes]
    return df.agg(F.count("*").alias("n"), *cells)


def kappa_multi(df: DataFrame, left: str, right: str, classes: Sequence = CLASSES) -> DataFrame:
    t = confusion_counts(df.filter(F.col(left).isin(*classes) & F.col(right).isin(*classes)), left, right, classes)
    cell = lambda a, b: F.col(f"n_{a}__{b}")
    right_ones = sum((cell(c, c) for c in classes[1:]), cell(classes[0], classes[0]))
    return t.select("n", F.try_divide(right_ones, F.col("n")).alias("raw_agreement"), _kappa(cell, F.col("n"), classes).alias("kappa"))


def class_metrics(df: DataFrame, truth: str, predicted: str, classes: Sequence = CLASSES) -> DataFrame:
    """A row a class: support, precision, recall, f1 (0 on empty denominators); accuracy, and macro and weighted means over all classes."""
    t = confusion_counts(df, truth, predicted, classes)
    cell = lambda a, b: F.col(f"n_{a}__{b}")
    total = lambda cs: sum(cs[1:], cs[0])
    rows, by, supports = [], {"precision": [], "recall": [], "f1": []}, []
    for c in classes:
        support, named, hit = total([cell(c, b) for b in classes]), total([cell(a, c) for a in classes]), cell(c, c)
        p, r = _ratio(hit, named), _ratio(hit, support)
        f1 = _ratio(2 * p * r, p + r)
        for n, v in zip(by, (p, r, f1)):
            by[n].append(v)
        supports.append(support)
        rows.append(F.struct(F.lit(str(c)).alias("label"), support.alias("support"), p.alias("precision"), r.alias("recall"), f1.alias("f1")))
    means = [c for n, v in by.items() for c in ((total(v) / len(classes)).alias(f"macro_{n}"), _ratio(total([x * w for x, w in zip(v, supports)]), total(supports)).alias(f"weighted_{n}"))]
    out = t.select("n", _ratio(total([cell(c, c) for c in classes]), F.col("n")).alias("accuracy"), *means, F.explode(F.array(*rows)).alias("m"))
    return out.select("m.*", "accuracy", *(f"{k}_{n}" for n in by for k in ("macro", "weighted")))


def _kappa(cell, n: Column, classes: Sequence) -> Column:
    """Cohen's kappa of counted cells; 1 or 0 where chance alone agrees fully, null of no rows."""
    total = lambda cs: sum(cs[1:], cs[0])
    po = F.try_divide(total([cell(c, c) for c in classes]), n)
    pe = total([F.try_divide(total([cell(c, b) for b in classes]), n) * F.try_divide(total([cell(a, c) for a in classes]), n) for c in classes])
    return F.when(n > 0, F.when(F.abs(1 - pe) < 1e-12, F.when(F.abs(po - 1) < 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)))


def agreement_summary(keyed: DataFrame, a: DataFrame, b: DataFrame, adjudicated: DataFrame | None = None, truth: str = "predicted", classes: Sequence = CLASSES) -> DataFrame:
    """One row for a packet, from one aggregation: coverage of double labels, agreement and four kappas, and the pipeline against people.

    ``keyed`` (sample_id, predicted), ``a``, ``b`` and ``adjudicated`` (sample_id, label). Rows
    with both labels count. What people say is the label both gave; with ``adjudicated`` it is the
    adjudicated label of the rows that have one, and of those alone. Kappas are between the
    raters, the pipeline and each rater, and the pipeline and the label both gave.
    """
    one = lambda d, n: d.filter("label is not null").select("sample_id", F.col("label").alias(n))
    j = keyed.join(one(a, "label_a"), "sample_id", "left").join(one(b, "label_b"), "sample_id", "left")
    j = j.join(one(adjudicated, "label_j"), "sample_id", "left") if adjudicated is not None else j
    x, y, said = F.col("label_a"), F.col("label_b"), F.col(truth)
    both = x.isNotNull() & y.isNotNull()
    same = both & (x == y)
    human = F.when(both, F.col("label_j")) if adjudicated is not None else F.when(same, x)
    sides = {"raters": (both, x, y), "a": (both, said, x), "b": (both, said, y), "agreed": (same, said, x)}
    cells = [F.count_if(ok & (l == p) & (r == q)).alias(f"{n}__{p}__{q}") for n, (ok, l, r) in sides.items() for p in classes for q in classes]
    t = j.agg(F.count("*").alias("n_keyed"), F.count_if(both).alias("n_double"), F.count_if(same).alias("n_agree"), F.count_if(human.isNotNull()).alias("n_consensus"), F.count_if(human == said).alias("n_right"), *cells)
    kappas = {}
    for n, name in zip(sides, ("inter_annotator_kappa", "automatic_vs_a_kappa", "automatic_vs_b_kappa", "automatic_vs_consensus_kappa")):
        cell = lambda p, q, n=n: F.col(f"{n}__{p}__{q}")
        kappas[name] = _kappa(cell, F.col("n_agree" if n == "agreed" else "n_double"), classes)
    return t.select(
        "n_keyed", "n_double", "n_agree", (F.col("n_double") - F.col("n_agree")).alias("n_requires_adjudication"), "n_consensus", "n_right",
        F.try_divide("n_double", "n_keyed").alias("coverage"), F.try_divide("n_agree", "n_double").alias("raw_agreement"), F.try_divide("n_right", "n_consensus").alias("consensus_accuracy"), *(c.alias(n) for n, c in kappas.items()),
    )


def binary_metrics(df: DataFrame, label: str, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and accuracy, precision, recall, f1 (0 on empty denominators) by group."""
    y = F.col(label)
    t = df.withColumn("__p", predicted.cast("int")).groupBy(*keys).agg(*(F.count_if((y == a) & (F.col("__p") == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return t.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)})


def threshold_sweep(df: DataFrame, label: str, score: str, low: float = 0.05, high: float = 0.95, steps: int = 181) -> DataFrame:
    """Metrics at ``steps`` thresholds, from one pass.

    Rows are first counted by the number of thresholds they reach, so nothing is multiplied by
    the thresholds; running sums over those at most ``steps`` + 1 counts give each confusion.
    """
    width = (high - low) / (steps - 1)
    reached = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(score) - low) / width + 1e-9))).cast("int")
    c = df.groupBy(reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("k")).join(c, "k", "left").na.fill(0)
    above, all_ = W.orderBy("k").rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy()
    g = grid.select("k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(all_).alias("__p"), F.sum("neg").over(all_).alias("__n")).filter("k >= 0")
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("__p") - F.col("tp"), F.col("__n") - F.col("fp")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return g.select(F.round(low + F.col("k") * width, 6).alias("threshold"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of largest f1; of equals that nearest 0.5, then the lowest."""
    t = F.col("threshold")
    return sweep.agg(F.min_by("threshold", F.struct(-F.round("f1", 12), F.round(F.abs(t - 0.5), 9), t)).alias("threshold"), F.max("f1").alias("f1"))


def ranked_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives by distinct score: what rank metrics need, pre-aggregated."""
    return df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with half credit for ties."""
    c = ranks.running(ranked_counts(df, label, score, keys), keys, score, {"__below": F.col("neg")})
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision at distinct scores, highest first."""
    n = F.col("pos") + F.col("neg")
    c = ranks.running(ranked_counts(df, label, score, keys), keys, score, {"__tp": F.col("pos"), "__all": n}, descending=True)
    share = (F.col("__tp") + F.col("pos")) / (F.col("__all") + n)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * share), F.sum("pos")).alias("average_precision"))


def tag_recall(df: DataFrame, tags: Sequence[str], predicted: Column) -> DataFrame:
    """For each tag: rows that have it, and the share of them predicted positive (null of none). One pass, then unpivoted."""
    aggs = [x for i, t in enumerate(tags) for x in (F.count_if(F.col(f"`{t}`").cast("string") == "1").alias(f"n{i}"), F.count_if((F.col(f"`{t}`").cast("string") == "1") & predicted).alias(f"h{i}"))]
    rows = F.array(*(F.struct(F.lit(t).alias("tag"), F.col(f"n{i}").alias("n"), F.try_divide(F.col(f"h{i}"), F.col(f"n{i}")).alias("recall")) for i, t in enumerate(tags)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n_c), as balanced training weighs classes."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    return c.select(label, "n", (F.sum("n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("n"))).alias("weight"))


def fold_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over folds."""
    return df.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def router_against_labels(df: DataFrame, decision: str, label: str) -> DataFrame:
    """Share of rows a router resolved, and its accuracy on those, against human labels."""
    known = F.col(decision).isin("clean", "hallucinated", "factual_hallucination")
    said = (F.col(decision) != "clean").cast("int")
    t = df.agg(F.count("*").alias("n"), F.count_if(known).alias("n_resolved"), *(F.count_if(known & (F.col(label) == a) & (said == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))
    return t.withColumns({"resolution_rate": F.try_divide("n_resolved", "n"), "accuracy_on_resolved": F.try_divide(F.col("tp") + F.col("tn"), F.col("n_resolved"))})
