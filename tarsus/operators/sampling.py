"""Stratified samples, blinded sheets and leakage-safe splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks


def shuffled(seed: int, *cols: str) -> Column:
    """A reproducible random order that doesn't depend on partitions, and that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def _slots(strata: DataFrame, cost: Column, ties: list[Column], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Allocate ``size`` rows (in each group of ``by``) to strata (with n) one by one, always at the least cost: the same as taking the cheapest slots.

    A stratum has slots 0 to n - 1 (at most ``size``); ``cost`` may use i, n, target and total.
    With at least as many rows as strata, each gets its first slot beforehand.
    """
    all_ = W.partitionBy(*by)
    t = strata.withColumns({"total": F.sum("n").over(all_), "k": F.count("*").over(all_)})
    t = t.withColumn("target", F.least(F.lit(size).cast("long"), "total")).withColumn("seeded", F.col("target") >= F.col("k"))
    s = t.filter("target > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "target") - 1)))
    first = F.col("seeded") & (F.col("i") == 0)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.when(first, 0).otherwise(1), cost, *ties, "i"))
    chosen = s.withColumn("r", rank).filter("r <= target")
    return chosen.groupBy(*strata.columns).agg(F.count("*").alias("allocated"))


def audit_allocation(strata: DataFrame, size: int, variety: str = "variety", route: str = "audit_route", band: str = "threshold_band") -> DataFrame:
    """Rows for each (variety, route, band): evenly by filled share, those near the threshold first on ties."""
    far = F.when(F.col(band) == "near_0.05", 0).otherwise(1)
    return _slots(strata, F.round(F.col("i") / F.least("n", "target"), 12), [far, F.col(variety), F.col(route), F.col(band)], size)


def layer3_allocation(strata: DataFrame, size: int, keys: Sequence[str] = ("model", "decision", "route"), first_seen: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows for each stratum in proportion to its share: the one furthest below its share is next; ``size`` in each group of ``by``."""
    return _slots(strata, -F.round(F.col("n") / F.col("total") - F.col("i") / F.col("target"), 12), [F.col(first_seen)] if first_seen else [F.col(k) for k in keys], size, by)


def take_allocated(rows: DataFrame, allocation: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first ``allocated`` rows of each stratum in the given order. The allocation has at most as many rows as the sample."""
    j = rows.join(F.broadcast(allocation.select(*keys, "allocated")), list(keys)).withColumn("__o", order)
    return ranks.first_rows(j, keys, [F.col("__o")], F.col("allocated")).drop("__o", "allocated")


def sample_ids(rows: DataFrame, prefix: str | Column, order: Column, by: Sequence[str] = ()) -> DataFrame:
    """``sample_id``: prefix and a three-digit number in the given order."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(order))
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return rows.withColumn("sample_id", F.concat(p, F.lit("_"), F.lpad(n.cast("string"), 3, "0")))


def blinded(keyed: DataFrame, shown: Sequence[str], blank: Sequence[str], seed: int) -> DataFrame:
    """A validator's sheet: the shown columns, empty columns to fill in, in an order of its own."""
    return keyed.select(*shown, *(F.lit("").alias(b) for b in blank)).orderBy(shuffled(seed, "sample_id"))


def first_groups(df: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct groups, by first appearance."""
    first = df.groupBy(key).agg(F.min(seq).alias("__first")).orderBy("__first").limit(n).select(key)
    return df.join(F.broadcast(first), key, "left_semi")


def first_rows(df: DataFrame, by: Sequence[str], seq: str, n: int) -> DataFrame:
    return ranks.first_rows(df, by, [F.col(seq)], n)


def grouped_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): groups never cross folds, label counts are balanced.

    Groups are ordered by their share of positives and by size with a seeded tie break, and
    dealt in a serpentine; a ranking of groups, not of rows.
    """
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    g = ranks.ranked(g.withColumn("share", F.col("pos") / F.col("n")), "share", [F.desc("n"), shuffled(seed, group)], name="r", descending=True)
    at = F.pmod("r", F.lit(folds))
    lap = F.pmod(F.floor(F.col("r") / folds), F.lit(2))
    turn = F.when(lap == 0, at).otherwise(folds - 1 - at)
    return g.select(group, turn.cast("int").alias("fold"))


def grouped_train_validation_test(df: DataFrame, group: str, label: str, seed: int = 42) -> DataFrame:
    """Rows with ``split``: outer fold 0 of 5 is the test, inner fold 0 of 4 of the rest the validation."""
    outer = grouped_folds(df, group, label, 5, seed).withColumnRenamed("fold", "__outer")
    d = df.join(outer, group)
    inner = grouped_folds(d.filter("__outer <> 0"), group, label, 4, seed + 1).withColumnRenamed("fold", "__inner")
    split = F.when(F.col("__outer") == 0, "test").when(F.col("__inner") == 0, "validation").otherwise("train")
    return d.join(inner, group, "left").withColumn("split", split).drop("__outer", "__inner")


def stratified_rows(df: DataFrame, label: str, order: Column, tie: str, share: float = 0.8) -> DataFrame:
    """Rows with ``split``: the first ``share`` of each label's rows are for training. Rows of a group may part.

    ``order`` is a hexadecimal hash; its first digits, as a number, are ranked by bucket.
    """
    d = df.withColumn("__h", order).withColumn("__o", F.conv(F.substring("__h", 1, 12), 16, 10).cast("long"))
    d = ranks.ranked(d, "__o", [F.col("__h"), F.col(tie)], [label], "__r")
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    return d.join(n, label).withColumn("split", F.when(F.col("__r") < F.round(F.col("__n") * share), "train").otherwise("validation")).drop("__r", "__n", "__h", "__o")
