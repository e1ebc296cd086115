"""Ranks and running sums over any number of rows, without sorting them in one task.

Rows fall into buckets of about equal numbers, by quantiles of a numeric order. Only bucket totals,
at most BUCKETS a key, are summed in one place; the rest happens inside the buckets. The
quantiles are one aggregation of the order column, made when the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets at most, and the accuracy of their bounds.
BUCKETS, ACCURACY = 500, 10_000


def with_bucket(df: DataFrame, order: str, name: str = "__bucket", buckets: int = BUCKETS) -> DataFrame:
    """A bucket number that never falls as ``order`` rises; nulls come first. Equal values share a bucket."""
    from pyspark.ml.feature import Bucketizer

    x = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(x, F.array(*(F.lit(k / buckets) for k in range(1, buckets))), F.lit(ACCURACY))).first()[0]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return df.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(0))
    found = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__order", outputCol="__at").transform(df.withColumn("__order", F.coalesce(x, F.lit(0.0))))
    return found.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(F.col("__at").cast("int"))).drop("__order", "__at")


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], ties: Sequence[Column] = (), descending: bool = False) -> DataFrame:
    """For each name of ``sums`` a column with the sum over all earlier rows of the key (0 for the first)."""
    way = F.desc if descending else F.asc
    b = with_bucket(df, order).withColumns({f"__v_{n}": c for n, c in sums.items()})
    totals = b.groupBy(*keys, "__bucket").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    earlier = W.partitionBy(*keys).orderBy(way("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "__bucket"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    j = b.alias("b").join(before.alias("t"), cond).select("b.*", *(f"t.__b_{n}" for n in sums))
    inside = W.partitionBy(*keys, "__bucket").orderBy(way(order), *ties).rowsBetween(W.unboundedPreceding, -1)
    out = j.withColumns({n: F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def ranked(df: DataFrame, order: str, ties: Sequence[Column] = (), keys: Sequence[str] = (), name: str = "rank", descending: bool = False) -> DataFrame:
    """``name``: the rank from 0 of each row of a key."""
    return running(df, keys, order, {name: F.lit(1)}, ties, descending)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: Column | int, keep: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key: every partition first keeps its own first ones, so that a hot key sends few rows on."""
    d = df.withColumn("__part", F.spark_partition_id())
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order))).filter(F.col("__r") <= n)
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n)
    return (d.withColumn(keep, F.col("__r")) if keep else d).drop("__part", "__r")
