"""Continuous ingest of append logs: a stream of attempts merged to one canonical row a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import KEY, canonical


#: The column that keeps whether an attempt succeeded.
OK = "__ok"


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def attempts(stream: DataFrame, success: Column, ts: str, keys: Sequence[str] = KEY, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Attempts and successes by key and window of event time; state older than the watermark is dropped."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), *keys)
    return w.agg(F.count("*").alias("attempts"), F.count_if(success).alias("successes"))


def merge_canonical(stream: DataFrame, success: Column, seq: str, target: str, checkpoint: str, keys: Sequence[str] = KEY, once: bool = True):
    """Append each batch's canonical rows to ``target`` as a version of its own; returns the query.

    The canonical row of a union is that of the parts' canonical rows, so a batch costs its own
    size only, and one that runs again overwrites its version. ``read_canonical`` merges versions.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        ok = batch.withColumn(OK, success)
        canonical(ok, F.col(OK), seq, keys).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_canonical(spark: SparkSession, target: str, seq: str, keys: Sequence[str] = KEY) -> DataFrame:
    """One row a key over all versions."""
    return canonical(spark.read.parquet(target).drop("version"), F.col(OK), seq, keys).drop(OK)


def compact(spark: SparkSession, target: str, into: str, seq: str, keys: Sequence[str] = KEY) -> None:
    """Write all versions as one into another folder, which may then take the place of the first."""
    canonical(spark.read.parquet(target).drop("version"), F.col(OK), seq, keys).write.parquet(f"{into}/version=0")
