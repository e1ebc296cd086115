"""Sinks: CSV tables, append logs with a header guard, JSON summaries, packets."""

from __future__ import annotations

import json as _json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file, through Hadoop as the tables: shared folders of any kind will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document."""
    return _json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def append_log(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append rows to a Parquet log whose columns must be as stated, in order."""
    if list(df.columns) != list(columns):
        raise ValueError(f"log columns are {list(columns)}, not {list(df.columns)}")
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).columns
    except Exception as e:  # noqa: BLE001 - a log that isn't there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = list(columns)
    if sorted(have) != sorted(columns):
        raise ValueError(f"the log at {path} has other columns: {have}")
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def json_summary(df: DataFrame, path: str, sort_keys: bool = False) -> dict:
    """A one-row table as an indented JSON document."""
    row = df.first()
    doc = row.asDict(recursive=True) if row else {}
    text(df.sparkSession, path, _json.dumps(doc, indent=2, ensure_ascii=False, sort_keys=sort_keys, default=str) + "\n")
    return doc


def json_and_csv(df: DataFrame, stem: str) -> None:
    """One small result as a JSON list and as CSV, computed once."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    text(df.sparkSession, f"{stem}.json", _json.dumps(rows, indent=2, ensure_ascii=False, default=str) + "\n")
    csv(df.sparkSession.createDataFrame(rows, df.schema) if rows else df.limit(0), f"{stem}.csv")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def packet(key: DataFrame, shown: Sequence[str], blank: Sequence[str], folder: str, seeds: Sequence[int], note: str) -> None:
    """A blinded packet: a private key, a sheet for each validator in an order of its own, and a note."""
    from ..operators.sampling import blinded

    csv(key, f"{folder}/key")
    for k, seed in enumerate(seeds):
        csv(blinded(key, shown, blank, seed).coalesce(1), f"{folder}/validator_{'abcdefgh'[k]}")
    text(key.sparkSession, f"{folder}/README.md", note)


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
