"""Folders that every executor sees, for what a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or in local mode without it below a temporary one; deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tarsus-files-"))
            _drop_at_end(spark, f"file://{_local[0]}")
        root = f"file://{_local[0]}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _drop_at_end(spark, path)
    return path


def _drop_at_end(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
