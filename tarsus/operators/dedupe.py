"""One canonical row for each key of an append log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("qid", "variety", "condition", "model")


def last_wins(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The row with the largest ``order`` of each key; a partial aggregate, so a hot key is reduced before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order) if isinstance(order, str) else order).alias("best"))
    return best.select("best.*")


def succeeded(answer: Column, error: Column) -> Column:
    from ..functions.text import ws_trim

    return (ws_trim(F.coalesce(answer, F.lit(""))) != "") & (ws_trim(F.coalesce(error, F.lit(""))) == "")


def canonical(log: DataFrame, success: Column, seq: str, keys: Sequence[str] = KEY) -> DataFrame:
    """The latest successful attempt of each key, or the latest attempt if none succeeded."""
    return last_wins(log, keys, F.struct(success, F.col(seq)))


def group_ordinals(df: DataFrame, key: str, seq: str) -> DataFrame:
    """``group_id``: the ordinal of each key's first appearance (``seq`` is a number), from 0. Keys are ranked, not rows."""
    from .ranks import ranked

    first = df.groupBy(key).agg(F.min(seq).alias("__first"))
    ids = ranked(first, "__first", [F.col(key)], name="group_id").select(key, F.col("group_id").cast("int").alias("group_id"))
    return df.join(ids, key)
