"""Token-id files (operator 4): Parquet with dictionary-encoded id lists, small row groups and page indexes."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, tokens
from .stats import mix

#: How the files are written: row groups of a few MB, pages of few rows with their index, dictionary-encoded ids.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}
#: Text bytes planned for one file, and files at most: beyond, files grow, and their row groups and pages don't.
FILE_BYTES, MOST_FILES = 24_000_000, 50_000
#: Cut points that one percentile aggregate gives, and its accuracy.
STEP, ACCURACY = 500, 10_000
SCHEMA = "bucket int, doc_id long, start long, n_tokens long, ids array<int>"


FIRST = -(1 << 63)


def _percentiles(col: str, n: int) -> Column:
    return F.percentile_approx(col, F.array(*(F.lit(k / n) for k in range(1, n))), F.lit(ACCURACY))


def bounds(ids: DataFrame, n_files: int, step: int = STEP) -> np.ndarray:
    """n_files - 1 ascending ids that part the rows (column doc_id) into about equal ranges; an id of many rows is there several times.

    Percentiles are exact to 53 bits: larger ids are parted nearly so, and one of them has one file.
    Beyond ``step`` files each of n_files / step ranges is parted by itself, in parallel.
    """
    if n_files < 2:
        return np.zeros(0, np.int64)
    ids = ids.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"))
    n = -(-n_files // step)
    top = np.sort(np.array(ids.agg(_percentiles("doc_id", n if n > 1 else n_files)).first()[0] or [], np.int64))
    if n < 2 or not len(top):
        return top

    def ranges(batches):
        for b in batches:
            yield common.batch(r=pa.array(np.searchsorted(top, b.column(0).to_numpy(), side="left").astype(np.int32)), doc_id=b.column(0))

    own = -(-n_files // n)
    fine = {r[0]: r[1] for r in ids.mapInArrow(ranges, "r int, doc_id long").groupBy("r").agg(_percentiles("doc_id", own)).collect()}
    cuts = [c for r in range(n) for c in [*fine.get(r, [int(top[min(r, n - 2)])] * (own - 1)), *top[r : r + 1].tolist()]]
    return np.sort(np.array(cuts, np.int64))


class Ranges:
    """The file of each row: ids between two cut points share one; an id that is several cut points has as many files, parted by the hash of its texts; rows of one text, at random."""

    def __init__(self, cuts: np.ndarray, heavy: dict[int, list[int]]):
        self.cuts, self.heavy = cuts, heavy

    def of(self, ids: np.ndarray, hashes: np.ndarray, turn: int) -> np.ndarray:
        at = np.searchsorted(self.cuts, ids, side="left")
        if self.heavy:
            random = mix(np.arange(turn, turn + len(ids), dtype=np.uint64))
            for i in np.flatnonzero(np.isin(ids, np.fromiter(self.heavy, np.int64))).tolist():
                inner = self.heavy[int(ids[i])]
                lo, hi = bisect.bisect_left(inner, int(hashes[i])), bisect.bisect_right(inner, int(hashes[i]))
                at[i] += lo + int(random[i]) % max(1, hi - lo)
        return at

    @classmethod
    def plan(cls, rows: DataFrame, n_files: int, step: int = STEP) -> Ranges:
        cuts = bounds(rows, n_files, step)
        ids, times = np.unique(cuts, return_counts=True)
        many = {int(i): int(m) for i, m in zip(ids, times) if m > 1}
        if not many:
            return cls(cuts, {})
        key = F.coalesce("doc_id", F.lit(FIRST))
        heavy = rows.select(key.alias("doc_id"), "hash").filter(F.col("doc_id").isin(*many)) if len(many) <= 1000 else rows.select(key.alias("doc_id"), "hash").join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in many], "doc_id long")), "doc_id")
        steps = 256
        out = {}
        for i, q in heavy.groupBy("doc_id").agg(_percentiles("hash", steps)).collect():  # a row for each id with several files
            q, m = [-(1 << 52), *sorted(q), 1 << 52], many[i]
            out[i] = [q[k * steps // m] + (q[min(steps, k * steps // m + 1)] - q[k * steps // m]) * (k * steps % m) // m for k in range(1, m)]
        return cls(cuts, out)


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> None:
    """Encode every whole text, append ``end``, and write the ids to ``path`` in ascending id order, a range of ids a file.

    Each row holds the list of ids and, in columns that can be read without it, the id, the
    number of ids and where they start in the file's run. Null texts are empty (only ``end``),
    null ids come first, rows of equal ids are ordered by a hash of their text. An id that a
    third of all rows share, or null, has as many files as its rows need. An empty table writes
    files without rows.
    """
    rows = common.two_columns(docs, id_col, text_col).select("doc_id", "text", F.shiftright(common.text_hash(), 11).alias("hash"))  # percentiles are exact to 53 bits
    if n_files is None:
        n_files = min(MOST_FILES, max(12, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)))
    planned = Ranges.plan(rows, n_files)
    n_files = len(planned.cuts) + 1
    ranges = rows.sparkSession.sparkContext.broadcast(planned)

    def encode(batches):
        turn = 0
        for b in batches:
            at = 0
            hashes = b.column(2).to_numpy()
            for ids, enc, kind in tokens.encoded([pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"])], tokenizer, end):
                own = hashes[at : at + len(ids)]
                file = ranges.value.of(ids.fill_null(FIRST).to_numpy(), own, turn)
                at, turn = at + len(ids), turn + len(ids)
                packed = enc if kind.itemsize == 2 else [np.frombuffer(e, kind).astype("<u4").tobytes() for e in enc]
                yield common.batch(bucket=pa.array(file, pa.int32()), doc_id=ids, wide=pa.array([kind.itemsize] * len(enc), pa.int32()), ids=pa.array(packed, pa.binary()), hash=pa.array(own))

    def lay_out(batches):
        run, bucket = 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            kind = np.dtype(f"<u{b.column(2)[0].as_py()}")
            lens = np.array([len(x) // kind.itemsize for x in b.column(3).to_pylist()], np.int64)
            own = b.column(0).to_numpy()
            start = np.zeros(n, np.int64)
            for k in dict.fromkeys(own.tolist()):
                sel = own == k
                if k != bucket:
                    run, bucket = 0, k
                ends = run + np.cumsum(lens[sel])
                start[sel], run = ends - lens[sel], int(ends[-1])
            flat = np.frombuffer(b"".join(b.column(3).to_pylist()), kind).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)], pa.int32()), pa.array(flat, pa.int32()))
            yield common.batch(bucket=b.column(0), doc_id=b.column(1), start=pa.array(start, pa.int64()), n_tokens=pa.array(lens, pa.int64()), ids=lists)

    packed = rows.mapInArrow(encode, "bucket int, doc_id long, wide int, ids binary, hash long")
    ordered = packed.repartitionById(n_files, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "hash", "ids")
    ordered.mapInArrow(lay_out, SCHEMA).write.options(**FORMAT).parquet(path)


def offsets(files: DataFrame) -> DataFrame:
    """(bucket, before): the ids in all earlier files, from the metadata columns; a row a file, so MOST_FILES at most."""
    per = files.groupBy("bucket").agg(F.sum("n_tokens").alias("total"))
    return per.select("bucket", (F.sum("total").over(W.orderBy("bucket")) - F.col("total")).alias("before"))


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Columns that aren't selected aren't read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    at = F.broadcast(offsets(files))  # at most MOST_FILES rows
    return files.join(at, "bucket").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(tokens_read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches):
        for b in batches:
            ids = b.column(3)
            raw = np.asarray(ids.values.to_numpy(zero_copy_only=False), "<u4").tobytes()
            ends = np.asarray(ids.offsets)
            out = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.diff(ends)
            yield common.batch(doc_id=b.column(0), start=b.column(1), n_tokens=pa.array(n, pa.int64()), ids_crc32=pa.array(out, pa.int64()))

    return tokens_read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
