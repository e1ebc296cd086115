"""What the corpus operators share: the shared folder, staged tables, and the block exchange.

The block exchange is how an operator asks a question about every distinct key of the corpus
without shuffling text. Text is staged once as *blocks* (rows of a few MB, all in one *group*
per written partition). Each block sends its distinct keys, packed, to key buckets; a bucket
sees all blocks that asked about its keys and answers each of them; requests and answers of many
blocks travel in one row; the answers are written by group, so the task that reads a group's blocks again finds its answers beside them. A key that
a third of all documents hold is sent once a block.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one block, about; a longer document is a block by itself.
BLOCK_BYTES = 2_000_000
#: Bytes of text for which one bucket of the exchange is planned.
BUCKET_BYTES = 24_000_000
#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 16 << 20
#: Partitions of an exchange at most: beyond, a partition has several buckets, one after another. Bytes of requests a task gathers before it sends them.
MOST_PARTITIONS, SEND_BYTES = 1 << 14, 8_000_000

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tarsus-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


_paths: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for this application only: it is deleted at its end, or by ``drop_staged``."""
    if not _paths:
        atexit.register(drop_staged)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _paths.add(path)
    return path


def staged() -> set[str]:
    """The folders that this application staged and hasn't deleted."""
    return set(_paths)


def drop_staged(since: Iterable[str] = (), but: Iterable[str] = ()) -> None:
    """Delete what was staged, but for what there was at some point and some folders. Tables that read it can't be used any more."""
    for path in staged() - set(since) - set(but):
        _paths.discard(path)
        drop_path(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the bare path of a URI or of a local path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def drop_path(path: str) -> None:
    fs, bare = filesystem(path)
    if fs.get_file_info(bare).type == pafs.FileType.Directory:
        fs.delete_dir(bare)


def stage(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd", large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: lineage is cut and survives lost executors.

    ``large_rows``: of megabytes. Their sizes are looked at after each row; by default Parquet looks after a hundred, so that
    row groups and pages, which the JVM holds whole, are of hundreds of MB.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    w = df.write.option("compression", codec).option("parquet.block.size", str((8 if large_rows else 16) << 20))
    if large_rows:
        w = w.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if they come in fewer partitions than there are cores, as those of a single small file do. Larger tables stay as they are."""
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df  # it has a shuffle, and to count its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most ARROW_BYTES, as both sides hold a batch at once; a setting of the session's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b", "67108864", "64m", "64mb", "64MB"):  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text, renamed: other columns can't clash with an operator's own."""
    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def text_hash(text_col: str = "text"):
    """A hash of the text, the same for null and empty: with the id it names a row when ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def match(docs: DataFrame, found: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """Join documents with rows of (doc_id, text_hash, ...) that an operator returned, whatever else the documents' columns are called.

    Null ids match null ids. ``once``: of documents with the same id and text only one stays;
    partitions drop theirs before the shuffle, so a row that a third of all are is one a partition.
    Without it such rows meet in one task.
    """
    top = F.lit((1 << 63) - 1)
    keys = ["__tarsus_id", "__tarsus_hash"]
    left = docs.withColumn(keys[0], F.coalesce(F.col(id_col).cast("long"), top)).withColumn(keys[1], text_hash(text_col))
    right = found.withColumnRenamed("text_hash", keys[1]).withColumn(keys[0], F.coalesce("doc_id", top)).drop("doc_id").dropDuplicates(keys)
    return (left.dropDuplicates(keys) if once else left).join(right, keys, how).drop(*keys)


def keep_rows(docs: DataFrame, verdict: Callable[[], Callable[[list[bytes]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows of which the verdict on their text is true, in one pass and without a shuffle; all columns stay, whatever they are called.

    ``verdict()`` is called once a task and gives a function from texts (null: empty) to booleans.
    """
    small_batches(docs.sparkSession)
    docs = spread(docs)
    at = docs.columns.index(text_col)

    def run(batches):
        judge = verdict()
        for b in batches:
            lo = 0
            for ids, raw in text_batches([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], ["doc_id", "text"])]):
                yield b.slice(lo, len(ids)).filter(pa.array(judge(raw)))
                lo += len(ids)

    return docs.mapInArrow(run, docs.schema)


def trim() -> None:
    """Give freed memory back to the system: a worker process waits for its next task beside its executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_batches(batches: Iterator[pa.RecordBatch], at_most: int = 2_000_000) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 bytes (null text: empty), in pieces of about ``at_most`` bytes, whole documents each."""
    for b in batches:
        ids, text = b.column(0), b.column(1).cast(pa.binary())
        n = len(text)
        if not n:
            continue
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        piece = (ends[1:] - ends[0]) // at_most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            yield ids.slice(lo, hi - lo), [t or b"" for t in text.slice(lo, hi - lo).to_pylist()]
    trim()


def batch(**columns) -> pa.RecordBatch:
    """A record batch from named arrays, in order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
    trim()


# ---- packed arrays ---------------------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """An unsigned array as byte planes, low bytes first; planes that are all zero are left out."""
    a = np.ascontiguousarray(a)
    cols = a.view(np.uint8).reshape(len(a), a.itemsize) if len(a) else np.zeros((0, a.itemsize), np.uint8)
    used = [k for k in range(a.itemsize) if cols[:, k].any()]
    return struct.pack("<QBB", len(a), a.itemsize, sum(1 << k for k in used)) + b"".join(cols[:, k].tobytes() for k in used)


def unplanes(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, size, used = struct.unpack_from("<QBB", b, at)
    at += 10
    out = np.zeros((n, size), np.uint8)
    for k in range(size):
        if used >> k & 1:
            out[:, k] = np.frombuffer(b, np.uint8, n, at)
            at += n
    return out.view(f"<u{size}").reshape(n), at


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    d, at = unplanes(b, at)
    return np.cumsum(d, dtype=np.uint64), at


def smallest(a: np.ndarray) -> np.ndarray:
    """The same non-negative values in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


# ---- block exchange --------------------------------------------------------------------


def buckets_for(n_bytes: int, least: int = 12) -> int:
    """A power of two, so that a bucket is a run of key prefixes; in proportion to the bytes."""
    want = max(least, -(-n_bytes // BUCKET_BYTES))
    return 1 << max(0, (want - 1).bit_length())


def split_sorted(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in ascending uint64 keys, with the end."""
    if n_buckets == 1:
        return np.array([0, len(keys)])
    shift = 64 - (n_buckets.bit_length() - 1)
    marks = np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(shift)
    return np.r_[0, np.searchsorted(keys, marks), len(keys)]


ASK = "bucket int, grp int, payload binary"
ANSWER = "grp int, bucket int, payload binary"


def framed(parts: list[tuple[int, bytes]]) -> bytes:
    return b"".join(x for n, p in parts for x in (struct.pack("<qQ", n, len(p)), p))


def unframed(b: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(b):
        n, size = struct.unpack_from("<qQ", b, at)
        yield n, b[at + 16 : at + 16 + size]
        at += 16 + size


def exchange(blocks: DataFrame, ask: Callable, answer: Callable, n_buckets: int, name: str) -> str:
    """Send each block's requests to buckets, and stage the answers by group.

    ``ask(row) -> iterator of (bucket, payload)`` for a block's row; ``answer(payloads) ->
    payloads`` for all requests of one bucket, in the same order, and perhaps one more, about
    the bucket, which is kept for group -1. Returns the folder of the answers. A task holds one
    bucket at a time: a partition has one, or beyond MOST_PARTITIONS a run of them, sorted.
    Requests are sorted by block, so answers are the same whenever a task is run again.
    """

    def asks(batches):
        held: dict[int, list] = {}
        grp, size = None, 0

        def send():
            k = sorted(held)
            return batch(bucket=pa.array(k, pa.int32()), grp=pa.array([grp] * len(k), pa.int32()), payload=pa.array([framed(held[x]) for x in k], pa.binary()))

        for row in read_rows(batches):
            if held and (row["grp"] != grp or size > SEND_BYTES):
                yield send()
                held, size = {}, 0
            grp = row["grp"]
            for k, p in ask(row):
                held.setdefault(k, []).append((row["block"], p))
                size += len(p) + 100
        if held:
            yield send()

    def answered(k: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        out: dict[int, list] = {}
        for (i, g, _), x in zip([*rows, (-1, -1, b"")], answer([p for _, _, p in rows])):
            out.setdefault(g, []).append((i, x))
        return batch(grp=pa.array(list(out), pa.int32()), bucket=pa.array([k] * len(out), pa.int32()), payload=pa.array([framed(x) for x in out.values()], pa.binary()))

    def answers(batches):
        now, rows = None, []
        for b in batches:
            for k, g, p in zip(*(c.to_pylist() for c in b.columns)):
                if k != now and rows:
                    yield answered(now, rows)
                    rows = []
                now = k
                rows.extend((i, g, x) for i, x in unframed(p))
        if rows:
            yield answered(now, rows)
        trim()

    n_parts = min(n_buckets, MOST_PARTITIONS)
    asked = blocks.mapInArrow(asks, ASK).withColumn("part", F.shiftright("bucket", (n_buckets // n_parts).bit_length() - 1)).repartitionById(n_parts, "part").drop("part")
    if n_parts < n_buckets:
        asked = asked.sortWithinPartitions("bucket")
    got = asked.mapInArrow(answers, ANSWER)
    n_groups = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    path = stage(got.repartition(max(n_groups, n_parts), "grp"), name, partition_by="grp")[1]
    del asked, got
    release(blocks.sparkSession)
    return path


def bucket_notes(spark: SparkSession, path: str) -> DataFrame:
    """(payload): what the buckets of an exchange noted about themselves."""
    return spark.read.schema("bucket int, payload binary, grp int").parquet(path).filter("grp = -1").select("payload")


class Answers:
    """The answers of one group after another, read from the shared folder by the task that has its blocks."""

    def __init__(self, path: str):
        self.path, self.grp, self.by = path, None, {}

    def of(self, grp: int, block: int) -> dict[int, bytes]:
        if grp != self.grp:
            self.grp, self.by = grp, {}
            fs, bare = filesystem(f"{self.path}/grp={grp}")
            if fs.get_file_info(bare).type == pafs.FileType.Directory:
                for f in fs.get_file_info(pafs.FileSelector(bare)):
                    if f.path.endswith(".parquet"):
                        t = pq.ParquetFile(fs.open_input_file(f.path)).read(columns=["bucket", "payload"])
                        for k, x in zip(*(c.to_pylist() for c in t.columns)):
                            for i, p in unframed(x):
                                self.by.setdefault(i, {})[k] = p
        return self.by.get(block, {})
