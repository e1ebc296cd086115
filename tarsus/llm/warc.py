"""WARC archives (operator 1): a writer with revisit records and a splittable reader."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this are never revisits; bytes of a split; bytes before a split in which its task finds its step; bytes read at once.
LEAST, SPLIT, LOOK, READ = 100, 16 << 20, 2 << 20, 1 << 20
#: Pages of equal payload to one salt of the join that tells them which page they repeat.
SALTED = 100_000
MAGIC = b"\x1f\x8b\x08"
_ID = re.compile(rb"<urn:x-page:(-?\d+|null)>")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- writing ---------------------------------------------------------------------------


def _member(headers: list[tuple[bytes, bytes]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own."""
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in headers) + b"Content-Length: %d\r\n\r\n" % len(block)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 3) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    digest = hashlib.sha256(payload).hexdigest().encode()
    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or b"urn:x-none"
    name = lambda x: b"<urn:x-page:" + (b"null" if x is None else b"%d" % x) + b">"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [(b"WARC-Type", b"response" if refers_to is None else b"revisit"), (b"WARC-Record-ID", name(page_id)), (b"WARC-Target-URI", uri), (b"WARC-Date", b"1970-01-01T00:00:00Z"), (b"WARC-Payload-Digest", b"sha256:" + digest), (b"WARC-Payload-Length", b"%d" % len(payload)), (b"Content-Type", b"application/http; msgtype=response")]
    if refers_to is not None:
        headers += [(b"WARC-Refers-To", name(refers_to)), (b"WARC-Profile", PROFILE)]
    return _member(headers, http + (payload if refers_to is None else b""), level)


def first_seen(pages: DataFrame, least: int = LEAST, salted: int = SALTED) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an earlier page has, payloads of ``least`` bytes and more.

    Only ids and digests are shuffled. A payload that a third of all pages share is one group
    that is pre-aggregated; its id then goes back over as many salts as it has ``salted`` pages.
    """
    d = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("p")).filter(F.octet_length("p") >= least).select("page_id", F.sha2("p", 256).alias("digest"))
    d, _ = common.stage(d, "digests")
    first, _ = common.stage(d.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").withColumn("salts", F.ceil(F.col("n") / salted)), "payloads")
    spread = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    hot = first.filter("salts > 1").select("digest", "salts")  # at most a row for each ``salted`` pages
    again = d.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1)))).join(spread, ["digest", "salt"])
    return again.filter("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = LEAST, level: int = 3) -> DataFrame:
    """Write a record a page to gzip WARC files below ``path``; returns the manifest (path, length, records), staged.

    Of pages with equal payloads of ``least`` bytes or more that with the smallest page_id is
    the response, the others revisit it. A null html is an empty payload; a null url has a
    placeholder; a null page_id is kept and counts as the largest. Rows that repeat the
    smallest page_id with the same payload are responses too. Files are written under another
    name and renamed, so a task that runs twice leaves one file. An empty table gives no files.

    What is joined to the pages is a row for each revisit, by id and digest. Spark broadcasts it
    if it is small; else the pages, payloads included, are shuffled once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again, _ = common.stage(first_seen(rows, least), "revisits")
    again = again.withColumnRenamed("page_id", "again_id")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256) == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        t = TaskContext.get()
        fs, base = common.filesystem(path)
        name, n, size, out = f"part-{t.partitionId():06d}.warc.gz", 0, 0, None
        tmp = f"{base}/_writing-{name}-{t.taskAttemptId()}"
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(tmp)
                m = record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, level)
                out.write(m)
                n, size = n + 1, size + len(m)
        if out is not None:
            out.close()
            fs.move(tmp, f"{base}/{name}")
            yield common.batch(path=pa.array([f"{path}/{name}"]), length=pa.array([size], pa.int64()), records=pa.array([n], pa.int64()))

    return common.stage(joined.mapInArrow(save, "path string, length long, records long"), "manifest")[0]


# ---- reading ---------------------------------------------------------------------------


class _Window:
    """Bytes of a file from any position, read ahead a piece at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buf = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.buf):
            want = min(max(n, READ), max(0, self.size - at))
            self.at, self.buf = at, self.f.read_at(want, at) if want > 0 else b""
        return self.buf[at - self.at : at - self.at + n]


def _member_at(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at a position and where the member ends; None if there is no whole WARC member."""
    z, out, start = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = w.get(at, 65536)
            if not piece:
                return None
            got = z.decompress(piece)
            at += len(piece)
            out.append(got)
            if start + 65536 >= at and not b"".join(out).startswith(b"WARC/1."[: len(b"".join(out))]):
                return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, at - len(z.unused_data)) if data.startswith(b"WARC/1.") else None


def _next_member(w: _Window, at: int, end: int) -> int | None:
    """The first position from ``at`` and before ``end`` where the gzip magic begins a member that decodes, checksum included, to a WARC record."""
    while at < end:
        piece = w.get(at, min(65536, end - at) + len(MAGIC) - 1)
        i = piece.find(MAGIC)
        if i < 0:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += i
        if at >= end:
            return None
        if _member_at(w, at):
            return at
        at += 1
    return None


def members(f, size: int, start: int, end: int, look: int = LOOK) -> Iterator[tuple[int, bytes]]:
    """(position, record) of the members that start in [start, end); the last may reach beyond.

    Members follow one another; between them anything that isn't one is passed over. A record
    stored in another one isn't a member, though it decodes: to tell, a task starts ``look``
    bytes before its range and goes from member to member into it. So what is found doesn't
    depend on where the ranges part, but for records that lie inside one of more than ``look`` bytes.
    """
    w = _Window(f, size)
    at = _next_member(w, max(0, start - look), end)
    while at is not None and at < end:
        got = _member_at(w, at)
        if got is None:
            at = _next_member(w, at + 1, end)
            continue
        if at >= start:
            yield at, got[0]
        at = got[1] if got[1] < size else None


def parse(data: bytes) -> dict:
    """Headers and payload of a record. A revisit's length and digest are those it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        h[k.strip().lower()] = v.strip()
    block = rest[: int(h.get(b"content-length", b"0"))]
    payload = block.partition(b"\r\n\r\n")[2] if h.get(b"content-type", b"").startswith(b"application/http") else block
    kind = h.get(b"warc-type", b"").decode("ascii", "replace")
    name = lambda k: (m := _ID.fullmatch(h.get(k, b""))) and (None if m[1] == b"null" else int(m[1]))
    again = kind == "revisit"
    return {
        "page_id": name(b"warc-record-id"), "url": h.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "record_type": kind, "payload": None if again else payload,
        "payload_bytes": int(h.get(b"warc-payload-length", b"0")) if again else len(payload),
        "payload_digest": h.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("ascii", "replace") if again else hashlib.sha256(payload).hexdigest(),
        "refers_to": name(b"warc-refers-to") if again else None,
    }


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of archives below a folder or matching a glob, by Spark's own listing; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read(files: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of gzip WARC files (path, length), a task for ranges of about ``split`` bytes.

    Each task owns the records that start inside its ranges, wherever they end: page_id, url,
    record_type, payload (binary, null for revisits; only if wanted), payload_bytes,
    payload_digest, refers_to, path, position. Damaged members, and bytes between members, are
    passed over; the records around them are read, wherever the ranges part. An empty table of
    files gives no rows.
    """
    spark = files.sparkSession
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    n = max(1, min(100_000, int(files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1)))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, path string, position long" + ", payload binary" * payload

    def run(batches):
        for r in common.read_rows(batches):
            fs, bare = common.filesystem(r["path"])
            with fs.open_input_file(bare) as f:
                out, held = [], 0
                for at, data in members(f, r["length"], r["start"], min(r["start"] + split, r["length"])):
                    out.append(parse(data) | {"path": r["path"], "position": at})
                    held += len(data) if payload else 1000
                    if held > 8 << 20:
                        yield _rows(out, payload)
                        out, held = [], 0
                if out:
                    yield _rows(out, payload)

    return ranges.repartition(max(n, spark.sparkContext.defaultParallelism), "path", "start").mapInArrow(run, schema)


def _rows(out: list[dict], payload: bool) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = {"page_id": long, "url": text, "record_type": text, "payload_bytes": long, "payload_digest": text, "refers_to": long, "path": text, "position": long} | ({"payload": pa.binary()} if payload else {})
    return common.batch(**{k: pa.array([o[k] for o in out], t) for k, t in kinds.items()})
