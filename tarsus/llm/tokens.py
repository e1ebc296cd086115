"""Word-wise encoding with public tokenizers, and token counting without ids (operator 7)."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .stats import Hashed

#: Chunks that a worker remembers, about 50 bytes each; others are encoded anew in each batch.
REMEMBER = 1_000_000
#: Pre-tokens broadcast with their counts, those of most documents first; the rest are joined by shuffle. Steps of a doubling by which they are ranked, and hash bins that part a step.
HEAD, STEPS, BINS = 300_000, 16, 4096
#: Distinct pre-tokens a task gathers before it hands them on.
GATHER = 1_000_000

#: What must be encoded with all that is around it: the beginning of a special token.
_ODD = re.compile(rb"<\|")


_ALNUM, _ENDING, _WHITE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz0123456789", b".,;:!?", b" \t\n\r\x0b\x0c"))


def part_punctuation(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts joined, a space behind each, with a space before every single punctuation mark that follows an ASCII letter or digit and ends a chunk; and their ends."""
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lens + 1)
    a = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if len(a) < 3:
        return a, ends
    mark = np.zeros(len(a), bool)
    mark[1:-1] = _ENDING[a[1:-1]] & _ALNUM[a[:-2]] & _WHITE[a[2:]]
    at = np.flatnonzero(mark)
    return np.insert(a, at, 32), ends + np.searchsorted(at, ends)


def same_bytes(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes from x on in ``a`` are those from y on in ``b``; no size is 0."""
    if not len(size):
        return np.zeros(0, bool)
    begin = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    return np.logical_and.reduceat(a[np.repeat(x - begin, size) + step] == b[np.repeat(y - begin, size) + step], begin)


class WordEncoder:
    """Ids of whole texts from remembered ids of their chunks, which ASCII white space separates.

    Right for a tokenizer that drops white space, whose pre-tokens never hold it, whose
    letters part from punctuation and that lower-cases: each chunk is then encoded by itself,
    in lower case, and so is a punctuation mark after it. Texts with the beginning of a special
    token are encoded whole. The tokenizer composes before it lower-cases, and J, H, T, W and Y
    have marks that compose with the small letter alone: texts with a character of U+0300 to
    U+037F keep their case. A tokenizer that fails probes of this is refused.

    Chunks are found by a hash and told apart by their bytes.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self._check()
        self.dtype = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.remember = remember
        #: Hashes of known chunks in order; for each where its bytes and its ids begin, and how many there are.
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros((4, 0), np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)

    def _check(self) -> None:
        """Raise unless the tokenizer does on probes what encoding by chunks relies on."""
        ids = lambda x: self.t.encode(x, add_special_tokens=False).ids
        for a, b in (("Alpha9 BETA", "alpha9 beta"), ("x, y. z! w?", "x , y . z ! w ?"), ("one  two\n\nthree\tfour\r\n", "one two three four"), (" lead", "lead"), ("tail ", "tail"), ("ÉTÉ", "été")):
            if ids(a) != ids(b):
                raise ValueError(f"this tokenizer tells {a!r} from {b!r}, so its texts can't be encoded by chunks")
        for w in ("alpha9 beta gamma-delta , . x.y it's 漢字 🙂 12345", "a b c d e f", "the theatre , the end ."):
            if ids(w) != [i for c in w.split() for i in ids(c)]:
                raise ValueError(f"tokens of this tokenizer cross white space in {w!r}")

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, joined, and how many each has."""
        got = [e.ids for e in self.t.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(n.sum())), n

    def _chunks(self, a: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks of ``a``: where their ids begin in a table of ids, how many there are, and the table."""
        raw = a.tobytes()
        texts = lambda at: [raw[x : x + y] for x, y in zip(begin[at].tolist(), size[at].tolist())]
        u, first, place = np.unique(Hashed(a).of(begin, begin + size), return_index=True, return_inverse=True)
        same = size == size[first][place]
        same[same] = same_bytes(a, begin[same], a, begin[first][place][same], size[same])
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        known = self.keys[at] == u if len(self.keys) else np.zeros(len(u), bool)
        taken = known.copy()
        known[known] = size[first][known] == self.at[1][at[known]]
        known[known] = same_bytes(a, begin[first][known], self.bytes, self.at[0][at[known]], size[first][known])
        fresh = np.flatnonzero(~known)
        ids, count = self._encode(texts(first[fresh]))
        start, many = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        start[known], many[known] = self.at[2][at[known]], self.at[3][at[known]]
        start[fresh], many[fresh] = len(self.ids) + np.cumsum(count) - count, count
        table = np.concatenate([self.ids, ids])
        if len(new := fresh[: max(0, self.remember - len(self.keys))]) and not taken[new].any():
            n, m = size[first[new]], count[: len(new)]
            rows = np.stack([len(self.bytes) + np.cumsum(n) - n, n, start[new], m])
            to = np.searchsorted(self.keys, u[new])
            self.keys, self.at = np.insert(self.keys, to, u[new]), np.insert(self.at, to, rows, 1)
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(texts(first[new])), np.uint8)])
            self.ids = np.concatenate([self.ids, ids[: int(m.sum())]])
        start, many = start[place], many[place]
        if len(odd := np.flatnonzero(~same)):  # other bytes of the same hash
            ids, count = self._encode(texts(odd))
            start[odd], many[odd] = len(table) + np.cumsum(count) - count, count
            table = np.concatenate([table, ids])
        return start, many, table

    def encode(self, raw: list[bytes], end: int | None = None) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian integers of ``self.dtype``, with ``end`` appended."""
        odd = [i for i, t in enumerate(raw) if _ODD.search(t)]
        plain = [t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in raw]
        for i in odd:
            plain[i] = b""
        a, ends = part_punctuation(plain)
        dark = ~_WHITE[a]
        begin = np.flatnonzero(dark & np.r_[True, ~dark[:-1]]) if len(a) else np.zeros(0, np.int64)
        size = np.flatnonzero(dark & np.r_[~dark[1:], True]) + 1 - begin if len(a) else begin
        start, many, table = self._chunks(a, begin, size)
        stop = np.cumsum(many)
        total = int(stop[-1]) if len(stop) else 0
        ids = table[np.repeat(start - (stop - many), many) + np.arange(total)]
        cut = np.r_[0, stop][np.searchsorted(begin, ends)]  # ids before the end of each text
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        packed, w = ids.tobytes(), self.dtype.itemsize
        out = [packed[w * x : w * y] + tail for x, y in zip([0, *cut[:-1].tolist()], cut.tolist())]
        for i in odd:
            out[i] = self._encode([raw[i]])[0].tobytes() + tail
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a tokenizer file; what it remembers outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int | None) -> Iterator[tuple[list, list[bytes], np.dtype]]:
    """(row of ids, ids as bytes, dtype) of batches of ids and texts."""
    enc = encoder(path)
    for ids, raw in common.text_batches(batches):
        yield ids, enc.encode(raw, end), enc.dtype


# ---- operator 7 ------------------------------------------------------------------------

_PRE = re.compile(" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text for a sentencepiece BPE model whose pieces hold U+2581 only at their start and never a line feed.

    A pre-token is a run of spaces with the characters after it, or a line feed with them; the
    model's own leading space makes the first one. Merges can't cross their borders, so counts add up.
    A single leading space is left out, as most have it.
    """
    if not text:
        return []
    t = text.replace("▁", " ")
    if "  " in t or t[0] == " ":
        return [x[1:] if x[0] == " " else x for x in _PRE.findall(" " + t)]
    return t.replace("\n", " \n").split(" ") if t[0] != "\n" else ["", *t.replace("\n", " \n").split(" ")[1:]]


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        bad = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if "▁" in p.lstrip("▁") or "\n" in p]
        if bad or self.sp.encode(" \n", out_type=str)[:1] != ["▁▁"]:
            raise ValueError(f"pieces of this model cross pre-tokens: {bad[:3]}")

    def count(self, pres: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        n = np.fromiter(map(len, self.sp.encode(pres, num_threads=1)), np.int64, len(pres)) if pres else np.zeros(0, np.int64)
        n -= np.fromiter((p[:1] == "\n" for p in pres), np.int64, len(pres))
        n[np.fromiter((p == "" for p in pres), bool, len(pres))] = 1
        return n


def pre_token_table(docs: DataFrame, path: str) -> DataFrame:
    """(pre, spread, pieces): every distinct pre-token of the texts, how many documents hold it, and its pieces, counted once."""

    def gather(batches):
        seen: Counter[str] = Counter()

        def send():
            return common.batch(pre=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))

        for _, raw in common.text_batches(batches):
            for t in raw:
                seen.update(set(pre_tokens(t.decode("utf-8", "replace"))))
            if len(seen) > GATHER:
                yield send()
                seen.clear()
        yield send()

    def count(batches):
        c = PieceCounter(path)
        for b in batches:
            yield common.batch(pre=b.column(0), spread=b.column(1), pieces=pa.array(c.count(b.column(0).to_pylist()), pa.int64()))

    distinct = docs.mapInArrow(gather, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("spread"))
    return distinct.mapInArrow(count, "pre string, spread long, pieces long")


def most_spread(table: DataFrame, head: int) -> Column:
    """A condition that about ``head`` rows meet, and no more: those of the largest ``spread``, of about equal ones those of small hash.

    ``head`` of them or fewer by one bin are met, however many share a spread, so a row that isn't met has at
    most a ``head``-th of all spreads, up to a step.
    """
    step, bin_ = F.floor(F.log2(F.col("spread")) * STEPS), F.pmod(F.xxhash64("pre"), F.lit(BINS))
    least, left = 1 << 20, head
    for s, n in sorted(map(tuple, table.groupBy(step).count().collect()), reverse=True):  # at most 64 * STEPS rows
        if n > left:
            cut = -1
            for b, m in sorted(map(tuple, table.filter(step == s).groupBy(bin_).count().collect())):  # at most BINS rows
                if m > left:
                    break
                cut, left = b, left - m
            return (step >= least) | ((step == s) & (bin_ <= cut))
        least, left = s, left - n
    return step >= least


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One row for each input row, repeated ids included; a null id stays null; a null or empty
    text has 0 bytes and 0 tokens. Only the id and the text column are read, so other columns
    may have any name. An empty table gives no rows.

    Pieces are counted once for each distinct pre-token. The ``head`` pre-tokens of most
    documents are broadcast (their number is the bound); a document sums those at once and
    sends only the others, with their frequencies, to a join by pre-token, where none has more
    than about a ``head``-th of all rows.
    """
    spark = docs.sparkSession
    rows = common.two_columns(docs, id_col, text_col)
    table, _ = common.stage(pre_token_table(rows, path), "pretokens")
    wide = most_spread(table, head)
    top = table.filter(wide).select("pre", "pieces").toArrow()
    known = spark.sparkContext.broadcast(top)

    def sums(batches):
        counts = dict(zip(known.value["pre"].to_pylist(), known.value["pieces"].to_pylist()))
        for b in batches:
            uids, at = b.column(2), 0
            for ids, raw in common.text_batches([pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"])]):
                uid = uids.slice(at, len(ids)).to_pylist()
                at += len(ids)
                n, rest = [], []
                for u, t in zip(uid, raw):
                    got = list(map(counts.get, pres := pre_tokens(t.decode("utf-8", "replace"))))
                    if None in got:
                        n.append(sum(filter(None, got)))
                        rest.extend((u, p, k) for p, k in Counter(p for p, c in zip(pres, got) if c is None).items())
                    else:
                        n.append(sum(got))
                yield common.batch(uid=pa.array(uid, pa.int64()), doc_id=ids, n_bytes=pa.array(list(map(len, raw)), pa.int64()), pre=pa.nulls(len(uid), pa.string()), n=pa.array(n, pa.int64()))
                if rest:
                    u, p, k = zip(*rest)
                    yield common.batch(uid=pa.array(u, pa.int64()), doc_id=pa.nulls(len(u), pa.int64()), n_bytes=pa.nulls(len(u), pa.int64()), pre=pa.array(p, pa.string()), n=pa.array(k, pa.int64()))

    per, _ = common.stage(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(sums, "uid long, doc_id long, n_bytes long, pre string, n long"), "pretoken-sums")
    tail = per.filter("pre is not null").join(table.filter(~wide), "pre").select("uid", per.doc_id, "n_bytes", (F.col("n") * F.col("pieces")).alias("n"))
    both = per.filter("pre is null").select("uid", "doc_id", "n_bytes", "n").unionByName(tail)
    out = both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
