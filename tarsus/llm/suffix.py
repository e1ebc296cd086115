"""Exact repeated-substring removal (operator 2) with suffix arrays.

A repeated string can sit in any two documents, so shards of text can't be compared pair by pair.
Instead *anchors* bring possible repeats together: the k-gram of least hash in every window of
``length`` bytes. Equal windows have equal anchors at equal offsets, so a window whose anchor
occurs in one document only occurs nowhere else. The stretches of bytes that shared anchors own
go to the anchor's bucket. Stretches of equal bytes collapse to one with the smallest id, in the
block and in the bucket. The distinct ones form shards: each is sorted by a suffix array
(Larsson-Sadakane), Kasai's common prefixes part its windows into equal ones, and the sorted windows of
shards are merged by binary search. Hashes choose where stretches go; bytes decide what is equal.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .stats import Hashed, mix

#: Bytes of stretches in one suffix array of a bucket, and bytes handled at once while hashing.
SHARD_BYTES, CHUNK_BYTES = 500_000, 200_000
#: Bytes of stretches that a bucket settles at once.
PART_BYTES = 2_000_000
#: Blocks that hold an anchor from which on its stretches are parted by the bytes around it, too.
HOT_BLOCKS = 500
LAST = np.uint64(2**64 - 1)
BIG = np.int64(2**63 - 1)


# ---- anchors ---------------------------------------------------------------------------


def slide(x: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over every window of w values."""
    n, m = 1, x
    while 2 * n <= w:
        m = f(m[: len(m) - n], m[n:])
        n *= 2
    return f(m[: len(m) - (w - n)], m[w - n :]) if n < w else m


_B = 0x9E3779B97F4A7C15


def kgram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, by joining hashes of shorter ones."""
    h = mix(np.arange(1, 257, dtype=np.uint64))[a]
    parts, size, total, out = [], 1, 0, None
    while True:
        if k & size:
            parts.append((size, h))
        if 2 * size > k:
            break
        h = h[: len(h) - size] * np.uint64(pow(_B, size, 1 << 64)) + h[size:]
        size *= 2
    n = len(a) - k + 1
    for size, h in parts:
        out = h[:n] if out is None else out * np.uint64(pow(_B, size, 1 << 64)) + h[total : total + n]
        total += size
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(a: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first, last) of the anchors of whole documents joined in ``a``: each owns the windows starting from first to last.

    Every window of ``length`` bytes within a document is owned by the leftmost k-gram of least hash in it.
    """
    k = length // 2
    w = length - k + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a) < length:
        return none
    h = kgram_hashes(a, k)
    m = slide(h, w)
    starts = np.r_[0, ends[:-1]]
    valid = np.zeros(len(m) + 1, np.int8)
    lo, hi = starts, np.maximum(starts, ends - length + 1)
    np.add.at(valid, lo[lo <= len(m)], 1)
    np.add.at(valid, hi[lo <= len(m)], -1)
    m[np.cumsum(valid[:-1]) == 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    p = np.flatnonzero(slide(np.concatenate([pad, m, pad]), w, np.maximum) == h)
    if not len(p):
        return none
    hp = h[p]
    doc = np.searchsorted(ends, p, side="right")
    first = np.maximum(p - (w - 1), starts[doc])
    last = np.minimum(p, ends[doc] - length)
    for side in (-1, 1):
        step, todo = 1, np.arange(len(p))
        while len(todo):
            other = todo + side * step
            ok = (other >= 0) & (other < len(p))
            todo, other = todo[ok], other[ok]
            near = (np.abs(p[other] - p[todo]) < w) & (doc[other] == doc[todo])
            todo, other = todo[near], other[near]
            less = hp[other] <= hp[todo] if side < 0 else hp[other] < hp[todo]
            t, o = todo[less], other[less]
            if side < 0:
                first[t] = np.maximum(first[t], p[o] + 1)
            else:
                last[t] = np.minimum(last[t], p[o] - w)
            todo, step = todo[~less], step + 1
    keep = first <= last
    return p[keep], mix(hp[keep]), first[keep], last[keep]  # least hashes are small; mixed again they fill buckets evenly


@dataclass
class Stretches:
    """Runs of windows to ask about: the distinct ones in ascending order of key, and all of them with their place among those."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray  #: smallest id
    all_first: np.ndarray
    all_last: np.ndarray
    all_ids: np.ndarray
    place: np.ndarray


def pack_anchors(a: np.ndarray, lens: np.ndarray, length: int) -> bytes:
    """Where the anchors of a block's documents are, and how far before them the windows they own begin and end."""
    ends = np.cumsum(lens)
    got, lo, at = [], 0, 0
    while lo < len(ends):  # whole documents, about CHUNK_BYTES at once
        hi = max(lo + 1, int(np.searchsorted(ends, at + CHUNK_BYTES)))
        p, _, first, last = anchors(a[at : ends[hi - 1]], ends[lo:hi] - at, length)
        got.append((p + at, p - first, p - last))
        lo, at = hi, int(ends[hi - 1])
    p, back, fore = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
    return b"".join(common.planes(common.smallest(x)) for x in (np.diff(p, prepend=0), back, fore))


class Block:
    """A block's documents and their anchors."""

    def __init__(self, row: dict, length: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.a = np.frombuffer(row["text"], np.uint8)
        self.ends = np.cumsum(self.lens)
        step, at = common.unplanes(row["anchors"])
        back, at = common.unplanes(row["anchors"], at)
        fore, _ = common.unplanes(row["anchors"], at)
        self.p = np.cumsum(step, dtype=np.int64)
        self.first, self.last = self.p - back.astype(np.int64), self.p - fore.astype(np.int64)
        self.hashed = Hashed(self.a)
        self.h = self.hashed.of(self.p, self.p + length // 2)
        self.length = length

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, each anchor's place among them, and whether several ids have it here."""
        keys, at = np.unique(self.h, return_inverse=True)
        doc = self.ids[np.searchsorted(self.ends, self.p, side="right")] if len(self.p) else self.p
        low, high = np.full(len(keys), BIG), np.full(len(keys), -BIG)
        np.minimum.at(low, at, doc)
        np.maximum.at(high, at, doc)
        return keys, at, low < high

    def stretches(self, answers: dict[int, bytes]) -> Stretches:
        """What the anchors own that several documents have. Stretches of equal bytes here count once, with their smallest id."""
        keys, at, here = self.keys()
        level = np.maximum(unpack_levels(answers, len(keys)), here)[at]
        k, w = self.length // 2, self.length - self.length // 2 + 1
        one, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        key, first, last = [self.h[one]], [self.first[one]], [self.last[one]]
        hashed = self.hashed
        if len(hot):
            # a window has its anchor at one of w offsets: at w // 2 or more it has as many bytes before it, else w - w // 2 behind it
            p, c = self.p[hot], w // 2
            f, l = self.first[hot], np.minimum(self.last[hot], p - c)
            sel = f <= l
            key.append(mix(hashed.of(p[sel] - c, p[sel] + k) ^ self.h[hot][sel]))
            first.append(f[sel])
            last.append(l[sel])
            f, l = np.maximum(self.first[hot], p - c + 1), self.last[hot]
            sel = f <= l
            key.append(mix(hashed.of(p[sel], p[sel] + k + w - c) ^ self.h[hot][sel] ^ np.uint64(1)))
            first.append(f[sel])
            last.append(l[sel])
        key, first, last = np.concatenate(key), np.concatenate(first), np.concatenate(last)
        order = np.lexsort((hashed.of(first, last + self.length), key))
        key, first, last = key[order], first[order], last[order]
        ids = self.ids[np.searchsorted(self.ends, first, side="right")] if len(first) else first
        same = like_before(self.a, first, last - first + self.length) & (key[1:] == key[:-1]) if len(key) > 1 else np.zeros(0, bool)
        new = np.flatnonzero(np.r_[True, ~same]) if len(key) else first
        place = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(key)]))
        return Stretches(key[new], first[new], last[new], np.minimum.reduceat(ids, new) if len(new) else ids, first, last, ids, place)


def like_before(a: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of ``a``, but the first, has the bytes of the one before it. Bytes are compared, not hashes."""
    out = size[1:] == size[:-1]
    at = np.flatnonzero(out)
    n = size[at]
    words = packed_words(a)
    for k in range(0, int(n.max()) if len(n) else 0, 8):
        off = np.minimum(k, np.maximum(n - 8, 0))
        x = words[first[at] + off] ^ words[first[at + 1] + off]
        eq = x >> (np.uint64(8) * np.maximum(8 - n, 0).astype(np.uint64)) == 0  # a word may reach beyond a short span
        out[at[~eq]] = False
        at, n = at[eq], n[eq]
    return out


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack_bits(answers: dict[int, bytes], n: int, each: int = 1) -> np.ndarray:
    """Answers of all buckets in order, each with its number of keys in front, ``each`` bits a key."""
    out = [np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=each * struct.unpack_from("<Q", b)[0]).astype(bool) for _, b in sorted(answers.items())]
    out = np.concatenate(out) if out else np.zeros(0, bool)
    if len(out) != each * n:
        raise RuntimeError(f"a block has {n} keys, but {len(out) // each} answers")
    return out


def unpack_levels(answers: dict[int, bytes], n: int) -> np.ndarray:
    """0 for keys of one block, 1 for those of several, 2 for those of HOT_BLOCKS and more."""
    return unpack_bits(answers, n, 2).reshape(-1, 2).sum(1)


# ---- suffix arrays ---------------------------------------------------------------------


def packed_words(a: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, big-endian, zeros beyond the end."""
    b = np.concatenate([a, np.zeros(8, np.uint8)])
    return np.ndarray(len(a), ">u8", b, strides=(1,)).astype(np.uint64)


def rooms(lens: np.ndarray) -> np.ndarray:
    """Bytes from each position to the end of its string, for strings that are joined."""
    return (np.repeat(np.cumsum(lens), lens) - np.arange(int(lens.sum()))).astype(np.int32)


def suffix_array(a: np.ndarray, lens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the strings of ``lens`` bytes joined in ``a`` (one string by default) in order, and the eight-byte words.

    A suffix ends with its string; what is a prefix of another comes before it, and equal ones
    are in the order of their strings. Larsson-Sadakane: sort by eight bytes; then groups of equal
    suffixes, and only those, are sorted by the rank of the suffix that follows what is known, which
    doubles what is known. The order is complete, as Kasai's bound needs it.
    """
    n = len(a)
    lens = np.array([n]) if lens is None else lens
    words, room = packed_words(a), rooms(lens)
    key = words
    short = np.flatnonzero(room < 8)
    if len(short):
        key = words.copy()
        cut = (np.uint64(8) * (np.uint64(8) - room[short].astype(np.uint64))).astype(np.uint64)
        key[short] = key[short] >> cut << cut
    sa = np.argsort(key).astype(np.int32)
    s = key[sa]
    head = np.r_[True, s[1:] != s[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    known = 8
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    if len(short) and not a.all():  # a zero byte isn't the end of a string
        at = np.flatnonzero(~head | ~np.r_[head[1:], True])
        i = sa[at]
        key = (rank[i].astype(np.uint64) << np.uint64(32)) | np.minimum(room[i], 8).astype(np.uint64)
        o = np.argsort(key)
        key = key[o]
        sa[at] = i[o]
        head[at] = np.r_[True, key[1:] != key[:-1]] if len(at) else head[at]
        rank[sa[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
    strings = len(lens)
    owner = np.repeat(np.arange(strings, dtype=np.int32), lens) if strings > 1 else None
    while True:
        open_ = ~head | ~np.r_[head[1:], True] if n else head
        at = np.flatnonzero(open_)
        if not len(at):
            break
        i = sa[at]
        # beyond the end of a string ranks are those of the strings, below all others
        inside = room[i] > known
        follows = np.where(inside, rank[np.where(inside, i + known, 0)] + strings, owner[i] if owner is not None else 0)
        key = (rank[i].astype(np.uint64) << np.uint64(32)) | follows.astype(np.uint64)
        o = np.argsort(key)
        key = key[o]
        sa[at] = i[o]
        head[at] = np.r_[True, key[1:] != key[:-1]]
        rank[sa[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
        known *= 2
    return sa, words


def common_prefixes(sa: np.ndarray, words: np.ndarray, at_most: int, stride: int = 8, lens: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``at_most``, within their strings.

    Kasai: if a suffix shares l bytes with its predecessor, the next suffix in the string shares
    at least l - 1 with its own. Positions are taken ``stride`` apart at a time, all those of
    one residue together, each starting from what its left neighbour implies.
    """
    n = len(sa)
    room = rooms(np.array([n]) if lens is None else lens)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    pad = np.concatenate([words, np.zeros(at_most + 8, np.uint64)])
    most = np.minimum(room, at_most)
    for r in range(min(stride, n)):
        i = np.arange(r, n, stride)
        j = before[i]
        top = np.where(j >= 0, np.minimum(most[i], most[np.maximum(j, 0)]), 0)
        known = np.minimum(np.maximum(plcp[i - 1] - 1, 0), top) if r else np.zeros(len(i), np.int64)
        live = np.flatnonzero(known < top)
        while len(live):
            x = pad[i[live] + known[live]] ^ pad[j[live] + known[live]]
            same = x == 0
            part = live[~same]
            if len(part):
                # leading zero bytes of the difference
                y = x[~same]
                lead = np.zeros(len(y), np.int64)
                for k in range(1, 8):
                    lead += y >> np.uint64(64 - 8 * k) == 0
                known[part] += lead
            live = live[same]
            known[live] += 8
            live = live[known[live] < top[live]]
        plcp[i] = np.minimum(known, top)
    return plcp[sa]


def classes(a: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, class, words): the starts of all windows in the order of their bytes, and equal classes for equal ones, from 0."""
    sa, words = suffix_array(a, lens)
    lcp = common_prefixes(sa, words, length, lens=lens)
    cls = np.cumsum(lcp < length)
    # suffixes that aren't windows, being too short, may stand among windows: a class ends where a prefix gets short
    use = rooms(lens)[sa] >= length
    sa, cls = sa[use], cls[use]
    new = np.r_[True, cls[1:] != cls[:-1]] if len(cls) else np.zeros(0, bool)
    return sa, np.cumsum(new) - 1, words


@dataclass
class Windows:
    """Distinct windows in the order of their bytes, as words, with their smallest ids."""

    keys: np.ndarray
    least: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search, first for the first word and then among those: where each window is or would be, and whether it is there."""
        lo, hi = np.searchsorted(self.keys[:, 0], keys[:, 0]), np.searchsorted(self.keys[:, 0], keys[:, 0], side="right")
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            less = lexicographic_less(self.keys[mid], keys[live])
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        there = lo < len(self.keys)
        there[there] = (self.keys[lo[there]] == keys[there]).all(1)
        return lo, there

    def merge(self, other: Windows) -> Windows:
        """The windows of both, each with its smallest id."""
        at, there = self.find(other.keys)
        least = self.least.copy()
        np.minimum.at(least, at[there], other.least[there])
        new = ~there
        return Windows(np.insert(self.keys, at[new], other.keys[new], 0), np.insert(least, at[new], other.least[new]))


class Shard:
    """The windows of some strings with ids, sorted by a suffix array: where they start, their classes, and the distinct ones."""

    def __init__(self, a: np.ndarray, lens: np.ndarray, ids: np.ndarray, length: int):
        sa, cls, words = classes(a, lens, length)
        first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else cls
        padded = np.concatenate([words, np.zeros(length, np.uint64)])
        at = sa[first]
        keys = np.stack([padded[at + max(0, min(8 * k, length - 8))] for k in range(-(-length // 8))], 1)
        if length < 8:
            keys = keys >> np.uint64(64 - 8 * length)
        self.where, self.cls = sa.astype(np.int32), cls.astype(np.int32)
        self.own = Windows(keys, np.minimum.reduceat(np.repeat(ids, lens)[sa], first) if len(first) else np.zeros(0, np.int64))


#: What this process's buckets did: windows in shards, shards, and windows looked up in other shards.
merged = {"windows": 0, "shards": 0, "looked_up": 0}


def lexicographic_less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    less, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
    for k in range(x.shape[1]):
        less |= open_ & (x[:, k] < y[:, k])
        open_ &= x[:, k] == y[:, k]
    return less


def seen_earlier(a: np.ndarray, lens: np.ndarray, ids: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For each byte of strings with ids: whether the window from it on occurs with a smaller id than its own.

    Shards are merged two by two, so every window is looked up once a level; then each shard
    finds its windows in what all have.
    """
    ends = np.cumsum(lens)
    shards, lo = [], 0
    while lo < len(lens):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + shard_bytes)))
        shards.append((base, Shard(a[base : ends[hi - 1]], lens[lo:hi], ids[lo:hi], length)))
        lo = hi
    level = [s.own for _, s in shards]
    while len(level) > 1:
        merged["looked_up"] += sum(len(y.keys) for y in level[1::2])
        level = [x.merge(y) for x, y in zip(level[::2], level[1::2])] + level[len(level) // 2 * 2 :]
    out = np.zeros(len(a), bool)
    who = np.repeat(ids, lens)
    for base, s in shards:
        least = level[0].least[level[0].find(s.own.keys)[0]] if len(shards) > 1 else s.own.least
        where = base + s.where.astype(np.int64)
        out[where] = least[s.cls] < who[where]
        merged["windows"] += len(where)
    merged["shards"] += len(shards)
    return out


# ---- the operator ----------------------------------------------------------------------


def blocks(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, str]:
    """Staged blocks (grp, block, ids, lens, hashes, text, anchors). A null id counts as the largest."""
    rows = common.two_columns(docs, id_col, text_col).select("doc_id", "text", common.text_hash().alias("text_hash"))

    def run(batches):
        from pyspark import TaskContext

        grp, n = TaskContext.get().partitionId(), 0
        held: list = [[], [], []]
        size = 0

        def flush():
            nonlocal n, held, size
            ids, hashes, raw = held
            lens, text = np.array(list(map(len, raw)), np.int64), b"".join(raw)
            row = common.batch(
                grp=pa.array([grp], pa.int32()), block=pa.array([(grp << 24) + n], pa.int64()), ids=pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), lens=pa.array([lens.tobytes()], pa.binary()),
                hashes=pa.array([np.array(hashes, np.int64).tobytes()], pa.binary()), text=pa.array([text], pa.binary()), anchors=pa.array([pack_anchors(np.frombuffer(text, np.uint8), lens, length)], pa.binary()),
            )
            n, held, size = n + 1, [[], [], []], 0
            return row

        for b in batches:
            at = 0
            for ids, raw in common.text_batches([pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"])], common.BLOCK_BYTES):
                held[0] += ids.fill_null(int(BIG)).to_pylist()
                held[1] += b.column(2).slice(at, len(ids)).to_pylist()
                held[2] += raw
                at += len(ids)
                size += sum(map(len, raw))
                if size >= common.BLOCK_BYTES:
                    yield flush()
        if held[0]:
            yield flush()

    return common.stage(rows.mapInArrow(run, "grp int, block long, ids binary, lens binary, hashes binary, text binary, anchors binary"), "text-blocks", large_rows=True)


def answer_anchors(payloads: list[bytes], hot: int = HOT_BLOCKS) -> Iterator[bytes]:
    """Two bits a key: whether several blocks asked about it, and whether ``hot`` did."""
    all_keys = [common.unpack_sorted(p)[0] for p in payloads]
    s = np.sort(np.concatenate(all_keys))
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[begin, len(s)])
    again, n = s[begin][n > 1], n[n > 1]
    for keys in all_keys:
        at = np.minimum(np.searchsorted(again, keys), max(0, len(again) - 1))
        hit = (again[at] == keys) if len(again) else np.zeros(len(keys), bool)
        yield struct.pack("<Q", len(keys)) + pack_bits(np.stack([hit, hit & (n[at] >= hot) if len(again) else hit], 1).ravel())


def settle(text: np.ndarray, lens: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of stretches joined in ``text``, one after another: whether it occurs with a smaller id."""
    begin = np.cumsum(lens) - lens
    order = np.argsort(Hashed(text).of(begin, begin + lens), kind="stable")
    new = np.flatnonzero(np.r_[True, ~like_before(text, begin[order], lens[order])]) if len(order) else order
    low = np.minimum.reduceat(ids[order], new) if len(new) else ids
    same = np.empty(len(order), np.int64)
    same[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
    size = lens[order][new]
    at = np.cumsum(size) - size
    distinct = text[np.repeat(begin[order][new] - at, size) + np.arange(int(size.sum()))]
    hit = seen_earlier(distinct, size, low, length)
    # a stretch with a larger id than the smallest of its kind is all seen; others as their kind
    own = lens - length + 1
    return hit[np.repeat(at[same] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] | np.repeat(ids > low[same], own)


def pack_stretches(lens: np.ndarray, least: np.ndarray, sub: np.ndarray, text: np.ndarray) -> bytes:
    """What a block sends to a bucket: its stretches in ascending order of key, each with the eight bits of its key after the bucket's."""
    return common.planes(common.smallest(lens)) + common.planes(least.view(np.uint64)) + sub.astype(np.uint8).tobytes() + text.tobytes()


def answer_stretches(payloads: list[bytes], length: int, part_bytes: int | None = None) -> Iterator[bytes]:
    """A bit for each window of the stretches that each block sent: whether it occurs with a smaller id.

    Equal windows have equal keys, so a bucket is settled in parts, runs of the next eight bits of the keys: the arrays,
    tens of bytes for each byte of text, are of about ``part_bytes`` (PART_BYTES) of text, however much text the bucket has.
    """
    part_bytes = part_bytes or PART_BYTES
    lens, ids, sub, text = [], [], [], []
    for p in payloads:
        x, at = common.unplanes(p)
        y, at = common.unplanes(p, at)
        lens.append(x)
        ids.append(y.view(np.int64))
        sub.append(np.frombuffer(p, np.uint8, len(x), at))
        text.append(at + len(x))  # where it begins
    n_each = np.array(list(map(len, lens)))
    lens, ids, sub = np.concatenate(lens).astype(np.int64), np.concatenate(ids), np.concatenate(sub)
    first = np.cumsum(n_each) - n_each
    who = np.repeat(np.arange(len(payloads)), n_each)
    begin = np.cumsum(lens) - lens
    if len(lens):
        begin += (np.array(text) - np.r_[begin, 0][np.minimum(first, len(lens))])[who]  # within the payload
    own = lens - length + 1
    window = np.cumsum(own) - own
    bits = np.zeros(int(own.sum()), bool)

    # parts: a key of more than part_bytes is one by itself
    weight, part, n_parts, held = np.bincount(sub, lens, 256), np.zeros(256, np.int64), 0, 0.0
    for k, w in enumerate(weight.tolist()):
        if held and held + w > part_bytes:
            n_parts, held = n_parts + 1, 0.0
        part[k], held = n_parts, held + w
    part = part[sub]
    for k in range(n_parts + 1):
        mine = np.flatnonzero(part == k)
        if not len(mine):
            continue
        run = np.flatnonzero(np.r_[True, np.diff(who[mine]) > 0])  # what one payload has of a part lies together
        last = np.r_[run[1:], len(mine)] - 1
        got = b"".join([payloads[w][s:e] for w, s, e in zip(who[mine[run]].tolist(), begin[mine[run]].tolist(), (begin + lens)[mine[last]].tolist())])
        hit = settle(np.frombuffer(got, np.uint8), lens[mine], ids[mine], length)
        n = own[mine]
        bits[np.repeat(window[mine] - (np.cumsum(n) - n), n) + np.arange(len(hit))] = hit
    ends = np.cumsum(np.r_[0, own])[np.r_[first, len(own)]]
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield struct.pack("<Q", e - s) + pack_bits(bits[s:e])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller id.

    Per input row: doc_id, text_hash, n_bytes, n_removed, n_spans
    (maximal removed runs), spans (their starts and lengths), kept_sha256 (of the remaining
    bytes) and, if ``kept``, the remaining bytes. Strings are judged on the input and never
    cross documents. A null text is empty; texts shorter than ``length`` keep everything; rows
    with equal ids don't remove from each other; a null id is larger than all others. Only the
    id and the text column are read. Whole texts count, however long; an empty table gives no rows.
    """
    staged, _ = blocks(docs, id_col, text_col, length)
    n_bytes = int(staged.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_buckets = common.buckets_for(n_bytes)

    def ask_anchors(row) -> Iterator[tuple[int, bytes]]:
        keys, _, _ = Block(row, length).keys()
        cut = common.split_sorted(keys, n_buckets)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield k, common.pack_sorted(keys[cut[k] : cut[k + 1]])

    shared = common.exchange(staged, ask_anchors, answer_anchors, n_buckets, "shared-anchors")
    n_fine = common.buckets_for(8 * n_bytes)
    below = np.uint64(max(0, 56 - (n_fine.bit_length() - 1)))  # bits below the eight after the bucket's

    def ask_stretches(row, state={}) -> Iterator[tuple[int, bytes]]:  # noqa: B006
        b = Block(row, length)
        x = b.stretches(state.setdefault("a", common.Answers(shared)).of(row["grp"], row["block"]))
        cut = common.split_sorted(x.key, n_fine)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[k], cut[k + 1])
            lens = x.last[own] - x.first[own] + length
            where = np.repeat(x.first[own] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            yield k, pack_stretches(lens, x.least[own], x.key[own] >> below & np.uint64(255), b.a[where])

    earlier = common.exchange(staged, ask_stretches, lambda p: answer_stretches(p, length), n_fine, "earlier-windows")

    def finish(batches):
        found, hits = common.Answers(shared), common.Answers(earlier)
        for row in common.read_rows(batches):
            b = Block(row, length)
            x = b.stretches(found.of(row["grp"], row["block"]))
            own = x.last - x.first + 1
            bits = unpack_bits(hits.of(row["grp"], row["block"]), int(own.sum()))
            n, begin = own[x.place], (np.cumsum(own) - own)[x.place]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            seen = bits[np.repeat(begin, n) + step] | np.repeat(x.all_ids > x.least[x.place], n)
            gone = np.zeros(len(b.a), bool)
            gone[(np.repeat(x.all_first, n) + step)[seen]] = True
            start = np.flatnonzero(gone)
            cut = np.zeros(len(b.a), bool)
            if len(start):
                run = np.flatnonzero(np.r_[True, np.diff(start) > length])
                edge = np.zeros(len(b.a) + 1, np.int8)
                edge[start[run]] = 1
                edge[start[np.r_[run[1:] - 1, len(start) - 1]] + length] = -1
                cut = np.cumsum(edge[:-1], dtype=np.int8) > 0
            out: list = [[], [], [], [], [], []]
            lo = 0
            for end in b.ends.tolist():
                mine = cut[lo:end]
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].view(np.int8)))
                rest = b.a[lo:end][~mine].tobytes() if len(edge) else b.a[lo:end].tobytes()
                for c, v in zip(out, (end - lo, int(mine.sum()), len(edge) // 2, edge.tolist(), hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
                lo = end
            ids = pa.array(b.ids, mask=b.ids == BIG)
            yield common.batch(doc_id=ids, text_hash=pa.array(np.frombuffer(row["hashes"], np.int64)), n_bytes=pa.array(out[0], pa.int64()), n_removed=pa.array(out[1], pa.int64()), n_spans=pa.array(out[2], pa.int64()), spans=pa.array(out[3], pa.list_(pa.int64())), kept_sha256=pa.array(out[4], pa.string()), **({"kept": pa.array(out[5], pa.binary())} if kept else {}))

    schema = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string" + ", kept binary" * kept
    return staged.mapInArrow(finish, schema)
