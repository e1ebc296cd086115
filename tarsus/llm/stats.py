"""Document statistics over whole texts, a batch of documents at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WHITE = [0x20, *range(0x09, 0x0E)]
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that models may use, all free of labels, lang, source and id.
FEATURES = [
    "log_words", "mean_word", "max_word", "short_words", "long_words", "distinct_words", "symbols", "dup_lines", "repeat_words", "line_words",
    "upper", "digits", "bangs", "pipes", "periods", "commas", "other_punct", "equals", "slashes", "brackets", "non_ascii", "white", "entropy", "capital_words",
]

_R = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, inverse)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """64-bit hashes of any spans of a byte string."""

    def __init__(self, a: np.ndarray):
        p, self.back = _pow(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.multiply(mix(np.arange(1, 257, dtype=np.uint64))[a], p[: len(a)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    o = np.argsort(key)
    s = key[o]
    same = np.r_[False, s[1:] == s[:-1]]
    out = np.zeros(len(key), bool)
    out[o] = same | np.r_[same[1:], False]
    return out


def statistics(raw: list[bytes], window: int = 8) -> dict[str, np.ndarray]:
    """BASE counts and FEATURES of each text.

    Words are runs of bytes that are not ASCII white space. ``n_dup_lines`` counts lines with a
    word that equal an earlier line; ``n_repeat_words`` counts words inside windows of
    ``window`` words found twice or more in the text. Lines and windows are compared by 64-bit hashes.
    """
    n = len(raw)
    lens = np.fromiter(map(len, raw), np.int64, n)
    ends = np.cumsum(lens)
    a = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), lens)
    hist = np.bincount(doc * 256 + a, minlength=256 * n).reshape(n, 256) if len(a) else np.zeros((n, 256), np.int64)
    h = Hashed(a)
    is_white = np.zeros(256, bool)
    is_white[WHITE] = True
    edge = np.zeros(len(a) + 1, bool)
    edge[ends] = edge[ends - lens] = True  # documents don't run into each other
    dark = ~is_white[a] if len(a) else np.zeros(0, bool)
    begin = np.flatnonzero(dark & (np.r_[True, ~dark[:-1]] | edge[:-1]) if len(a) else dark)
    stop = np.flatnonzero(dark & (np.r_[~dark[1:], True] | edge[1:]) if len(a) else dark) + 1
    wdoc = doc[begin]
    words = np.bincount(wdoc, minlength=n)
    whash = h.of(begin, stop)
    wlen = stop - begin
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))

    # windows of words
    cover = np.zeros(len(begin) + 1, np.int64)
    m = len(begin) - window + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(window):
            g = g * _R + whash[k : k + m]
        inside = np.flatnonzero(wdoc[:m] == wdoc[window - 1 :])
        twice = inside[_repeats(mix(g[inside]) ^ salt[wdoc[inside]])]
        cover = np.bincount(twice, minlength=len(cover)) - np.bincount(twice + window, minlength=len(cover))
    repeat_words = np.bincount(wdoc, weights=(np.cumsum(cover)[:-1] > 0), minlength=n).astype(np.int64)

    # lines with a word
    first = np.flatnonzero((np.r_[True, a[:-1] == 10] | edge[:-1])) if len(a) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(a)] if len(first) else first
    ended = (a[last - 1] == 10) & (last - first > 0) if len(first) else np.zeros(0, bool)
    dark_sum = np.r_[0, np.cumsum(dark)]
    wordy = dark_sum[last] > dark_sum[first]
    first, last = first[wordy], (last - ended)[wordy]
    ldoc = doc[first]
    lines = np.bincount(ldoc, minlength=n)
    _, at = np.unique(h.of(first, last) ^ salt[ldoc], return_index=True)
    dup_lines = lines - np.bincount(ldoc[at], minlength=n)

    points = lens - hist[:, 0x80:0xC0].sum(1)
    white = hist[:, WHITE].sum(1)
    count = lambda s: hist[:, list(s)].sum(1)
    upper, lower, digits = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1)
    symbols = count(SYMBOLS)
    punct = hist[:, 33:48].sum(1) + hist[:, 58:65].sum(1) + hist[:, 91:97].sum(1) + hist[:, 123:127].sum(1)
    _, at = np.unique(whash ^ salt[wdoc], return_index=True)
    distinct = np.bincount(wdoc[at], minlength=n)
    w = np.maximum(words, 1)
    b = np.maximum(lens, 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, wdoc, wlen)
    p = hist / b[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    caps = np.bincount(wdoc, weights=(a[begin] >= 65) & (a[begin] <= 90), minlength=n) if len(begin) else np.zeros(n)
    share = lambda x: np.bincount(wdoc, weights=x, minlength=n) / w if len(begin) else np.zeros(n)
    out = dict(zip(BASE, (words, points - white, symbols, dup_lines, repeat_words)))
    out |= dict(zip(FEATURES, (
        np.log1p(words), (points - white) / w, np.log1p(longest), share(wlen <= 2), share(wlen > 16), distinct / np.sqrt(w), symbols / w, dup_lines / np.maximum(lines, 1), repeat_words / w, np.log1p(words / np.maximum(lines, 1)),
        upper / np.maximum(upper + lower, 1), digits / b, count(b"!") / w, count(b"|") / w, count(b".") / w, count(b",") / w, punct / b, count(b"=_") / w, count(b"/\\@:") / w, count(b"[]{}()<>") / w, hist[:, 128:].sum(1) / b, white / b, entropy, caps / w,
    )))
    return out


def table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, BASE (long) and f (the FEATURES as an array of doubles), a row for each document."""

    def run(batches):
        import xxhash

        for ids, raw in common.text_batches(batches):
            s = statistics(raw)
            f = np.stack([s[k] for k in FEATURES], 1).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * len(FEATURES), pa.int32()), pa.array(f.ravel()))
            yield common.batch(doc_id=ids, text_hash=pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in raw], np.uint64).view(np.int64)), **{k: pa.array(s[k], pa.int64()) for k in BASE}, f=lists)

    return common.two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{k} long" for k in BASE) + ", f array<double>")


def labelled(stats: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """Statistics with the label (0 or 1, as double y) of labelled documents; rows without label or id are left out."""
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return stats.join(lab, "doc_id")


def features(rows: pa.RecordBatch, name: str = "f") -> np.ndarray:
    f = rows.column(rows.schema.get_field_index(name))
    return f.flatten().to_numpy().reshape(-1, len(FEATURES)) if len(f) else np.zeros((0, len(FEATURES)))
