"""Sequence packing (operator 5): non-negative least squares over shallow length combinations, then greedy residuals."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, tokens

#: Combinations tried for each longest length, and in all; coordinate-descent sweeps.
PARTNERS, PATTERNS, SWEEPS = 6, 12_000, 40


def shallow_patterns(h: dict[int, int], window: int, partners: int = PARTNERS, most: int = PATTERNS) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of at most three different lengths that fill the window exactly, as ((length, times), ...).

    For each length, most frequent first: itself repeated, with a repeated common partner, and
    with one more length that fills the rest.
    """
    by_count = sorted(h, key=lambda x: (-h[x], x))
    common_lengths = by_count[: 4 * partners]
    out: dict[tuple, None] = {}
    for a in by_count:
        if len(out) >= most:
            break
        for na in range(1, min(3, window // a) + 1):
            rest = window - na * a
            if rest == 0:
                out[((a, na),)] = None
                continue
            if rest in h and rest != a:
                out[tuple(sorted(((a, na), (rest, 1))))] = None
            found = 0
            for b in common_lengths:
                if found >= partners or b >= rest or b == a:
                    continue
                for nb in {1, rest // b, max(1, rest // (2 * b))}:
                    c = rest - nb * b
                    if c == 0:
                        out[tuple(sorted(((a, na), (b, nb))))] = None
                    elif c in h and c not in (a, b):
                        out[tuple(sorted(((a, na), (b, nb), (c, 1))))] = None
                    else:
                        continue
                    found += 1
    return list(out)[:most]


def nnls(patterns: list, h: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that minimises ||A x - h||^2, by coordinate descent; A holds how often a pattern uses each length."""
    x = np.zeros(len(patterns))
    left = {k: float(v) for k, v in h.items()}
    norm = [sum(n * n for _, n in p) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(patterns):
            step = sum(n * left[k] for k, n in p) / norm[j]
            if step < 0:
                step = max(step, -x[j])
            if step:
                x[j] += step
                for k, n in p:
                    left[k] -= n * step
                moved += abs(step)
        if moved <= 1e-3 * (1 + x.sum()):
            break
    return x


def round_down(patterns: list, x: np.ndarray, h: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    """Whole repeats that never use a length more often than it occurs, and what is left of the histogram."""
    left, times = dict(h), [0] * len(patterns)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        n = min(int(x[j] + 0.5), *(left[k] // m for k, m in patterns[j]))
        if n > 0:
            times[j] = n
            for k, m in patterns[j]:
                left[k] -= n * m
    return times, {k: v for k, v in left.items() if v}


def greedy(left: dict[int, int], window: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over what is left: fill a window with the longest lengths that fit, as many times at once as the counts allow."""
    left, lengths, out = dict(left), sorted(left), []
    while lengths:
        room, use = window, Counter()
        at = len(lengths)
        while room and at:
            at = bisect.bisect_right(lengths, room, 0, at)
            if not at:
                break
            k = lengths[at - 1]
            n = min(left[k], room // k)
            use[k] += n
            room -= n * k
            at -= 1
        times = min(left[k] // n for k, n in use.items())
        out.append((tuple(sorted(use.items())), times))
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                lengths.remove(k)
    return out


def plan(h: dict[int, int], window: int) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes, for the histogram ``h`` of lengths.

    Arrays of runs, sorted by (length, first rank): pieces of ``length`` with ranks from
    ``rank`` on go to sequences from ``sequence`` on, ``per`` to a sequence, the first at ``offset``.
    """
    h = {k: v for k, v in h.items() if v}
    full = h.pop(window, 0)
    patterns = shallow_patterns(h, window)
    times, left = round_down(patterns, nnls(patterns, h), h)
    chosen = [(((window, 1),), full)] if full else []
    chosen += [(p, n) for p, n in zip(patterns, times) if n] + greedy(left, window)
    used, sequence, runs = Counter(), 0, []
    for p, n in chosen:
        at = 0
        for k, m in sorted(p, reverse=True):
            runs.append((k, used[k], sequence, m, at))
            used[k] += n * m
            at += k * m
        sequence += n
    runs.sort()
    return {name: np.array([r[i] for r in runs], np.int64) for i, name in enumerate(("length", "rank", "sequence", "per", "offset"))}


def place(runs: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank among their length."""
    top = np.int64(1) << np.int64(44)
    i = np.searchsorted(runs["length"] * top + runs["rank"], length * top + rank, side="right") - 1
    k = rank - runs["rank"][i]
    per = runs["per"][i]
    return runs["sequence"][i] + k // per, runs["offset"][i] + (k % per) * length


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` ids.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document of
    more than ``window`` ids is cut at multiples of it; every id is in exactly one piece. A null
    or empty text has one id, ``end``; null and repeated ids are packed like others; an empty
    table gives no rows. Only the id and the text column are read.

    Only the histogram of piece lengths (at most ``window`` numbers) reaches the driver, and
    only the plan's runs (at most as many as patterns times three, and greedy fills) are
    broadcast. A piece's rank among those of its length comes from a counter in its task and
    from the counts of earlier tasks, so equal lengths are never sorted in one place.
    """
    spark = docs.sparkSession
    rows = common.two_columns(docs, id_col, text_col)

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        for ids, enc, kind in tokens.encoded(batches, tokenizer, end):
            out = []
            for d, e in zip(ids.to_pylist(), enc):
                raw = np.frombuffer(e, kind).astype("<u4").tobytes()
                n = len(raw) // 4
                for s in range(0, n, window):
                    m = min(window, n - s)
                    out.append((d, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n, seen[m]))
                    seen[m] += 1
            d, s, m, c, n, k = zip(*out)
            yield common.batch(part=pa.array([part] * len(d), pa.int32()), doc_id=pa.array(d, pa.int64()), start=pa.array(s, pa.int64()), length=pa.array(m, pa.int64()), ids_crc32=pa.array(c, pa.int64()), doc_tokens=pa.array(n, pa.int64()), k=pa.array(k, pa.int64()))

    pieces, _ = common.stage(rows.mapInArrow(cut, "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k long"), "pieces")
    per = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = per.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"), "n")
    before, _ = common.stage(before, "piece-counts")
    h = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(h, window))

    def put(batches):
        for b in batches:
            if b.num_rows:
                c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                q, o = place(runs.value, c["length"].to_numpy(), c["k"].to_numpy() + c["before"].to_numpy())
                yield common.batch(**{n: c[n] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, sequence_id=pa.array(q, pa.int64()), offset=pa.array(o, pa.int64()))

    # the counts grow with the number of tasks: never broadcast them
    ranked = pieces.join(before.select("part", "length", "before").hint("merge"), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "before")
    return ranked.mapInArrow(put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
