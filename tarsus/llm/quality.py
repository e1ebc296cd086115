"""Quality classifier (operator 3): random Fourier features, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, stats

#: Random features, kernel width (in standard deviations of a statistic, times the root of their number), ridge, partial sums, calibration bins.
N_RANDOM, WIDTH, RIDGE, PARTIALS, BINS = 256, 1.0, 1e-3, 8, 2000
FOLDS = (0, 1, 3)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  #: raw scores, ascending
    values: np.ndarray  #: calibrated probabilities there

    def raw(self, f: np.ndarray) -> np.ndarray:
        return expand(f, self.mean, self.scale, self.omega, self.phase) @ self.beta

    def score(self, f: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(f), self.knots, self.values)


def expand(f: np.ndarray, mean, scale, omega, phase) -> np.ndarray:
    """Standardised statistics and random Fourier features of a Gaussian kernel, with a constant."""
    z = np.clip((f - mean) / scale, -5, 5)
    return np.concatenate([np.sqrt(2 / omega.shape[1]) * np.cos(z @ omega + phase) * 4, z * 0.25, np.ones((len(f), 1))], 1)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x with ``ones`` of ``total``: knots and non-decreasing values, strictly inside 0 and 1."""
    blocks: list[list[float]] = []
    for a, n, k in sorted(zip(x, total, ones)):
        blocks.append([n, k, a, a])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n2, k2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + k2, blocks[-1][2], hi]
    value = [(k + 0.5) / (n + 1) for n, k, _, _ in blocks]
    value = np.maximum.accumulate(value)
    knots = np.array([p for _, _, lo, hi in blocks for p in (lo, hi)])
    values = np.repeat(value, 2) + np.linspace(0, 1e-6, 2 * len(value))  # ties between knots keep their order
    return knots, np.clip(values, 0, 1)


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", seed: int = 7) -> Model:
    """Learn from the labelled rows of a table of statistics whose fold (crc32 of the id as text, mod 4) is in FOLDS.

    All of them count: tasks sum their normal equations, PARTIALS tasks sum those sums, and
    only these reach the driver. Scores for calibration come from equations without the scored fold; they are
    counted in BINS bins before they are collected.
    """
    rows = stats.labelled(table, labels, label, id_col).withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)).cast("int")).filter(F.col("fold").isin(*FOLDS)).select("fold", "f", "y")
    rows, _ = common.stage(rows, "labelled")
    n_f = len(stats.FEATURES)
    m = rows.select(F.count("*"), *(g(F.col("f")[k]) for g in (F.avg, F.stddev_pop) for k in range(n_f))).first()
    mean, scale = (np.array([v or 0.0 for v in m[1 + s * n_f : 1 + (s + 1) * n_f]]) for s in (0, 1))
    scale = np.where(scale > 1e-9, scale, 1.0)
    r = np.random.default_rng(seed)
    omega = r.normal(size=(n_f, N_RANDOM)) / (WIDTH * np.sqrt(n_f))
    phase = r.uniform(0, 2 * np.pi, N_RANDOM)

    def sums(batches):
        acc: dict[int, list] = {}
        for b in batches:
            fold, f, y = b.column(0).to_numpy(), stats.features(b), b.column(2).to_numpy()
            for k in set(fold.tolist()):
                x, t = expand(f[fold == k], mean, scale, omega, phase), y[fold == k]
                a = acc.setdefault(k, [0, 0])
                a[0], a[1] = a[0] + x.T @ x, a[1] + x.T @ t
        for k, (xx, xy) in acc.items():
            yield common.batch(fold=pa.array([k], pa.int32()), payload=pa.array([np.concatenate([xx.ravel(), xy]).tobytes()], pa.binary()))

    size = N_RANDOM + n_f + 1
    per = {k: [np.zeros((size, size)), np.zeros(size)] for k in FOLDS}

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                acc[k] = acc.get(k, 0) + np.frombuffer(p)
        for k, v in acc.items():
            yield common.batch(fold=pa.array([k], pa.int32()), payload=pa.array([v.tobytes()], pa.binary()))

    partial = rows.mapInArrow(sums, "fold int, payload binary").repartition(PARTIALS).mapInArrow(add, "fold int, payload binary")
    for row in partial.collect():  # at most PARTIALS rows a fold
        v = np.frombuffer(row.payload)
        per[row.fold][0] += v[: size * size].reshape(size, size)
        per[row.fold][1] += v[size * size :]

    def solve(folds) -> np.ndarray:
        xx, xy = (sum((per[k][i] for k in folds), 0 * per[FOLDS[0]][i]) for i in (0, 1))
        return np.linalg.solve(xx + RIDGE * max(1.0, xx[-1, -1]) * np.eye(size), xy)

    beta = solve(FOLDS)
    without = {k: solve([x for x in FOLDS if x != k]) for k in FOLDS}

    def held_out(batches):
        for b in batches:
            fold, f = b.column(0).to_numpy(), stats.features(b)
            x = expand(f, mean, scale, omega, phase)
            s = np.zeros(len(f))
            for k in FOLDS:
                s[fold == k] = x[fold == k] @ without[k]
            yield common.batch(bin=pa.array(np.clip(np.floor((s + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)), y=b.column(2))

    bins = rows.mapInArrow(held_out, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect()
    if not bins:
        return Model(mean, scale, omega, phase, beta, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    knots, values = isotonic(np.array([(r.bin + 0.5) * 2 / BINS - 0.5 for r in bins]), np.array([r.n for r in bins]), np.array([r.k for r in bins]))
    return Model(mean, scale, omega, phase, beta, knots, values)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) and text_hash for every whole text.

    One row for each input row, repeated ids included. A null or empty text has the statistics
    of an empty text and gets their score; a null id has fold crc32('') and is never learned
    from. With no labelled row every score is 0.5. Scores depend on the text alone.
    """
    table, _ = common.stage(stats.table(docs, id_col, text_col), "statistics")
    model = table.sparkSession.sparkContext.broadcast(fit(table, labels, label, id_col))

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.clip(model.value.score(stats.features(b)), 0, 1)
                yield common.batch(doc_id=b.column(0), score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)), text_hash=b.column(2))

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    return table.select("doc_id", "f", "text_hash").mapInArrow(run, "doc_id long, score double, predicted int, text_hash long").select("doc_id", (fold == 2).alias("held_out"), "score", "predicted", "text_hash")


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``score`` would predict 1 for, with all their columns. Texts are read twice, to learn and to judge, and never shuffled."""
    table, _ = common.stage(stats.table(docs, id_col, text_col), "statistics")
    model = table.sparkSession.sparkContext.broadcast(fit(table, labels, label, id_col))

    def verdict():
        def judge(raw: list[bytes]) -> np.ndarray:
            s = stats.statistics(raw)
            return np.clip(model.value.score(np.stack([s[k] for k in stats.FEATURES], 1).astype(np.float64)), 0, 1) >= threshold

        return judge

    return common.keep_rows(docs, verdict, text_col)
