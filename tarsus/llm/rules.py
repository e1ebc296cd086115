"""Learned decision lists (operator 10): sequential covering of threshold conjunctions, as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, stats

#: Labelled rows that are learned from, at most; beyond it, those with the smallest hash of their id.
MAX_TRAIN = 40_000
#: A rule's length, the list's length, a rule's least precision on its pruning rows, and its least cover.
MAX_CONDITIONS, MAX_RULES, PRECISION, COVER = 4, 24, 0.97, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  #: value >= threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, stats.FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, f: str = "f") -> Column:
        v = F.col(f)[stats.FEATURES.index(self.feature)]
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, Condition] | None:
    """The threshold with the largest FOIL gain for y = True, over all features and both directions."""
    p0, n0 = y.sum(), (~y).sum()
    base = np.log2(p0 / (p0 + n0))
    best = None
    for k, name in enumerate(stats.FEATURES):
        o = np.argsort(x[:, k], kind="stable")
        v, t = x[o, k], y[o]
        cuts = np.flatnonzero(np.diff(v) > 0)  # between cuts and cuts + 1
        if not len(cuts):
            continue
        p_low, n_low = np.cumsum(t)[cuts], np.cumsum(~t)[cuts]
        for above in (False, True):
            p, n = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= least, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), Condition(name, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, least: int) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and y.any() and not y.all():
        got = best_condition(x, y, least)
        if got is None:
            break
        rule.append(got[1])
        keep = got[1].holds(x)
        x, y = x[keep], y[keep]
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The prefix of the rule with the largest (p - n) / (p + n) on rows it wasn't grown from; the shortest of equals."""
    def worth(r: Rule) -> float:
        c = covered(r, x)
        p, n = (c & y).sum(), (c & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 12), -len(r)))


def learn(x: np.ndarray, y: np.ndarray, ids: np.ndarray, least: int = COVER, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules for y = True, by sequential covering.

    Two thirds of the rows (by id) grow each rule, the rest prune it. Covering ends when a
    rule's precision on the pruning rows it covers is too low or it covers too few. With no
    rows of either label the list is empty.
    """
    prunes = stats.mix(ids.astype(np.uint64)) % np.uint64(3) == 0
    out: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(out) < MAX_RULES:
        g, q = left & ~prunes, left & prunes
        if (y & g).sum() < least or not (~y & g).any():
            break
        rule = grow(x[g], y[g], least)
        if not rule:
            break
        rule = prune(rule, x[q], y[q])
        c = covered(rule, x)
        p, n = (c & y & left).sum(), (c & ~y & left).sum()
        pq, nq = (c & y & q).sum(), (c & ~y & q).sum()
        if p < least or p < precision * (p + n) or pq < precision * (pq + nq):
            break
        out.append(rule)
        left &= ~c
    return out


def expression(rules: list[Rule], f: str = "f") -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column(f)
        for c in rule[1:]:
            cond = cond & c.column(f)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


def training(table: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = stats.labelled(table, labels, label).select("doc_id", "f", "y")
    n = rows.count()
    if n > most:  # a sample by hash of the id, of a documented size
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    got = rows.toArrow()
    got = got.take(np.lexsort((got["y"].to_numpy(), got["doc_id"].to_numpy()))).combine_chunks()
    f = got["f"].combine_chunks().flatten().to_numpy().reshape(-1, len(stats.FEATURES))
    return f, got["y"].to_numpy() == 0, got["doc_id"].to_numpy()


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every whole text with the verdict of a decision list that is learned for ``label`` = 0.

    Returns (doc_id, the base counts, base_failed, rule, kept) and the rules. One row for each
    input row; a null text counts as empty and a null id stays null (and isn't learned from). Without labels of both
    kinds there is no rule and only the base counts decide. ``rule`` is the number of the first
    rule that holds (0: none). ``most`` bounds the labelled rows that are learned from; the
    statistics and the verdicts cover every row and all of each text.
    """
    table, _ = common.stage(stats.table(docs, id_col, text_col), "statistics")
    rules = learn(*training(table, labels, label, most))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = table.select("doc_id", "text_hash", *stats.BASE, failed.alias("base_failed"), expression(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
