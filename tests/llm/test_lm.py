import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarsus.llm import lm

WORD = re.compile("[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


ROWS = [(i, " ".join(f"w{(i * 7 + j * j) % 11}" for j in range(3 + i % 9))) for i in range(60)] + [(60, None), (61, ""), (None, "W1 w2  w3"), (3, "w1 w2"), (3, "w1 w2"), (62, "É w1\x0bw1 é x " + "w5 w6 " * 400)]


def brute(rows, order, lam=None):
    """Counts, estimates with the own document deleted, and scores, by dictionaries."""
    def grams(t, k):
        w = [*["<s>"] * (k - 1), *tokens(t)]
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    train = [t for d, t in rows if not held(d)]
    c = [Counter(g for t in train for g in grams(t, k + 1)) for k in range(order)]
    n, v = sum(c[0].values()), len(c[0])
    return c, n, v, len(train), grams


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("block", [8_000_000, 300])
def test_score(spark, order, block, monkeypatch):
    seen = {}
    real = lm.learn

    def learn(cells, n, order, p0, **kw):
        seen["lam"] = real(cells, n, order, p0, **kw)
        return seen["lam"]

    monkeypatch.setattr(lm, "learn", learn)
    monkeypatch.setattr(lm, "BLOCK", block)
    df = spark.createDataFrame([(d, t, 1.0) for d, t in ROWS], "doc_id long, text string, score double").repartition(3)
    got = lm.score(df, order=order).collect()
    c, n, v, n_docs, grams = brute(ROWS, order)
    lam, want = seen["lam"], []
    for d, t in ROWS:
        w = tokens(t)
        base = sum(math.log10((c[0][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        s = 0.0
        g = [grams(t, k + 1) for k in range(order)]
        for i in range(len(w)):
            p = lam[0][0] * c[0][g[0][i]] / n + (1 - lam[0][0]) / (v + 1)
            for k in range(1, order):
                ctx = n_docs if i == 0 else c[k - 1][g[k - 1][i - 1]]
                a = lam[k][min(math.ceil(math.log2(ctx + 1)), lm.CONTEXTS - 1)]
                p = a * (c[k][g[k][i]] / max(ctx, 1)) + (1 - a) * p
            s += math.log10(p)
        want.append((str(d), held(d), len(w), sum(c[0][(x,)] > 0 for x in w), n, round(base, 6), round(s, 6)))
    key = lambda r: tuple(map(str, r))
    out = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    for a, b in zip(sorted(out, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def exact_em(p, b, order, p0, rounds=lm.ROUNDS):
    """Expectation-maximisation over the estimates themselves."""
    lam = [{0: 0.5}] + [{k: 0.5 if k else 0.0 for k in range(lm.CONTEXTS)} for _ in range(order - 1)]
    for _ in range(rounds):
        top, all_ = [Counter() for _ in lam], [Counter() for _ in lam]
        for t in range(len(p[0])):
            at = [0] + [b[k - 1][t] for k in range(1, order)]
            level = [lam[0][0] * p[0][t] + (1 - lam[0][0]) * p0]
            for k in range(1, order):
                level.append(lam[k][at[k]] * p[k][t] + (1 - lam[k][at[k]]) * level[-1])
            w = 1.0
            for k in range(order - 1, -1, -1):
                share = w * lam[k][at[k]] * p[k][t] / level[k]
                top[k][at[k]] += share
                all_[k][at[k]] += w
                w -= share
        lam = [{a: min(top[k][a] / all_[k][a], 1 - 1e-6) if all_[k][a] > 0 else v for a, v in lam[k].items()} for k in range(order)]
    return lam


@pytest.mark.parametrize("order", [2, 3])
def test_binned_weights_score_nearly_as_those_of_the_estimates_themselves(order):
    r = np.random.default_rng(order)
    n, p0 = 3000, 1e-4
    b = [r.integers(0, 8, n) for _ in range(order - 1)]
    p = [10 ** r.uniform(-5, -1, n)] + [np.where(r.random(n) < 0.3 + 0.08 * x, 10 ** r.uniform(-3, 0, n), 0) for x in b]
    key = np.zeros(n, np.int64)
    for x in reversed(b):
        key = key << 4 | x
    for x in reversed(p):
        key = key << 6 | lm.quantise(x)
    u, c = np.unique(key, return_counts=True)
    binned = lm.learn(u, c, order, p0)
    exact = exact_em(p, b, order, p0)
    exact = [np.array([v[k] for k in sorted(v)]) for v in exact]
    score = lambda lam: np.log10(lm.interpolate(p, b, lam, p0)).mean()
    assert score(exact) - score(binned) < 0.001  # log10 a token
    assert all(abs(x - y).max() < 0.06 for x, y in zip(binned, exact))


def test_only_held_out_rows(spark):
    ids = [i for i in range(60) if held(i)]
    got = lm.score(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(4, 0, 0, 0.0, 0.0)}


def test_weights_find_the_better_estimate():
    r = np.random.default_rng(0)
    x = r.integers(1, 20, 500) | r.integers(10, 30, 500) << 6 | r.integers(1, 16, 500) << 12
    a = lm.learn(x, np.ones(500, int), 2, 1e-4)
    assert all(((0 <= k) & (k < 1)).all() for k in a)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).collect() == []
    one = lm.score(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert len(one) == 1
