import random
import re

import numpy as np
import pytest

from tarsus.llm import quality, rules, stats


def brute(t):
    w = re.findall("[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def test_statistics():
    r = random.Random(0)
    bits = ["a", "b b", "é", "\n", "\n\n", " ", "\t", "\x0b", "#", "|x", "a b c d e f g h i", " ", "漢", "line one\n", "\r\n"]
    texts = ["", " ", "\n", *(" ".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)), "x y z w " * 50]
    got = stats.statistics([t.encode() for t in texts])
    assert np.stack([got[k] for k in stats.BASE], 1).tolist() == [list(brute(t)) for t in texts]
    assert all(np.isfinite(got[k]).all() for k in stats.FEATURES)


def corpus(n=400):
    r = random.Random(1)
    rows, labs = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"word{r.randrange(500)}" for _ in range(r.randrange(25, 120))]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w) + "."))
        labs.append((i, 0 if bad else 1, 0))
    return rows, labs


EXTRA = [(1000, None), (1001, ""), (None, "null id"), (3, "short"), (3, "short"), (1002, "very long " * 20_000)]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labs = corpus()
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows + EXTRA], "doc_id long, text string, score double, f int").cache()
    return docs, spark.createDataFrame([*labs, (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int").cache()


def test_rules(spark, tables):
    docs, labs = tables
    out, learned = rules.judge(docs, labs)
    got = out.collect()
    assert len(got) == docs.count() and learned
    ok = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 3}
    assert all(ok[i] == (i % 4 != 0) for i in ok)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    x, y, ids = rules.training(stats.table(docs, "doc_id", "text"), labs, "quality", 10**6)
    by = {c: k for k, rule in reversed(list(enumerate(learned, 1))) for c in ids[rules.covered(rule, x)].tolist()}
    assert all(by.get(r.doc_id, 0) == r.rule for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 3)
    assert rules.judge(docs.limit(0), labs)[0].collect() == []
    assert rules.judge(docs, labs.limit(0))[1] == []


def test_quality(spark, tables):
    import zlib

    docs, labs = tables
    got = quality.score(docs, labs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.95
    flipped = labs.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 4) = 2 then 1 - quality else quality end as quality")
    assert {(r.doc_id, r.score) for r in quality.score(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}  # held-out labels teach nothing
    assert quality.score(docs.limit(0), labs).collect() == []
    assert {r.score for r in quality.score(docs, labs.limit(0)).collect()} == {0.5}


def brute_scores(rows, y):
    """Scores of (id, text) by ridge on whole matrices, out-of-fold scores and plain pooling; ``y``: labels by id."""
    import zlib

    rows = [(d, (t or "").encode()) for d, t in rows]
    raw = stats.statistics([t for _, t in rows])
    f = np.stack([raw[k] for k in stats.FEATURES], 1).astype(float)
    fold = np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 4 for d, _ in rows])
    learn = np.array([d in y and k != 2 for (d, _), k in zip(rows, fold)])
    t = np.array([y.get(d, 0) for d, _ in rows], float)
    mean, sd = f[learn].mean(0), f[learn].std(0)
    sd = np.where(sd > 1e-9, sd, 1)
    r = np.random.default_rng(7)
    n = quality.N_RANDOM
    omega, phase = r.normal(size=(f.shape[1], n)) / (quality.WIDTH * np.sqrt(f.shape[1])), r.uniform(0, 2 * np.pi, n)
    z = np.clip((f - mean) / sd, -5, 5)
    x = np.concatenate([4 * np.sqrt(2 / n) * np.cos(z @ omega + phase), z / 4, np.ones((len(z), 1))], 1)
    ridge = lambda rows: np.linalg.lstsq(np.vstack([x[rows], np.sqrt(quality.RIDGE * max(1, rows.sum())) * np.eye(x.shape[1])]), np.r_[t[rows], np.zeros(x.shape[1])], rcond=None)[0]
    held = np.zeros(len(rows))
    for k in quality.FOLDS:
        held[fold == k] = x[fold == k] @ ridge(learn & (fold != k))
    bins = np.clip(np.floor((held + 0.5) * quality.BINS / 2), 0, quality.BINS - 1).astype(int)
    points = sorted((b, int((bins[learn] == b).sum()), t[learn & (bins == b)].sum()) for b in set(bins[learn].tolist()))
    level = [max(min(sum(k for *_, k in points[i : j + 1]) / sum(c for _, c, _ in points[i : j + 1]) for j in range(m, len(points))) for i in range(m + 1)) for m in range(len(points))]  # the min-max formula
    groups = []
    for (b, c, k), v in zip(points, level):
        if groups and abs(groups[-1][0] - v) < 1e-12:
            groups[-1][1:] = [groups[-1][1] + c, groups[-1][2] + k, groups[-1][3], b]
        else:
            groups.append([v, c, k, b, b])
    value = np.maximum.accumulate([(k + 0.5) / (c + 1) for _, c, k, _, _ in groups])
    at = lambda b: (b + 0.5) * 2 / quality.BINS - 0.5
    return np.interp(x @ ridge(learn), [at(b) for g in groups for b in g[3:]], np.repeat(value, 2))


def test_quality_against_dense_ridge_and_plain_isotonic(spark, tables):
    docs, labs = tables
    y = {r.doc_id: r.quality for r in labs.collect() if r.doc_id is not None and r.quality in (0, 1)}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_scores(rows, y)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in quality.score(docs, labs).collect())
    pairs = list(zip(got, sorted((str(d), round(s, 4)) for (d, _), s in zip(rows, want))))
    assert len(pairs) == len(rows) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in pairs)
    kept = sorted(str(r.doc_id) for r in quality.keep(docs, labs).collect())
    assert kept == sorted(str(r.doc_id) for r in quality.score(docs, labs).filter("predicted = 1").collect()) and quality.keep(docs, labs).columns == docs.columns


def brute_gain(x, y, least):
    """Every threshold between neighbouring values, one by one."""
    p0, n0 = y.sum(), (~y).sum()
    best = None
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        for above in (False, True):
            for c in (v[:-1] + v[1:]) / 2:
                hit = x[:, k] >= c if above else x[:, k] <= c
                p, n = (hit & y).sum(), (hit & ~y).sum()
                if p >= least:
                    g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if g > 1e-9 and (best is None or g > best[0] + 1e-12):
                        best = g, k, above, c
    return best


def brute_list(x, y, ids, least=rules.COVER, precision=rules.PRECISION):
    """Sequential covering with plain loops."""
    prunes, out, left = stats.mix(ids.astype(np.uint64)) % np.uint64(3) == 0, [], np.ones(len(y), bool)
    hold = lambda r: np.all([x[:, k] >= c if above else x[:, k] <= c for k, above, c in r], axis=0) if r else np.ones(len(y), bool)
    while len(out) < rules.MAX_RULES:
        g, q = left & ~prunes, left & prunes
        if (y & g).sum() < least or not (~y & g).any():
            break
        rule, inside = [], g.copy()
        while len(rule) < rules.MAX_CONDITIONS and y[inside].any() and not y[inside].all():
            got = brute_gain(x[inside], y[inside], least)
            if got is None:
                break
            rule.append(got[1:])
            inside = g & hold(rule)
        if not rule:
            break

        def worth(r):
            p, n = (hold(r) & y & q).sum(), (hold(r) & ~y & q).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 12), -len(r)))
        c = hold(rule)
        p, n, pq, nq = ((c & a & b).sum() for a, b in ((y, left), (~y, left), (y, q), (~y, q)))
        if p < least or p < precision * (p + n) or pq < precision * (pq + nq):
            break
        out.append(rule)
        left &= ~c
    return out


def test_rules_against_plain_sequential_covering():
    r, found = np.random.default_rng(3), 0
    for _ in range(6):
        x = np.round(r.normal(size=(240, len(stats.FEATURES))), 1)
        a, b, c = r.permutation(len(stats.FEATURES))[:3]
        y = (x[:, a] > 0.8) | ((x[:, b] < -0.5) & (x[:, c] > 0.3))
        ids = r.permutation(1000)[:240]
        got = [[(stats.FEATURES.index(c.feature), c.above, c.threshold) for c in rule] for rule in rules.learn(x, y, ids)]
        assert got == [[(int(k), bool(above), float(c)) for k, above, c in rule] for rule in brute_list(x, y, ids)]
        found += len(got)
    assert found


def test_isotonic():
    x, v = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([10, 10, 10, 10]), np.array([1, 5, 3, 9]))
    assert (np.diff(v) > 0).all() and (0 < v).all() and (v < 1).all()
