import random

import numpy as np

from tarsus.llm import decontam

R = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(R.choice(VOCAB[: R.choice((20, 400))]) for _ in range(n))


ITEMS = [(i, prose(R.randrange(8, 40))) for i in range(30)] + [(30, "One"), (31, ""), (32, None), (33, prose(12))]


def brute(rows, items, threshold, overlap):
    """Every passage against every item with the plain formula."""
    x = decontam.build([(i, t, None) for i, t in items])
    bags = {i: decontam.words(t or "") for i, t in items if decontam.words(t or "")}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    idf = lambda t: np.log1p((n - (k := sum(t in b for b in bags.values())) + 0.5) / (k + 0.5))
    weight = {i: {t: idf(t) * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in set(b)} for i, b in bags.items()}
    out = set()
    for d, t in rows:
        w = decontam.words(t or "")
        for k in range(max(1, -(-len(w) // x.half))):
            p = w[k * x.half : (k + 2) * x.half]
            have = decontam.shingles(p, 3)
            for j, i in enumerate(x.ids):
                s = sum(v for t, v in weight[i].items() if t in p) / sum(weight[i].values())
                q, a = (decontam.shingles(v.split(), 3) for v in x.parts[j])
                if s >= threshold - 1e-9 and len(q & have) >= overlap * max(1, len(q)) and (not a or len(a & have) >= overlap * len(a)):
                    out.add((d, i))
    return out


def test_against_brute_force(spark):
    rows = [(i, prose(R.randrange(0, 300))) for i in range(40)]
    for i in range(40, 60):
        a = ITEMS[i % 30][1]
        rows.append((i, prose(R.randrange(0, 150)) + " " + (a.upper() if i % 3 else a.replace(" ", ",\n")) + " " + prose(R.randrange(0, 400))))
    rows += [(90, None), (91, ""), (None, ITEMS[2][1]), (92, "one"), (93, "x " * 3000 + ITEMS[4][1] + " y" * 3000)]
    docs = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(rows, ITEMS, decontam.THRESHOLD, decontam.OVERLAP)
    got = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(i, ITEMS[i % 30][0]) for i in range(40, 60)} <= want
    assert sorted(map(tuple, decontam.contaminated(docs, items, indexed=7).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_wand_finds_what_scoring_everything_finds():
    r = np.random.default_rng(4)
    for trial in range(30):
        items = [(i, " ".join(f"t{k}" for k in r.zipf(1.3, r.integers(1, 30)) % 200), None) for i in range(r.integers(1, 120))]
        x = decontam.build(items)
        n = 40
        have = r.random((n, len(x.terms))) < r.uniform(0.02, 0.7)
        passage, term = (v.astype(np.int64) for v in np.nonzero(have))
        least = r.uniform(0.1, 0.9)
        p, j, s = decontam.retrieve(x, passage, term, least)
        dense = np.zeros((len(x.terms), len(x.ids)))
        of = np.repeat(np.arange(len(x.terms)), np.diff(x.post_at[x.block_at]))
        dense[of, x.item] = x.weight
        want = have @ dense
        assert sorted(zip(p.tolist(), j.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(want >= least - 1e-9))))
        assert np.allclose(s, want[p, j])


def test_wand_skips_blocks():
    r = np.random.default_rng(7)
    items = [(i, " ".join(f"t{k}" for k in r.zipf(1.2, 40) % 5000), None) for i in range(4000)]
    x = decontam.build(items)
    texts = [[f"t{k}".encode() for k in r.zipf(1.2, 300) % 5000] for _ in range(40)] + [items[5][1].encode().split()]
    decontam.walked.update(pivots=0, scored=0, blocks=0)
    assert decontam.search(x, texts, 0.5, 0.5, 3)
    w = decontam.walked
    assert w["pivots"] and w["scored"] < w["blocks"] / 20 and w["scored"] < 41 * 13 * len(x.ids) / decontam.BLOCK_ITEMS / 10


def test_altered_copies_are_found():
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(15, 60))), None) for i in range(300)]
    x = decontam.build(items)
    texts, alter = [], lambda w: " ".join(r.choice(vocab) if r.random() < 0.1 else y for y in w.split())
    for _, t, _ in items:
        texts.append(decontam.words(" ".join(r.choice(vocab) for _ in range(r.randrange(200))) + " " + alter(t) + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(200)))))
    found = {(h[0], x.ids[h[1]]) for h in decontam.search(x, texts, decontam.THRESHOLD, decontam.OVERLAP, decontam.SHINGLE)}
    assert sum((i, i) in found for i in range(300)) >= 270 and len(found) <= 303


def test_repeated_rows_and_clashing_names(spark):
    a, b = ITEMS[3][1], ITEMS[4][1]
    docs = spark.createDataFrame([(1, a, "x", 5, 1), (1, a, "x", 5, 1), (None, a, "y", 6, 1), (1, b, "y", 6, 1)], "doc_id long, text string, q string, item_id int, block int")
    items = spark.createDataFrame([(7, a, 1, "t"), (7, a, 1, "t"), (None, b, 2, "t")], "item_id long, text string, block int, term string")
    for indexed in (100, 1):
        got = sorted(((str(r.doc_id), str(r.item_id)) for r in decontam.contaminated(docs, items, indexed=indexed).collect()))
        assert got == sorted([("1", "7")] * 4 + [("None", "7")] * 2 + [("1", "None")])


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, items).collect() == []
    assert decontam.contaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items).collect() == []
    assert decontam.contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
