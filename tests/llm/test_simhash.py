import numpy as np
import pytest

from tarsus.llm import simhash


def brute(keys, budget):
    return {(int(min(a, b)), int(max(a, b))) for i, a in enumerate(keys) for b in keys[i + 1 :] if int(a ^ b).bit_count() <= budget}


def cluster(n, seed=0):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 8, dtype=np.uint64)
    out = [base[r.integers(8)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, r.integers(1, 4)).astype(np.uint64)) for _ in range(n)]
    return np.unique(np.array([*out, 0, 1, 3, 7], np.uint64))


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_self_join(budget):
    keys = cluster(400)
    got = simhash.trie_self_join(keys, budget)
    pairs = {(int(keys[i]), int(keys[j])) for i, j in got}
    assert len(got) == len(pairs) and pairs == brute(keys, budget)


def test_the_trie_carries_the_join():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    simhash.walked.update(parted=0, compared=0)
    simhash.trie_self_join(keys, 2)
    assert simhash.walked["parted"] > 10 * len(keys) and simhash.walked["compared"] < len(keys) ** 2 / 200


def test_shard_bits():
    assert [simhash.shard_bits(n, 2, 100) for n in (0, 100, 199, 200, 800, 801, 10**12)] == [0, 0, 0, 1, 3, 3, 21]


@pytest.mark.parametrize("shard,hot", [(100_000, 1_000_000), (10, 1_000_000), (10, 1), (100_000, 1), (40, 30)])
def test_close_pairs(spark, shard, hot):
    keys = cluster(300, 1)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    rows = simhash.close_pairs(df, 2, shard, hot).collect()
    got = {tuple(sorted(((r.a) & (2**64 - 1), (r.b) & (2**64 - 1)))) for r in rows}
    assert len(rows) == len(got) and got == brute(keys, 2)


@pytest.mark.parametrize("small", [10**6, 0])
def test_near_duplicates(spark, small):
    import xxhash

    text = " ".join(f"word{i}" for i in range(300))
    docs = [(5, text), (3, text.upper()), (9, text + " tail"), (1, None), (2, ""), (None, "x y"), (7, "x  y"), (7, "x  y"), (8, " \t\n")]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, fingerprint string, n long")
    got = simhash.near_duplicates(df, small=small).collect()

    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = [fp(t) for _, t in docs]
    n = len(docs)
    link = [[j for j in range(n) if j != i and (f[i] ^ f[j]).bit_count() <= 2] for i in range(n)]

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)

    want = sorted((str(docs[i][0]), f"{f[i]:016x}", len(link[i]), reach(i)) for i in range(n))
    assert sorted((str(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in got) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
