import hashlib

import numpy as np
import pytest

from tarsus.llm import common, suffix


def test_anchors_own_each_window_once():
    r = np.random.default_rng(1)
    for length in (2, 7, 20, 50):
        for _ in range(40):
            docs = [r.integers(97, 97 + r.integers(1, 4), r.integers(0, 3 * length)).astype(np.uint8) for _ in range(6)]
            a, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
            p, h, first, last = suffix.anchors(a, ends, length)
            got = sorted(s for f, l in zip(first, last) for s in range(f, l + 1))
            want = [s for lo, hi in zip([0, *ends[:-1]], ends) for s in range(lo, hi - length + 1)]
            assert got == want
            by = {}
            for x, y, f, l in zip(p, h, first, last):
                for s in range(f, l + 1):
                    key = a[s : s + length].tobytes()
                    assert by.setdefault(key, (y, x - s)) == (y, x - s)  # equal windows, equal anchors


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(2)
    for n in (0, 1, 9, 200, 1000):
        for k in (1, 2, 4, 250):
            a = r.integers(1, 1 + k, n).astype(np.uint8)
            sa, words = suffix.suffix_array(a)
            t = a.tobytes()
            assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
            lcp = suffix.common_prefixes(sa, words, 50) if n else []
            for i in range(1, n):
                x, y = t[sa[i - 1] :], t[sa[i] :]
                m = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                assert lcp[i] == min(m, 50)


def test_suffix_array_of_strings():
    r = np.random.default_rng(6)
    for _ in range(200):
        k = r.integers(1, 4)
        s = [bytes(r.integers(0, k, r.integers(0, 40)).astype(np.uint8)) for _ in range(r.integers(1, 9))]
        s += s[: r.integers(0, 3)]
        a, lens = np.frombuffer(b"".join(s), np.uint8), np.array(list(map(len, s)))
        sa, words = suffix.suffix_array(a, lens)
        at = [(i, j) for i, x in enumerate(s) for j in range(len(x))]
        order = sorted(range(len(at)), key=lambda q: (s[at[q][0]][at[q][1] :], at[q][0]))
        assert sa.tolist() == order
        lcp = suffix.common_prefixes(sa, words, 20, lens=lens)
        for q in range(1, len(order)):
            x, y = (s[at[o][0]][at[o][1] :] for o in order[q - 1 : q + 1])
            assert lcp[q] == min(20, next((j for j, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y))))


def test_stretches_of_a_block_are_parted_by_bytes(monkeypatch):
    """Even if all spans hash alike, only stretches of equal bytes count as one."""
    r = np.random.default_rng(8)
    monkeypatch.setattr(suffix.Hashed, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    for _ in range(30):
        docs = [bytes(r.integers(97, 100, r.integers(0, 90)).astype(np.uint8)) for _ in range(12)]
        docs += docs[:4]
        row = {"ids": np.arange(16)[::-1].astype(np.int64).tobytes(), "lens": np.array(list(map(len, docs))).tobytes(), "text": b"".join(docs)}
        length = int(r.choice([6, 30]))
        row["anchors"] = suffix.pack_anchors(np.frombuffer(row["text"], np.uint8), np.array(list(map(len, docs))), length)
        b = suffix.Block(row, length)
        n = len(b.keys()[0])
        x = b.stretches({0: suffix.struct.pack("<Q", n) + suffix.pack_bits(np.tile([True, False], n))})
        text = lambda f, l: b.a[f : l + length].tobytes()  # noqa: E731, B023
        for f, l, i, p in zip(x.all_first, x.all_last, x.all_ids, x.place):
            assert text(f, l) == text(x.first[p], x.last[p]) and x.least[p] <= i


def test_shards_merge():
    r = np.random.default_rng(3)
    suffix.merged.update(shards=0, looked_up=0)
    for _ in range(80):
        length = int(r.choice([20, 5]))
        s = list(dict.fromkeys(bytes(r.integers(97, 97 + r.integers(1, 3), r.integers(length, 2 * length)).astype(np.uint8)) for _ in range(r.integers(1, 30))))
        least = r.integers(0, 9, len(s))
        got = suffix.seen_earlier(np.frombuffer(b"".join(s), np.uint8), np.array(list(map(len, s))), least, length, shard_bytes=int(r.integers(30, 400)))
        low = {}
        for x, m in zip(s, least):
            for i in range(len(x) - length + 1):
                low[x[i : i + length]] = min(low.get(x[i : i + length], 99), m)
        assert got.tolist() == [i + length <= len(x) and low[x[i : i + length]] < m for x, m in zip(s, least) for i in range(len(x))]
    assert suffix.merged["shards"] > 160 and suffix.merged["looked_up"] > 1000


def brute(rows, length):
    first = {}
    big = 1 << 62
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], big), big - 1 if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (big - 1 if d is None else d):
                cut[i : i + length] = b"\1" * length
        rest = bytes(x for x, y in zip(b, cut) if not y)
        spans = sum(1 for i, y in enumerate(cut) if y and (i == 0 or not cut[i - 1]))
        out.append((str(d), len(b), sum(cut), spans, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out)


@pytest.mark.parametrize("block,partitions,hot", [(2_000_000, 1 << 14, 500), (400, 1 << 14, 500), (400, 2, 2), (2000, 4, 1)])
def test_remove_repeats(spark, block, partitions, hot, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    monkeypatch.setattr(common, "MOST_PARTITIONS", partitions)
    real = suffix.answer_anchors
    monkeypatch.setattr(suffix, "answer_anchors", lambda p: real(p, hot))
    r = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "été", "漢字", "x"]
    passage = " ".join(r.choice(words, 30))
    rows = [(int(i), " ".join(r.choice(words, r.integers(0, 60)))) for i in r.permutation(40)]
    rows += [(100 + i, f"lead {i} " + passage + f" tail {i}") for i in range(6)]
    rows += [(3, None), (7, ""), (None, passage), (None, passage), (50, passage), (50, passage), (200, "a" * 3000), (201, "b" + "a" * 500)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_removed int, kept string").repartition(3)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in suffix.remove_repeats(df, length=50).collect())
    assert got == brute(rows, 50)


def test_hot_anchors_keep_every_window(spark, monkeypatch):
    """Windows around one anchor that most blocks hold are the same whether it is parted by its context or not."""
    monkeypatch.setattr(common, "BLOCK_BYTES", 300)
    r = np.random.default_rng(5)
    core = "the very same twenty-five characters, or a few more"
    rows = [(i, "".join(r.choice(list("ab"), int(r.integers(0, 30)))) + core + "".join(r.choice(list("ab"), int(r.integers(0, 30))))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real = suffix.answer_anchors
    for hot in (2, 10**6):
        monkeypatch.setattr(suffix, "answer_anchors", lambda p, hot=hot: real(p, hot))
        got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in suffix.remove_repeats(df, length=50).collect())
        assert got == brute(rows, 50)


def test_buckets_are_settled_in_parts(monkeypatch):
    """However full a bucket is, hashes and suffix arrays are of about part_bytes at once; answers are those of all windows together."""
    r = np.random.default_rng(9)
    held = []

    class Noted(suffix.Hashed):
        def __init__(self, a):
            held.append(len(a))
            super().__init__(a)

    monkeypatch.setattr(suffix, "Hashed", Noted)
    length, payloads, sent, low = 20, [], [], {}
    kinds = [bytes(r.integers(97, 123, r.integers(length, 2 * length)).astype(np.uint8)) for _ in range(256)]
    for _ in range(60):
        at = np.sort(r.integers(0, 256, r.integers(0, 40)))
        mine = [(kinds[k][int(r.integers(0, len(kinds[k]) - length + 1)) :], int(r.integers(0, 50))) for k in at.tolist()]
        lens, ids = np.array([len(t) for t, _ in mine], np.int64), np.array([i for _, i in mine], np.int64)
        payloads.append(suffix.pack_stretches(lens, ids, at.astype(np.uint64), np.frombuffer(b"".join(t for t, _ in mine), np.uint8)))
        sent.append(mine)
        for t, i in mine:
            for j in range(len(t) - length + 1):
                low[t[j : j + length]] = min(low.get(t[j : j + length], 99), i)
    want = [[low[t[j : j + length]] < i for t, i in mine for j in range(len(t) - length + 1)] for mine in sent]
    for part_bytes in (3000, 1):  # 1: each key is a part
        held.clear()
        got = list(suffix.answer_stretches(payloads, length, part_bytes))
        assert [suffix.unpack_bits({0: g}, len(w)).tolist() for g, w in zip(got, want, strict=True)] == want
        assert len(held) > 5 and (max(held) <= part_bytes or part_bytes == 1)
    assert list(suffix.answer_stretches([suffix.pack_stretches(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint8)))], 20)) == [bytes(8)]


def test_staged_blocks_have_small_row_groups(spark):
    """A row group is a few blocks: the JVM holds it whole while it is written and read."""
    import glob

    import pyarrow.parquet as pq

    r = np.random.default_rng(10)
    rows = [(i, r.integers(97, 123, 1_000_000).astype(np.uint8).tobytes().decode()) for i in range(64)]
    _, path = suffix.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text", 50)
    sizes = [m.row_group(i).total_byte_size for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(sizes) > 64_000_000 and max(sizes) < 14_000_000


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
