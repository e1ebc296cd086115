import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarsus.llm import packing, queries


@pytest.mark.parametrize("case", range(5))
def test_plan_places_each_piece_once(case):
    r = np.random.default_rng(case)
    window = 256
    lengths = [r.integers(1, 257, 4000), np.full(300, 256), np.full(999, 100), np.minimum(256, r.geometric(0.02, 5000)), np.array([], int)][case]
    h = Counter(lengths.tolist())
    runs = packing.plan(h, window)
    n, fill = [], defaultdict(list)
    for k, c in h.items():
        q, o = packing.place(runs, np.full(c, k), np.arange(c))
        for a, b in zip(q.tolist(), o.tolist()):
            fill[a].append((b, k))
        n.append(c)
    for pieces in fill.values():
        at = 0
        for o, k in sorted(pieces):
            assert o == at
            at += k
        assert at <= window
    assert sum(len(p) for p in fill.values()) == sum(n)
    if case in (0, 3):
        assert sum(lengths) / (window * len(fill)) > (0.97 if case == 0 else 0.99)


def test_nnls_is_optimal_on_a_small_case():
    h = {100: 10, 156: 10, 256: 0, 56: 5}
    p = [((100, 1), (156, 1)), ((100, 2), (56, 1))]
    x = packing.nnls(p, {k: v for k, v in h.items() if v})
    assert (x >= 0).all() and abs(x[0] - 8.9) < 1.5


def test_pack(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, "a b c " * 100), (2, None), (2, ""), (None, "x"), (3, "Long text. " * 3000), (4, "hello " * 63), (4, "hello " * 63)]
    df = spark.createDataFrame([(d, x, 0) for d, x in rows], "doc_id long, text string, length int").repartition(2)
    got = packing.pack(df, path, window=64).collect()
    ids = {}
    for d, x in rows:
        e = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        ids.setdefault(str(d), []).append(e)
    per = defaultdict(list)
    for r in got:
        per[str(r.doc_id)].append(r)
    for d, docs in ids.items():
        want = sorted((s, len(e[s : s + 64]), zlib.crc32(np.array(e[s : s + 64], "<u4").tobytes()), len(e)) for e in docs for s in range(0, len(e), 64))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in per[d]) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == np.r_[0, np.cumsum([n for _, n in sorted(s)])][:-1].tolist() and sum(n for _, n in s) <= 64
    assert packing.pack(df.limit(0), path, window=64).collect() == []
