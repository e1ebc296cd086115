import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from tarsus.llm import common, decontam, queries, simhash

from .test_decontam import brute as brute_items
from .test_rules_quality import brute_scores
from .test_suffix import brute as brute_suffix


def make(spark, path):
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n)).capitalize() + "."
    items = [(i, prose(25)) for i in range(5)]
    docs, labs = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = prose(r.randrange(60, 200))
        if bad:
            t = " ".join(x.upper() + "!!" for x in t.split())
        docs.append((i, t))
        labs.append((i, 0 if bad else 1, 0))
    good = [t for i, t in docs if i % 4]
    docs += [(300 + k, good[k]) for k in range(6)]  # copies
    docs += [(310, good[0] + " End."), (320, good[9] + " " + prose(120)), (321, prose(90) + " " + items[2][1] + " " + prose(50)), (None, prose(80)), (330, None), (331, ""), (305, good[5]), (305, good[5])]
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.5, "x") for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labs, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def rows(df):
    return sorted(((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, tmp_path):
    d = f"file://{tmp_path}/t"
    make(spark, d)
    docs = queries.table(spark, d, "documents")
    columns = docs.columns
    # 1: exactly those the classifier accepts
    out = C.keep_quality(spark, docs, d)
    before = docs.collect()
    scores = brute_scores([(r.doc_id, r.text) for r in before], {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()})
    assert np.abs(scores - 0.7).min() > 1e-3  # none is a matter of rounding
    assert rows(out) == sorted(((str(r.doc_id), r.text) for r, s in zip(before, scores) if s >= 0.7), key=str)
    kept = {r.doc_id for r in out.collect()}
    assert not any(i % 4 == 0 for i in kept if i is not None and i < 240) and sum(i is not None and i < 240 for i in kept) > 170
    docs, _ = common.stage(out, "one")
    # 2: one of each group, the smallest id
    out = C.keep_one_of_near_duplicates(spark, docs, d)
    before = docs.collect()
    fps = simhash.fingerprints([(r.text or "").encode() for r in before])
    n = len(before)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    big = 1 << 62
    want = [min(g, key=lambda i: big if before[i].doc_id is None else before[i].doc_id) for g in groups.values()]
    assert rows(out) == sorted(((str(before[i].doc_id), before[i].text) for i in want), key=str)
    docs, _ = common.stage(out, "two")
    # 3: what is left of each text
    out = C.cut_repeats(spark, docs, d)
    left = [(i, rest.decode("utf-8", "ignore")) for i, _, cut, _, _, rest in brute_suffix([(r.doc_id, r.text) for r in docs.collect()], 50) if rest or not cut]
    assert [(i, t or "") for i, t in rows(out)] == sorted(left, key=str)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    docs, _ = common.stage(out, "three")
    # 4: none with a test item
    out = C.drop_benchmark(spark, docs, d)
    before = docs.collect()
    hits = {k for k, _ in brute_items([(k, r.text) for k, r in enumerate(before)], [tuple(r) for r in queries.table(spark, d, "benchmark").select("item_id", "text").collect()], decontam.THRESHOLD, decontam.OVERLAP)}
    assert hits and rows(out) == sorted(((str(r.doc_id), r.text) for k, r in enumerate(before) if k not in hits), key=str)
    assert out.columns == columns
    # 5 and run(): every document is packed whole
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want, pieces = [], C.run(spark, d).collect()
    for i, text in rows(out):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == sorted(want)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 4096


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """One row of each group, whatever its ids."""
    t = [" ".join(f"{x}{i}" for i in range(200)) for x in "abc"]
    near = lambda x: x + " z"
    make = lambda rows: spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id long, text string, component string, least int")
    groups = lambda rows: len({tuple(sorted(g)) for g in linked([x for _, x in rows])})

    def linked(texts):
        f = simhash.fingerprints([(x or "").encode() for x in texts])
        out = [{i} for i in range(len(f))]
        for i in range(len(f)):
            for j in range(i):
                if int(f[i] ^ f[j]).bit_count() <= 2 and out[i] is not out[j]:
                    out[i] |= out[j]
                    for k in list(out[i]):
                        out[k] = out[i]
        return out

    for rows_ in (
        [(None, t[0]), (None, t[0]), (None, near(t[0])), (None, t[1])],
        [(7, t[0]), (7, near(t[0])), (8, t[0] + " y"), (9, t[1]), (9, t[1])],
        [(None, None), (None, ""), (3, " "), (None, t[2]), (2, t[2]), (2, t[2])],
        [(1, t[0] * 400), (None, t[0] * 400), (5, t[1])],
    ):
        out = C.keep_one_of_near_duplicates(spark, make(rows_), "").collect()
        assert len(out) == groups(rows_)
        for g in {tuple(sorted(g)) for g in linked([x for _, x in rows_])}:
            ids = [rows_[i][0] for i in g if rows_[i][0] is not None]
            kept = [r.doc_id for r in out if (r.doc_id, r.text) in {rows_[i] for i in g}]
            assert kept == [min(ids) if ids else None]


def test_very_long_texts_and_clashing_names(spark, tmp_path):
    d = f"file://{tmp_path}/long"
    make(spark, d)
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(900)}" for _ in range(60_000)).capitalize() + "."
    item = queries.table(spark, d, "benchmark").first().text
    rows_ = [(1, long), (2, long[:200_000] + " " + item + long[200_000:]), (3, long), (4, "Short " + long[:3000])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x), 0.0, "h", 1, "f") for i, x in rows_], "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash string, block int, f string")
    scores = brute_scores(rows_, {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()})
    assert rows(C.keep_quality(spark, docs, d)) == sorted(((str(i), x) for (i, x), s in zip(rows_, scores) if s >= 0.7), key=str)
    assert {i for i, _ in rows(C.drop_benchmark(spark, docs, d))} == {"1", "3", "4"}
    cut = C.cut_repeats(spark, docs, d)
    assert [(i, x) for i, x in rows(cut)] == sorted(((i, rest.decode()) for i, _, _, _, _, rest in brute_suffix(rows_, 50) if rest), key=str) and cut.columns == docs.columns
    assert sum(p.length for p in C.pack(spark, docs, d).filter("doc_id = 1").collect()) == C.pack(spark, docs, d).filter("doc_id = 1").first().doc_tokens


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_empty(spark, tmp_path, name, stage):
    d = f"file://{tmp_path}/{name}"
    make(spark, d)
    docs = queries.table(spark, d, "documents").limit(0)
    assert stage(spark, docs, d).collect() == []
