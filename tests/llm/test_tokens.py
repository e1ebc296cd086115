import random

import numpy as np
import pytest

from tarsus.llm import queries, token_files, tokens

PIECES = ["a", "Be", "word. ", "A, ", "B;", "9. ", "x!\n", "it's", "don'T", "İ", "é", "é", "ﬁ", "Σ", "ΟΔΟΣ", "1", "42", ".", ",", "!?", "...", "%", "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "▁", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x0b", "́", "漢字", "🙂", "x.y", "\r\n", "क़", "​"]


def texts(n=3000, seed=3):
    r = random.Random(seed)
    return ["", " ", "\n", "  a", *("".join(r.choice(PIECES) for _ in range(r.randrange(1, 14))) for _ in range(n))]


def test_word_encoder():
    t = tokens.WordEncoder(queries.vocabulary("word_bpe_49k.json"), remember=50)
    all_ = texts()
    for lo in range(0, len(all_), 100):
        part = all_[lo : lo + 100]
        want = [np.array(e.ids, t.dtype).tobytes() for e in t.t.encode_batch(part, add_special_tokens=False)]
        assert t.encode([x.encode() for x in part]) == want


def test_word_encoder_tells_chunks_apart_by_bytes(monkeypatch):
    t = tokens.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(tokens.Hashed, "of", lambda self, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    all_ = texts(300, 5)
    for lo in range(0, len(all_), 60):
        part = all_[lo : lo + 60]
        assert t.encode([x.encode() for x in part]) == [np.array(e.ids, t.dtype).tobytes() for e in t.t.encode_batch(part, add_special_tokens=False)]


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    for normalizer, pre in ((None, pre_tokenizers.Whitespace()), (normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit()), (normalizers.Lowercase(), pre_tokenizers.Metaspace())):
        t = Tokenizer(models.WordLevel({"[UNK]": 0, "alpha9": 1, "beta": 2, "x": 3, ",": 4, "x,": 5, "▁x": 6, "ALPHA9": 7, "Alpha9": 8, "▁alpha9": 9}, unk_token="[UNK]"))
        if normalizer:
            t.normalizer = normalizer
        t.pre_tokenizer = pre
        t.save(str(tmp_path / "t.json"))
        with pytest.raises(ValueError):
            tokens.WordEncoder(str(tmp_path / "t.json"))


def test_head_is_filled_however_many_tie(spark):
    flat = spark.createDataFrame([(f"t{i}", 1, 1) for i in range(5000)], "pre string, spread long, pieces long")
    assert 2900 < flat.filter(tokens.most_spread(flat, 3000)).count() <= 3000
    steep = spark.createDataFrame([(f"t{i}", 10**9 // (i + 1), 1) for i in range(3000)], "pre string, spread long, pieces long")
    met = steep.filter(tokens.most_spread(steep, 1000)).collect()
    assert 990 <= len(met) <= 1000 and {f"t{i}" for i in range(900)} <= {r.pre for r in met}
    assert steep.filter(tokens.most_spread(steep, 0)).count() == 0 and steep.filter(tokens.most_spread(steep, 9999)).count() == 3000
    assert steep.limit(0).filter(tokens.most_spread(steep.limit(0), 5)).count() == 0


def test_spread_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a"), (3, None), (4, "b a\nc")], "doc_id long, text string")
    got = {r.pre: r.spread for r in tokens.pre_token_table(docs, queries.vocabulary("piece_bpe_32k.model")).collect()}
    assert got == {"a": 3, "b": 2, "\nc": 1}


def test_pre_tokens_add_up():
    c = tokens.PieceCounter(queries.vocabulary("piece_bpe_32k.model"))
    for t in texts():
        assert c.count(tokens.pre_tokens(t)).sum() == len(c.sp.encode(t)), repr(t)


@pytest.mark.parametrize("head", [300_000, 3, 0])
def test_count_tokens(spark, head):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (None, "x  y\nz"), (4, "long words " * 5000)]
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, pre string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, path, head=head).collect())
    n = [len(sp.encode(t or "")) for _, t in rows]
    assert got == sorted((str(d), len((t or "").encode()), k, k > 4096) for (d, t), k in zip(rows, n))
    assert tokens.count_tokens(df.limit(0), path, head=head).collect() == []


@pytest.mark.parametrize("step", [500, 7])
def test_bounds_part_skewed_ids_evenly(spark, step):
    r = np.random.default_rng(2)
    ids = np.concatenate([np.full(4000, -5), r.integers(0, 50, 2000), (2.0 ** r.uniform(0, 60, 6000)).astype(np.int64)])
    df = spark.createDataFrame([(int(i),) for i in ids] + [(None,)] * 3000, "doc_id long").repartition(5)
    cuts = token_files.bounds(df, 40, step)
    assert (np.diff(cuts) >= 0).all() and 39 <= len(cuts) <= 45
    n = len(ids) + 3000
    at = np.bincount(np.searchsorted(cuts, ids), minlength=len(cuts) + 1)
    u, times = np.unique(cuts, return_counts=True)
    assert all(c <= n / 40 * 2 * max(1, times[u == i].sum()) for i, c in zip([*cuts, 0], at))
    assert (cuts == token_files.FIRST).sum() >= 6 and (cuts == -5).sum() >= 6


def test_planning_many_files_makes_no_large_expression(spark):
    cuts = token_files.bounds(spark.range(20_000).selectExpr("id as doc_id"), 20_000)
    assert len(cuts) >= 19_999 and len(np.unique(cuts)) > 15_000


def test_an_id_of_many_rows_has_many_files(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(None, "")] * 300 + [(None, f"text {i}") for i in range(300)] + [(4, f"word {i % 40}") for i in range(400)] + [(i, "x") for i in range(5, 105)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_files.write(df, path, str(tmp_path / "f"), n_files=11)
    per = [r[1] for r in spark.read.schema(token_files.SCHEMA).parquet(str(tmp_path / "f")).groupBy("bucket").count().collect()]
    assert len(per) >= 9 and max(per) <= 250
    got = sorted(token_files.with_crc(token_files.read(spark, str(tmp_path / "f"))).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    want = sorted((str(d), zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, x in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("n_files", [1, 3])
def test_token_files_round_trip(spark, tmp_path, n_files):
    import zlib

    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(7, "Hello, world"), (3, None), (3, "a"), (None, "null id"), (5, ""), (9, "Many Words. " * 4000), (7, "Hello, world")]
    df = spark.createDataFrame([(d, x, 0) for d, x in rows], "doc_id long, text string, start int")
    token_files.write(df, path, str(tmp_path / "f"), n_files=n_files)
    got = token_files.with_crc(token_files.read(spark, str(tmp_path / "f"))).collect()
    got = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None, 3, 3, 5, 7, 7, 9]
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    want = {(d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, x in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want
    token_files.write(df.limit(0), path, str(tmp_path / "e"))
    assert token_files.read(spark, str(tmp_path / "e")).collect() == []
