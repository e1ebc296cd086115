"""Benchmark decontamination (operator 6): BM25 over an inverted index of test items with block-max WAND, then overlap checks."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Items in a block of the index, and words in half a passage at least.
BLOCK_ITEMS, HALF = 8, 48
#: Items, and words of items, in one index at most, about; bytes of text that are searched in one index after another.
INDEXED, INDEXED_WORDS, SEARCHED = 20_000, 2_000_000, 8_000_000
#: Share of an item's own score that a passage must reach; share of shingles of question and of answer; shingle width.
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.4, 3
#: The last part of an item's words that counts as its answer, where items have no answer column.
ANSWER = 1 / 3

_SPACE = bytes(32 if (i < 128 and not chr(i).isalnum()) else i for i in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


def shingles(w: list[bytes], n: int) -> set[tuple]:
    return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


@dataclass
class Index:
    """Postings of weights: BM25 contributions as shares of the item's own score, so that one threshold serves all items.

    Items are numbered by their length, so that the items of a block are alike and its largest weights tight.
    """

    ids: list
    terms: dict[bytes, int]
    top: np.ndarray  #: largest weight of each term
    block_at: np.ndarray  #: where each term's blocks begin
    block: np.ndarray
    block_top: np.ndarray  #: largest weight in the block
    post_at: np.ndarray  #: where each (term, block)'s postings begin
    item: np.ndarray
    weight: np.ndarray
    parts: list[tuple[bytes, bytes]]  #: words of question and answer
    half: int


def share(part: set[tuple], passage: list[bytes], have: set[tuple], n: int) -> float:
    """Share of a part's shingles in a passage with the shingles ``have``; a part of under ``n`` words is looked for as it is."""
    if not part:
        return 1.0
    k = len(next(iter(part)))
    return len(part & (have if k >= n else shingles(passage, k))) / len(part)


@dataclass
class Whole:
    """Statistics of all items with words: their number, mean and largest length, and document frequencies of an index's terms at least."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]


def parted(question: str | None, answer: str | None, shingle: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(all words, words of the question, words of the answer) of an item; without an answer its last ANSWER words are one, with the shingles that reach into it."""
    q = words(question or "")
    if answer is not None:
        a = words(answer)
        return q + a, q, a
    cut = max(1, len(q) - int(len(q) * ANSWER))
    return q, q[:cut], q[max(0, cut - shingle + 1) :] if cut < len(q) else []


def build(items: list[tuple], shingle: int = SHINGLE, whole: Whole | None = None) -> Index:
    """Index items (id, question, answer or None); items without words are left out. Without ``whole`` these are all items."""
    got = [(i, *parted(q, a, shingle)) for i, q, a in items]
    got = sorted((g for g in got if g[1]), key=lambda g: len(g[1]))
    ids, bags, parts = [g[0] for g in got], [g[1] for g in got], [(b" ".join(g[2]), b" ".join(g[3])) for g in got]
    if whole is None:
        whole = Whole(len(bags), sum(map(len, bags)) / max(1, len(bags)), max(map(len, bags), default=0), Counter(t for w in bags for t in set(w)))
    terms = {t: k for k, t in enumerate(sorted(set().union(*bags)))}  # in order, so that sums are the same in every index
    df = np.array([whole.df[t] for t in terms], float)
    idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
    rows = []
    for j, w in enumerate(bags):
        t, tf = np.unique([terms[x] for x in w], return_counts=True)
        s = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / whole.mean))
        rows.append((t, np.full(len(t), j), s / s.sum()))
    t, item, weight = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    o = np.lexsort((item, t))
    t, item, weight = t[o].astype(np.int64), item[o].astype(np.int64), weight[o].astype(float)
    blk = item // BLOCK_ITEMS
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (blk[1:] != blk[:-1])]) if len(t) else np.zeros(0, np.int64)
    bt = t[new]
    top = np.zeros(len(terms))
    np.maximum.at(top, t, weight)
    return Index(ids, terms, top, np.searchsorted(bt, np.arange(len(terms) + 1)), blk[new], np.maximum.reduceat(weight, new) if len(new) else weight, np.r_[new, len(t)], item, weight, parts, max(HALF, whole.longest))


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges, and which range each is of."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(np.arange(len(n)), n)


#: What the searches of this process did: pivots of passages, and blocks that were scored.
walked = {"pivots": 0, "scored": 0, "blocks": 0}


def wand(x: Index, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(postings' block, passage, as places in ``x.block``) of all blocks of items that may reach ``least``.

    Block-max WAND for many passages in step. Each passage has a cursor in the blocks of each
    of its terms. In every round it orders its terms by the block under their cursor and adds up
    their largest weights: where the sum reaches ``least`` is the pivot, and no block before the
    pivot's can. Cursors before it skip to it; if the largest weights in that block itself reach
    ``least`` it is to be scored; then the cursors in it move on. A passage without a pivot is done.
    """
    n_blocks = np.int64(x.block.max()) + 1 if len(x.block) else np.int64(1)
    place = np.repeat(np.arange(len(x.terms)), np.diff(x.block_at)) * n_blocks + x.block
    at, end = x.block_at[term], x.block_at[term + 1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        now = x.block[at]
        order = np.argsort(passage * n_blocks + now, kind="stable")
        passage, term, at, end, now = (v[order] for v in (passage, term, at, end, now))
        new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(passage)]))
        sums = np.cumsum(x.top[term])
        sums -= np.r_[0.0, sums][new][group]
        reach = np.flatnonzero(sums >= least - 1e-12)
        g = group[reach]
        pivot = reach[np.r_[True, g[1:] != g[:-1]]] if len(reach) else reach
        target = np.full(len(new), -1, np.int64)
        target[group[pivot]] = now[pivot]
        walked["pivots"] += len(pivot)
        target = target[group]
        live = target >= 0
        passage, term, at, end, now, target = (v[live] for v in (passage, term, at, end, now, target))
        behind = np.flatnonzero(now < target)
        at[behind] = np.searchsorted(place, term[behind] * n_blocks + target[behind])
        here = np.flatnonzero(at < end)
        here = here[x.block[at[here]] == target[here]]
        enough = np.bincount(passage[here], x.block_top[at[here]], int(passage[-1]) + 1 if len(passage) else 0) >= least
        score = here[enough[passage[here]]]
        walked["scored"] += int(enough.sum())
        found.append((at[score], passage[score]))
        at[here] += 1
        left = at < end
        passage, term, at, end = (v[left] for v in (passage, term, at, end))
    b, p = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return b, p


def retrieve(x: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all pairs that reach the threshold, for distinct (passage, term) pairs in ascending order."""
    least = threshold - 1e-9
    n = int(passage[-1]) + 1 if len(passage) else 0
    sel = (np.bincount(passage, x.top[term], n) >= least - 1e-12)[passage]
    walked["blocks"] += int((x.block_at[term[sel] + 1] - x.block_at[term[sel]]).sum())
    b, p = wand(x, passage[sel], term[sel], least)
    i, of = _expand(x.post_at[b], x.post_at[b + 1])
    size = np.int64(max(1, len(x.ids)))
    key = p[of] * size + x.item[i]
    order = np.lexsort((i, key))  # postings are in the order of terms: sums are the same however items are indexed
    u, at = np.unique(key[order], return_inverse=True)
    s = np.bincount(at, x.weight[i[order]], len(u))
    hit = s >= least
    return u[hit] // size, u[hit] % size, s[hit]


def search(x: Index, texts: list[list[bytes]], threshold: float, overlap: float, shingle: int) -> list[tuple]:
    """(text, item, score, question overlap, answer overlap, first word, words) of contaminated texts, each pair once with its best passage."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = [w for t in texts for w in t]
    t = np.fromiter(map(x.terms.get, flat, repeat(-1)), np.int64, len(flat))
    start = np.cumsum(lens) - lens
    n_pass = np.maximum(1, -(-lens // x.half))  # passage k holds halves k and k + 1
    p0 = np.cumsum(n_pass) - n_pass
    at = np.flatnonzero(t >= 0)
    doc = np.searchsorted(np.cumsum(lens), at, side="right")
    k = (at - start[doc]) // x.half
    one, two = p0[doc] + k, np.where(k > 0, p0[doc] + k - 1, -1)
    size = np.int64(max(1, len(x.terms)))
    key = np.unique(np.concatenate([one * size + t[at], (two * size + t[at])[two >= 0]]))
    p, item, s = retrieve(x, key // size, key % size, threshold)
    best: dict[tuple, tuple] = {}
    parts: dict[int, tuple] = {}
    for a, j, v in zip(p.tolist(), item.tolist(), np.round(s, 6).tolist()):
        d = int(np.searchsorted(p0, a, side="right")) - 1
        lo = (a - p0[d]) * x.half
        w = texts[d][lo : lo + 2 * x.half]
        have = shingles(w, shingle)
        if j not in parts:
            parts[j] = tuple(shingles(v.split(), shingle) for v in x.parts[j])
        q, an = parts[j]
        qo, ao = share(q, w, have, shingle), share(an, w, have, shingle)
        if qo >= overlap and ao >= overlap and (v, -lo) > best.get((d, j), (-1.0, 0))[:2]:
            best[d, j] = (v, -lo, qo, ao, len(w))
    return [(d, j, v, qo, ao, int(-lo), n) for (d, j), (v, lo, qo, ao, n) in sorted(best.items())]


ITEMS = "item_id long, q string, a string, block int"


def indexes(items: DataFrame, shingle: int, indexed: int) -> tuple[str, int]:
    """Index items (item_id, q, a) into the shared folder, about ``indexed`` in each index and INDEXED_WORDS words; returns the folder and their number.

    Numbers of all items, document frequencies among them, are counted once and serve every
    index. Each index is built by one task from its items; none reaches the driver.
    """

    def counted(batches):
        for b in batches:
            q, a = (b.column(k).to_pylist() for k in (1, 2))
            yield common.batch(item_id=b.column(0), q=b.column(1), a=b.column(2), n=pa.array([len(words(x or "")) + len(words(y or "")) for x, y in zip(q, a)], pa.int64()))

    items, _ = common.stage(items.mapInArrow(counted, "item_id long, q string, a string, n long"), "test-items")
    n, total, longest = items.filter("n > 0").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    mean = (total or 0) / max(1, n)
    k = 1 if n <= indexed and (total or 0) <= INDEXED_WORDS else max(-(-2 * n // indexed), -(-2 * total // INDEXED_WORDS))  # half full on average, as a hash fills them
    items = items.filter("n > 0").select("item_id", "q", "a", F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(k)).cast("int").alias("block"))

    def bags(batches):
        for b in batches:
            q, a, block = (b.column(i).to_pylist() for i in (1, 2, 3))
            terms = [set(words(x or "") + words(y or "")) for x, y in zip(q, a)]
            yield common.batch(block=pa.array([i for i, t in zip(block, terms) for _ in t], pa.int32()), term=pa.array([x for t in terms for x in t], pa.binary()))

    by_block = items.mapInArrow(bags, "block int, term binary").groupBy("block", "term").agg(F.count("*").alias("n"))
    df = by_block.select("block", "term", F.sum("n").over(Window.partitionBy("term")).alias("df"))

    def make(rows: pa.Table, df: pa.Table) -> pa.Table:
        whole = Whole(n, mean, longest, dict(zip(df["term"].to_pylist(), df["df"].to_pylist())))
        got = sorted(zip(*(rows[c].to_pylist() for c in ("item_id", "q", "a"))), key=repr)
        return pa.table({"block": pa.array(rows["block"][:1], pa.int32()), "payload": pa.array([pickle.dumps(build(got, shingle, whole), 5)], pa.binary())})

    made = items.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(make, "block int, payload binary")
    return common.stage(made, "item-index", partition_by="block")[1], k


_held: dict[tuple[str, int], Index] = {}


def load(path: str, k: int) -> Index | None:
    """The k-th index; a worker process holds one at a time. None if it has no items."""
    if (path, k) not in _held:
        _held.clear()
        fs, bare = common.filesystem(f"{path}/block={k}")
        if fs.get_file_info(bare).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(bare)):
                if f.path.endswith(".parquet"):
                    for x in pq.ParquetFile(fs.open_input_file(f.path)).read(columns=["payload"])["payload"].to_pylist():
                        _held[path, k] = pickle.loads(x)  # written by indexes()
    return _held.get((path, k))


def named(items: DataFrame, item_col: str, question_col: str, answer_col: str | None) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(question_col).cast("string").alias("q"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shingle: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, indexed: int = INDEXED) -> DataFrame:
    """The documents in which ``contaminated`` would find no item, with all their columns, in one pass and without a shuffle."""
    path, n_indexes = indexes(named(items, item_col, question_col, answer_col), shingle, indexed)

    def verdict():
        def judge(raw: list[bytes]) -> np.ndarray:
            out, texts = np.ones(len(raw), bool), [words(t.decode("utf-8", "replace")) for t in raw]
            for k in range(n_indexes):
                x = load(path, k)
                out[[h[0] for h in search(x, texts, threshold, overlap, shingle)] if x else []] = False
            return out

        return judge

    return common.keep_rows(docs, verdict, text_col)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, indexed: int = INDEXED) -> DataFrame:
    """Documents that hold test items: doc_id, item_id, score (6 places), question_overlap, answer_overlap, first_word, n_words, text_hash.

    Every passage of every whole text (halves of at least HALF words and as long as the longest
    item, two at a time) is a query against the items; every item whose BM25 score reaches
    ``threshold`` of the item's own is retrieved, and counts if ``overlap`` of the shingles of
    its question and of its answer are in the passage (a part of fewer words than a shingle
    must be there whole, as one). A row for each input row and item;
    a row without contamination gives none. Null and empty texts match nothing; an item
    without words is left out; of items, question and answer, an item without an answer column
    is parted by ANSWER. Null ids are kept. Empty tables give no rows.

    An index holds about ``indexed`` items at most, and a bounded number of words. More items
    have more indexes, all in the shared folder; a task reads its documents once, a few MB at
    a time, and searches them in one index after another. Weights and passages are of all items,
    so the rows are the same. Items that are repeated are each reported; columns of other names aren't read.
    """
    rows = common.two_columns(docs, id_col, text_col)
    path, n_indexes = indexes(named(items, item_col, question_col, answer_col), shingle, indexed)

    def run(batches) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, raw in common.text_batches(batches, SEARCHED if n_indexes > 1 else 2_000_000):
            texts = [words(t.decode("utf-8", "replace")) for t in raw]
            for k in range(n_indexes):
                x = load(path, k)
                hits = search(x, texts, threshold, overlap, shingle) if x else []
                if hits:
                    d, j, v, q, a, lo, n = zip(*hits)
                    yield common.batch(doc_id=ids.take(pa.array(d)), item_id=pa.array([x.ids[i] for i in j], pa.int64()), score=pa.array(v), question_overlap=pa.array(q, pa.float64()), answer_overlap=pa.array(a, pa.float64()), first_word=pa.array(lo, pa.int64()), n_words=pa.array(n, pa.int64()), text_hash=pa.array(np.array([xxhash.xxh64_intdigest(raw[i], 42) for i in d], np.uint64).view(np.int64)))

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, n_words long, text_hash long")
