"""Language-model scoring by deleted interpolation (operator 8)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .stats import WHITE, Hashed, mix

#: Bytes of text in a block, context-frequency buckets of the two longer orders, EM rounds, and bins a decade of probability.
BLOCK, CONTEXTS, ROUNDS, DECADE = 4_000_000, 16, 60, 4
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokenise(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the tokens of texts (ASCII-lower-cased words, then one end each), and how many each text has."""
    n = len(raw)
    a = np.frombuffer(b"".join(raw).lower(), np.uint8)
    lens = np.fromiter(map(len, raw), np.int64, n)
    ends = np.cumsum(lens)
    white = np.zeros(256, bool)
    white[WHITE] = True
    dark = ~white[a]
    edge = np.zeros(len(a) + 1, bool)
    edge[ends] = edge[ends - lens] = True
    begin = np.flatnonzero(dark & (np.r_[True, ~dark[:-1]] | edge[:-1])) if len(a) else np.zeros(0, np.int64)
    stop = np.flatnonzero(dark & (np.r_[~dark[1:], True] | edge[1:])) + 1 if len(a) else begin
    doc = np.searchsorted(ends, begin, side="right")
    words = np.bincount(doc, minlength=n)
    counts = words + 1
    last = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), np.uint64)
    out[last] = END
    out[np.arange(len(begin)) + doc] = Hashed(a).of(begin, stop)
    return out, counts


def blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Staged blocks: ids, whether they have one, token counts, distinct token keys and the tokens as places among those."""
    rows = common.two_columns(docs, id_col, text_col).withColumn("fold", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)).cast("int"))

    def run(batches):
        from pyspark import TaskContext

        grp, n, size = TaskContext.get().partitionId(), 0, 0
        held: list = [[], [], []]

        def flush():
            folds = np.concatenate(held[1])
            lens = np.concatenate([c for _, c in held[2]])
            voc, at = np.unique(np.concatenate([t for t, _ in held[2]]), return_inverse=True)
            ids = pa.chunked_array(held[0]).combine_chunks()
            train = np.repeat(folds != 1, lens)
            return common.batch(
                grp=pa.array([grp], pa.int32()), block=pa.array([(grp << 24) + n], pa.int64()), n_train=pa.array([int(train.sum())], pa.int64()), train_docs=pa.array([int((folds != 1).sum())], pa.int64()),
                ids=pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()), null_ids=pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), folds=pa.array([folds.astype(np.uint8).tobytes()], pa.binary()), lens=pa.array([lens.astype(np.int64).tobytes()], pa.binary()),
                voc=pa.array([common.pack_sorted(voc)], pa.binary()), tokens=pa.array([common.planes(common.smallest(at))], pa.binary()),
            )

        for b in batches:
            at = 0
            for ids, raw in common.text_batches([pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"])]):
                held[0].append(ids)
                held[1].append(b.column(2).slice(at, len(ids)).to_numpy())
                held[2].append(tokenise(raw))
                at += len(ids)
                size += sum(map(len, raw))
                if size >= BLOCK:
                    yield flush()
                    n, size, held = n + 1, 0, [[], [], []]
        if held[0]:
            yield flush()

    return common.stage(rows.mapInArrow(run, "grp int, block long, n_train long, train_docs long, ids binary, null_ids binary, folds binary, lens binary, voc binary, tokens binary"), "token-blocks")


class Grams:
    """A block's distinct n-grams of each order up to ``order``, with each token's place among them."""

    def __init__(self, row: dict, order: int):
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.lens = np.frombuffer(row["lens"], np.int64)
        voc = common.unpack_sorted(row["voc"])[0]
        w = common.unplanes(row["tokens"])[0].astype(np.uint64)
        size = np.uint64(len(voc) + 1)
        keys = np.r_[voc, START]
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.doc, self.train = doc, (self.folds != 1)[doc]
        first = np.cumsum(self.lens) - self.lens
        back = np.arange(len(w)) - first[doc]
        #: For each order: places of the tokens' n-grams, the n-grams' keys in ascending order.
        self.at, self.keys, self.one = [w.astype(np.int64)], [voc], [None]
        self.fresh = back == 0
        local, prior = w, None
        for k in range(1, order):
            # the history of k tokens, with START before the first
            prior = np.r_[np.uint64(0), local[:-1]]
            prior_key = np.r_[START, self.keys[-1][self.at[-1]][:-1]] if len(w) else keys[:0]
            prior[self.fresh] = np.uint64(len(self.keys[-1]))
            prior_key[self.fresh] = START + np.uint64(k)
            gram = prior * size + w
            u, place = np.unique(gram, return_inverse=True)
            one = np.empty(len(u), np.int64)
            one[place] = np.arange(len(w))
            key = mix(mix(prior_key[one] + np.uint64(k)) + voc[w[one].astype(np.int64)])
            o = np.argsort(key)
            rank = np.empty(len(o), np.int64)
            rank[o] = np.arange(len(o))
            self.at.append(rank[place])
            self.keys.append(key[o])
            self.one.append(one[o])
            local = self.at[-1].astype(np.uint64)

    def own(self, k: int) -> np.ndarray:
        """Training counts in this block of the n-grams of order k + 1."""
        return np.bincount(self.at[k][self.train], minlength=len(self.keys[k]))

    def in_document(self, k: int) -> np.ndarray:
        """How often each token's n-gram of order k + 1 occurs in its own document."""
        key = self.doc * np.int64(len(self.keys[k]) + 1) + self.at[k]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[at]


    def elsewhere(self, k: int, more: np.ndarray) -> np.ndarray:
        """Which n-grams of order k + 1 may occur in another block, learned from or not: those whose two parts of order k do."""
        t = self.one[k]
        return more[self.at[k - 1][t]] & (self.fresh[t] | more[self.at[k - 1][t - 1]])


def request(keys: list[np.ndarray], own: list[np.ndarray], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    cuts = [common.split_sorted(k, n_buckets) for k in keys]
    for b in range(n_buckets):
        if any(c[b + 1] > c[b] for c in cuts):
            yield b, b"".join(common.pack_sorted(k[c[b] : c[b + 1]]) + common.planes(common.smallest(n[c[b] : c[b + 1]])) for k, n, c in zip(keys, own, cuts))


def answer(payloads: list[bytes], orders: int) -> Iterator[bytes]:
    """The sum over all requests of each key's counts, and whether several blocks asked; last, how many keys of the first order have a count."""
    ats, out, known = [0] * len(payloads), [[] for _ in payloads], 0
    for k in range(orders):
        keys, counts = [], []
        for i, p in enumerate(payloads):
            x, at = common.unpack_sorted(p, ats[i])
            y, ats[i] = common.unplanes(p, at)
            keys.append(x)
            counts.append(y.astype(np.float64))
        sizes = np.cumsum([0, *map(len, keys)])
        u, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(u)).astype(np.int64)
        known = known if k else int((total > 0).sum())
        total, several = total[place], (np.bincount(place, minlength=len(u)) > 1)[place]
        for i in range(len(payloads)):
            mine = slice(sizes[i], sizes[i + 1])
            out[i].append(common.planes(common.smallest(total[mine])) + common.planes(np.packbits(several[mine])))
    for o in out:
        yield b"".join(o)
    yield struct.pack("<q", known)


class Counts:
    """Corpus counts of a block's n-grams, from the answers of the exchanges (orders 1 and 2, then one order each)."""

    def __init__(self, paths: list[str]):
        self.found = [common.Answers(p) for p in paths]

    def of(self, row: dict, g: Grams) -> tuple[list[np.ndarray], np.ndarray]:
        """Counts of each order, and which n-grams of the last one other blocks have."""
        out: list[np.ndarray] = []
        more = np.zeros(0, bool)
        for i, f in enumerate(self.found):
            parts: list[list] = [[] for _ in range(1 if i else 2)]
            bits: list[list] = [[] for _ in parts]
            for _, b in sorted(f.of(row["grp"], row["block"]).items()):
                at = 0
                for p, q in zip(parts, bits):
                    x, at = common.unplanes(b, at)
                    y, at = common.unplanes(b, at)
                    p.append(x.astype(np.int64))
                    q.append(np.unpackbits(y, count=len(x)).astype(bool))
            got = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            asked = np.concatenate(bits[-1]) if bits[-1] else np.zeros(0, bool)
            if i:
                k = len(out)
                c, may = g.own(k), g.elsewhere(k, more)
                c[may] = got[0]
                got = [c]
                may[may] = asked
                more = may
            else:
                more = asked
            out += got
        return out, more


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then by powers of two."""
    return np.minimum(np.ceil(np.log2(np.maximum(c, 0) + 1)).astype(np.int64), CONTEXTS - 1)


def estimates(g: Grams, c: list[np.ndarray], n: int, n_docs: int, delete: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates of each order for every token, and the context-frequency buckets of orders 2 and up.

    ``delete``: without the token's own document.
    """
    order = len(c)
    own = [g.in_document(k) for k in range(order)] if delete else [0] * order
    count = [c[k][g.at[k]] - own[k] for k in range(order)]
    whole = n - (g.lens[g.doc] if delete else 0)
    docs = n_docs - (1 if delete else 0)
    fresh = np.zeros(len(g.doc), bool)
    fresh[np.cumsum(g.lens) - g.lens] = True
    p, buckets = [count[0] / np.maximum(whole, 1)], []
    for k in range(1, order):
        # a history occurs once for each time it is continued; its count is its own n-gram's
        ctx = np.where(fresh, docs, np.r_[0, count[k - 1][:-1]]) if len(fresh) else count[k]
        p.append(count[k] / np.maximum(ctx, 1))
        buckets.append(context_bucket(ctx))
    return p, buckets


def interpolate(p: list[np.ndarray], buckets: list[np.ndarray], lam: list[np.ndarray], p0: float) -> np.ndarray:
    out = lam[0][0] * p[0] + (1 - lam[0][0]) * p0
    for k in range(1, len(p)):
        a = lam[k][buckets[k - 1]]
        out = a * p[k] + (1 - a) * out
    return out


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for zero, else a bin of log10 p."""
    return np.where(p > 0, np.clip(1 + np.round(-np.log10(np.maximum(p, 1e-15)) * DECADE), 1, 63), 0).astype(np.int64)


def learn(cells: np.ndarray, n: np.ndarray, order: int, p0: float, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Mixture weights by expectation-maximisation over counted cells of (buckets, binned estimates); all 0 of no cells."""
    if not len(cells):
        return [np.zeros(1)] + [np.zeros(CONTEXTS) for _ in range(order - 1)]
    value = np.r_[0.0, 10.0 ** (-np.arange(63) / DECADE)]
    x, p, b = cells.copy(), [], []
    for _ in range(order):
        p.append(value[x & 63])
        x >>= 6
    for _ in range(order - 1):
        b.append(x & 15)
        x >>= 4
    lam = [np.array([0.5])] + [np.r_[0.0, np.full(CONTEXTS - 1, 0.5)] for _ in range(order - 1)]
    for _ in range(rounds):
        levels = [lam[0][0] * p[0] + (1 - lam[0][0]) * p0]
        for k in range(1, order):
            a = lam[k][b[k - 1]]
            levels.append(a * p[k] + (1 - a) * levels[-1])
        weight = n.astype(float)
        for k in range(order - 1, -1, -1):
            at = b[k - 1] if k else np.zeros(len(n), np.int64)
            share = weight * lam[k][at] * p[k] / levels[k]
            top, all_ = np.bincount(at, share, len(lam[k])), np.bincount(at, weight, len(lam[k]))
            lam[k] = np.clip(np.where(all_ > 0, top / np.maximum(all_, 1e-300), lam[k]), 0, 1 - 1e-6)
            weight = weight - share
    return lam


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every whole text.

    Rows whose crc32 of the id as text, mod 5, is 1 are held out: nothing is learned from them.
    The model mixes maximum-likelihood estimates of orders 1 to ``order`` and a uniform one
    over the training vocabulary and one unknown token; weights depend on how often the
    context was seen and are learned by expectation-maximisation on counts from which each
    token's document is deleted. One row for each input row; a null text is empty (one end
    token); a null id is a training row. With no training rows N = V = 0, and every score and base score is 0.

    The counts cover every n-gram of every training text. Each block of text asks the bucket of
    each distinct n-gram for its count in the whole corpus, so a frequent one is sent once a block.
    Only the counted cells reach the driver, at most 63 to the power of ``order`` times 16 to that of
    ``order`` - 1, however much text there is, and in practice those few that occur. Beyond order 2 it asks only for n-grams both of whose parts occur in other blocks; the
    others can't, and their count is the block's own.
    """
    if not 2 <= order <= 4:
        raise ValueError("order must be 2, 3 or 4")
    spark = docs.sparkSession
    staged, _ = blocks(docs, id_col, text_col)
    n, n_docs, n_bytes = (int(x or 0) for x in staged.agg(F.sum("n_train"), F.sum("train_docs"), F.sum(F.octet_length("tokens") * 3)).first())
    n_buckets = 2 * common.buckets_for(n_bytes, 6)

    def first(row) -> Iterator[tuple[int, bytes]]:
        g = Grams(row, 2)
        return request(g.keys, [g.own(0), g.own(1)], n_buckets)

    paths = [common.exchange(staged, first, lambda p: answer(p, 2), n_buckets, "ngram-counts")]
    for k in range(2, order):

        def more(row, k=k, known=tuple(paths), state={}) -> Iterator[tuple[int, bytes]]:  # noqa: B006
            counts = state.setdefault("c", Counts(list(known)))
            g = Grams(row, k + 1)
            may = g.elsewhere(k, counts.of(row, g)[1])
            return request([g.keys[k][may]], [g.own(k)[may]], n_buckets)

        paths.append(common.exchange(staged, more, lambda p: answer(p, 1), n_buckets, "ngram-counts"))

    def notes(batches):
        for b in batches:
            yield common.batch(v=pa.array([struct.unpack("<q", y)[0] for x in b.column(0).to_pylist() for _, y in common.unframed(x)], pa.int64()))

    v = int(common.bucket_notes(spark, paths[0]).mapInArrow(notes, "v long").agg(F.sum("v")).first()[0] or 0)
    p0 = 1 / (v + 1)

    def cells(batches):
        counts = Counts(paths)
        for row in common.read_rows(batches):
            g = Grams(row, order)
            p, b = estimates(g, counts.of(row, g)[0], n, n_docs, delete=True)
            key = np.zeros(len(g.doc), np.int64)
            for x in reversed(b):
                key = key << 4 | x
            for x in reversed(p):
                key = key << 6 | quantise(x)
            u, k = np.unique(key[g.train], return_counts=True)
            yield common.batch(cell=pa.array(u, pa.int64()), n=pa.array(k, pa.int64()))

    held = staged.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    lam = learn(held["cell"].to_numpy(), held["n"].to_numpy(), order, p0)

    def finish(batches):
        counts = Counts(paths)
        for row in common.read_rows(batches):
            g = Grams(row, order)
            c = counts.of(row, g)[0]
            p, b = estimates(g, c, n, n_docs, delete=False)
            k = len(g.lens)
            lp = np.bincount(g.doc, np.log10(interpolate(p, b, lam, p0)), k)
            known = c[0][g.at[0]]
            base = np.bincount(g.doc, np.log10((known + 0.5) / (n + 0.5 * (v + 1))), k)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["null_ids"], bool))
            yield common.batch(doc_id=ids, held_out=pa.array(g.folds == 1), n_tokens=pa.array(g.lens), n_known=pa.array(np.bincount(g.doc, known > 0, k).astype(np.int64)), train_tokens=pa.array(np.full(k, n, np.int64)), base_score=pa.array(base), score=pa.array(lp))

    return staged.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
