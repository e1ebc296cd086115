"""Term counts of texts for cross-validation: every text is cut into terms twice, however many folds there are.

Terms are words, pairs of words and character grams; a term's text begins with w or c for its kind.
The first pass sums, for each term, occurrences and documents by fold, so that one table has the
statistics of all training sets; the second stores each document's counts of the terms that any fold keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a slice of documents, and terms that a task sums before it sends them on.
SLICE, HELD = 100_000, 300_000


def tokens(rows: DataFrame) -> DataFrame:
    """Rows with ``__w``, the words of two characters or more, and ``__t``, the texts between white space."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return rows.withColumns({"__w": F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1), "__t": F.filter(F.split(low, r"\s+"), lambda w: w != "")})


def char_grams(token: str, low: int = 3, high: int = 5) -> list[str]:
    w = f" {token} "
    return [w[i : i + n] for n in range(low, high + 1) for i in range(max(1, len(w) - n + 1))]


class Counter:
    """Counts of terms in documents; ``number`` gives a term's number, or -1 if it doesn't count."""

    def __init__(self, number: Callable[[str], int]) -> None:
        self.number, self.known = number, {}

    def grams(self, token: str):  # noqa: ANN201
        import numpy as np

        got = self.known.get(token)
        if got is None:
            if len(self.known) >= HELD:
                self.known.clear()
            found = np.array([self.number("c" + g) for g in char_grams(token)], np.int64)
            got = self.known[token] = found[found >= 0]
        return got

    def count(self, words, texts):  # noqa: ANN001, ANN201
        """(document, term, count) of a slice, in order, of its arrays of words and of texts."""
        import numpy as np

        parts = []
        doc, at, names = _flat(texts)
        if len(at):
            pair, n = np.unique(doc * len(names) + at, return_counts=True)
            d, t = np.divmod(pair, len(names))
            grams = [self.grams(x) for x in names]
            size = np.array([len(g) for g in grams], np.int64)
            reps = size[t]
            first = (np.cumsum(size) - size)[t] - (np.cumsum(reps) - reps)
            parts.append((np.repeat(d, reps), np.concatenate(grams)[np.repeat(first, reps) + np.arange(reps.sum())], np.repeat(n, reps)))
        doc, at, names = _flat(words)
        if len(at):
            one = np.array([self.number("w" + x) for x in names], np.int64)[at]
            parts.append((doc, one, np.ones(len(at), np.int64)))
            inside = doc[1:] == doc[:-1]
            pair, back = np.unique((at[:-1] * len(names) + at[1:])[inside], return_inverse=True)
            two = np.array([self.number(f"w{names[p // len(names)]} {names[p % len(names)]}") for p in pair.tolist()], np.int64)
            if len(pair):
                parts.append((doc[1:][inside], two[back], np.ones(len(back), np.int64)))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        doc, term, n = (np.concatenate(x) for x in zip(*parts))
        kept = term >= 0
        return _summed(doc[kept] << 32 | term[kept], n[kept])


def _flat(column):  # noqa: ANN001, ANN202
    """(document of each element, its number, texts by number) of an array column."""
    import numpy as np

    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    return np.repeat(np.arange(len(column)), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _summed(key, n):  # noqa: ANN001, ANN202
    import numpy as np

    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[start] >> 32, key[start] & 0xFFFFFFFF, np.add.reduceat(n, start) if len(key) else n


def _slices(batch):  # noqa: ANN001, ANN202
    """Parts of a batch with about SLICE tokens, or a single document."""
    import numpy as np

    ends = np.cumsum(batch.column("__t").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def statistics(rows: DataFrame, folds: int) -> DataFrame:
    """(term, n0.., d0..): a term's occurrences and its documents in each fold, of rows with tokens and ``fold``."""
    names = [f"{x}{k}" for x in "nd" for k in range(folds)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def sent():
            terms, values = list(ids), sums[: len(ids)]
            for lo in range(0, len(terms), 20_000):
                part = values[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(terms[lo : lo + 20_000], pa.string()), *(pa.array(part[:, k]) for k in range(2 * folds))], ["term", *names])

        ids: dict[str, int] = {}
        counter, sums = Counter(lambda t: ids.setdefault(t, len(ids))), np.zeros((1024, 2 * folds), np.int64)
        for batch in batches:
            for part in _slices(batch):
                doc, term, n = counter.count(part.column("__w"), part.column("__t"))
                fold = part.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                if len(sums) < len(ids):
                    sums = np.concatenate([sums, np.zeros((len(ids), 2 * folds), np.int64)])
                for by, value in ((fold, n), (folds + fold, np.ones(len(n), np.int64))):
                    column, row, total = _summed(by << 32 | term, value)
                    sums[row, column] += total
                if len(ids) >= HELD:
                    yield from sent()
                    ids.clear()
                    counter.known.clear()
                    sums[:] = 0
        yield from sent()

    sent = rows.select("fold", "__w", "__t").mapInArrow(run, "term string, " + ", ".join(f"{n} long" for n in names))
    return sent.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def vocabulary(stats: DataFrame, folds: int, fold: int, kind: str, min_df: int, size: int) -> list[tuple[str, int]]:
    """(term, documents) of the ``size`` most frequent terms of a kind outside a fold; equal counts by the term's text."""
    other = [k for k in range(folds) if k != fold]
    n, df = (sum((F.col(f"{x}{k}") for k in other), F.lit(0)) for x in "nd")
    t = stats.filter(F.col("term").startswith(kind)).select("term", n.alias("n"), df.alias("df")).filter((F.col("df") >= min_df) & (F.col("n") > 0))
    got = t.orderBy(F.desc("n"), "term").limit(size).select("term", "df").toArrow()  # bounded by ``size``
    return list(zip(got["term"].to_pylist(), got["df"].to_pylist()))


def counts(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows without text and tokens, with ``__ids`` and ``__n``: numbers and counts of the listed terms that occur."""
    kept = [c for c in rows.columns if c not in ("text", "__w", "__t")]
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = {t: i for i, t in enumerate(sent.value)}
        counter = Counter(lambda t: ids.get(t, -1))
        for batch in batches:
            for part in _slices(batch):
                doc, term, n = counter.count(part.column("__w"), part.column("__t"))
                ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *lists], [*kept, "__ids", "__n"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("__ids", T.ArrayType(T.IntegerType())), T.StructField("__n", T.ArrayType(T.IntegerType()))])
    return rows.select(*kept, "__w", "__t").mapInArrow(run, schema)


def vectors(counted: DataFrame, at, weight, words: int, size: int) -> DataFrame:  # noqa: ANN001
    """Rows with ``features``: counts times weights, of unit length for words and for character grams. ``at``: a term's place or -1; the first ``words`` are words."""
    from pyspark.ml.linalg import VectorUDT

    kept = [c for c in counted.columns if c not in ("__ids", "__n")]
    sent = counted.sparkSession.sparkContext.broadcast((at, weight))
    udt = T.StructType([T.StructField("type", T.ByteType(), False), T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType(), False)), T.StructField("values", T.ArrayType(T.DoubleType(), False))])
    assert udt.simpleString() == VectorUDT.sqlType().simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, weight = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids = batch.column("__ids")
                doc = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
                term, n = ids.flatten().to_numpy(), batch.column("__n").flatten().to_numpy()
                place = at[term]
                kept_terms = (place >= 0) & (n > 0)
                doc, place, value = doc[kept_terms], place[kept_terms], n[kept_terms] * weight[term[kept_terms]]
                group = 2 * doc + (place >= words)
                norm = np.sqrt(np.bincount(group, value * value, 2 * batch.num_rows))
                value = value / np.where(norm > 0, norm, 1.0)[group]
                order = np.lexsort((place, doc))
                ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
                cells = [pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(np.full(batch.num_rows, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[order]))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.StructArray.from_arrays(cells, ["type", "size", "indices", "values"])], [*kept, "features"])

    return counted.mapInArrow(run, T.StructType([*(counted.schema[c] for c in kept), T.StructField("features", VectorUDT())]))
