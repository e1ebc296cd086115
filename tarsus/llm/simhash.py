"""SimHash near-duplicates (operator 9): fingerprints, and a binary-trie self-join within a Hamming budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges up to which components are found in one task; above it, by distributed star contraction.
SMALL_EDGES = 2_000_000
#: Node pairs in hand at once, and the product of sizes up to which a node pair is compared directly.
FRONTIER, LEAF = 200_000, 4
#: What the walks of this process did: node pairs parted into children, and pairs of keys compared at the leaves.
walked = {"parted": 0, "compared": 0}


def fingerprints(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if over half of the shingles' XXH64 have it.

    ASCII letters are lower-cased; words are separated by ASCII white space; shingles are
    ``width`` words joined by a space, repeats included; a text of fewer words is one shingle,
    a text without words has fingerprint zero.
    """
    import xxhash

    h = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        if not w:
            continue
        grams = map(b" ".join, zip(*(w[k:] for k in range(width)))) if len(w) >= width else [b" ".join(w)]
        a = np.array([h(g, seed) for g in grams], np.uint64)
        bits = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.zeros(64, np.int64)
        for s in range(0, len(bits), 255):
            n += np.add.reduce(bits[s : s + 255], axis=0, dtype=np.uint8)
        out[i] = weights[2 * n > len(a)].sum()
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_self_join(keys: np.ndarray, budget: int, exact: int = 0, halves: int | None = None) -> np.ndarray:
    """Index pairs (i < j) of sorted distinct uint64 keys that differ in at most ``budget`` bits, none of them among the top ``exact``.

    The sorted keys are a binary trie whose nodes are ranges. Pairs of nodes of one depth are
    walked down together from the root paired with itself; a pair of children that part adds a
    differing bit, and a pair over the budget is dropped. Small pairs are compared directly.
    With ``halves`` (an index) only pairs across that index are wanted, and the walk starts
    from those two nodes, whose top ``exact`` bits may differ.
    """
    found = []
    n = len(keys)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    if halves is not None:
        if not 0 < halves < n:
            return np.zeros((0, 2), np.int64)
        one = [np.array([x]) for x in (0, halves, halves, n)]
        work = [(exact, *one, popcount(keys[:1] >> np.uint64(64 - exact) ^ keys[halves : halves + 1] >> np.uint64(64 - exact)))]
    elif exact:
        top = keys >> np.uint64(64 - exact)
        s = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        e = np.r_[s[1:], n]
        s, e = s[e - s > 1], e[e - s > 1]
        work = [(exact, s, e, s, e, np.zeros(len(s), np.int64))]
    else:
        work = [(0, np.array([0]), np.array([n]), np.array([0]), np.array([n]), np.zeros(1, np.int64))]
    while work:
        depth, a0, a1, b0, b1, err = work.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            work += [(depth, *(x[half:] for x in (a0, a1, b0, b1, err))), (depth, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == 64)
        if small.any():
            x0, x1, y0, y1 = a0[small], a1[small], b0[small], b1[small]
            size = (x1 - x0) * (y1 - y0)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(y1 - y0, size)
            i, j = np.repeat(x0, size) + k // wide, np.repeat(y0, size) + k % wide
            ok = (i < j) & (popcount(keys[i] ^ keys[j]) <= budget)
            walked["compared"] += len(i)
            found.append(np.stack([i[ok], j[ok]], 1))
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        walked["parted"] += len(a0)
        bit = np.uint64(63 - depth)
        ma, mb = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        same = a0 == b0
        nxt = [
            (a0, ma, b0, mb, err),
            (ma, a1, mb, b1, err),
            (a0, ma, mb, b1, err + 1),
            *([tuple(x[~same] for x in (ma, a1, b0, mb, err + 1))]),
        ]
        c = [np.concatenate(z) for z in zip(*nxt)]
        ok = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= budget) & ~((c[0] == c[2]) & (c[1] - c[0] < 2))
        work.append((depth + 1, *(x[ok] for x in c)))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first index in each range whose key has the bit (the range shares all higher bits)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        m = (lo + hi) // 2
        one = open_ & ((keys[np.minimum(m, len(keys) - 1)] >> bit & np.uint64(1)) == 1)
        hi = np.where(one, m, hi)
        lo = np.where(open_ & ~one, m + 1, lo)
    return lo


def rotate(x: np.ndarray, k: int) -> np.ndarray:
    return x if not k else (x << np.uint64(k)) | (x >> np.uint64(64 - k))


#: Fingerprints planned for one trie, those from which a trie is split over tasks, and the bits of that split at least.
SHARD, HOT_SHARD, HOT_BITS = 30_000, 1_000_000, 8
#: Fingerprints planned for one partition of the join.
PARTITION = 100_000


def shard_bits(total: int, budget: int, shard: int = SHARD) -> int:
    """Leading bits of a block that name a trie, so that ``total`` fingerprints part into tries of about ``shard``."""
    return min(64 // (budget + 1), max(0, (max(1, total // shard) - 1).bit_length()))


def close_pairs(fps: DataFrame, budget: int, shard: int = SHARD, hot_shard: int = HOT_SHARD) -> DataFrame:
    """(a, b): pairs a < b of distinct fingerprints (column fp, long) that differ in 1 to ``budget`` bits, each once.

    Fingerprints that fit one trie are joined in one. More are cut into budget + 1 blocks of
    bits; two fingerprints within the budget agree on one block at least, so each is sent once
    a block, turned to begin with it, to the trie named by the block's first ``shard_bits``: as
    few as make tries of about ``shard`` fingerprints. Each trie is joined with itself from
    that node down to bit 64. A pair is reported by the first trie both are in. A fingerprint has
    at most sum of C(64, k) close ones, so no key gives unboundedly many pairs.

    A trie of ``hot_shard`` fingerprints or more is split into pairs (p, q) of its nodes
    ``HOT_BITS`` below its root, or more the fuller the fullest trie is, that are within the budget, a task each.
    """
    total = fps.count()
    wide = shard_bits(total, budget, shard)
    n = budget + 1 if wide else 1
    edges = [64 * k // n for k in range(n + 1)]

    def turned(k: int) -> str:
        return f"(shiftleft(fp, {edges[k]}) | shiftrightunsigned(fp, {64 - edges[k]}))" if edges[k] else "fp"

    spread = [F.expr(f"struct({k} as k, {f'shiftrightunsigned({turned(k)}, {64 - wide})' if wide else 'cast(0 as long)'} as v)") for k in range(n)]
    sent = fps.select("fp", F.explode(F.array(*spread)).alias("s")).select("s.k", "s.v", "fp")
    least = max(hot_shard, total // 20_000)  # so at most 20,000 tries a block are hot
    hot = sent.groupBy("k", "v").count().filter(F.col("count") >= least)
    fullest = (hot.agg(F.max("count")).first()[0] or 0) if total >= least else 0
    deep = max(HOT_BITS, min(12, (fullest // max(1, hot_shard)).bit_length()))
    copies = 1
    if fullest:
        near = [[q for q in range(1 << deep) if (p ^ q).bit_count() <= budget] for p in range(1 << deep)]
        table = F.array(*(F.lit(",".join(map(str, x))) for x in near))
        p = F.coalesce(*(F.when(F.col("k") == k, F.expr(f"cast(shiftrightunsigned(shiftleft({turned(k)}, {wide}), {64 - deep}) as int)")) for k in range(n)))
        qs = F.when(F.col("hot"), F.split(table[F.col("p")], ",").cast("array<int>")).otherwise(F.array(F.lit(-1)))
        keyed = sent.withColumn("p", p).join(F.broadcast(hot.select("k", "v", F.lit(True).alias("hot"))), ["k", "v"], "left").select("k", "v", "fp", "p", F.explode(qs).alias("q"))
        sent = keyed.select("k", "v", "fp", F.when(F.col("q") < 0, -1).otherwise(F.least("p", "q")).alias("lo"), F.when(F.col("q") < 0, -1).otherwise(F.greatest("p", "q")).alias("hi"))
        copies = len(near[0])
    else:
        sent = sent.select("k", "v", "fp", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def join(batches):
        got = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
        if not got:
            return
        ks, vs, fs, lows, highs = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((highs, lows, vs, ks))
        ks, vs, fs, lows, highs = (x[order] for x in (ks, vs, fs.view(np.uint64), lows, highs))
        cuts = np.flatnonzero(np.r_[True, (ks[1:] != ks[:-1]) | (vs[1:] != vs[:-1]) | (lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1]), True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k, low, high = int(ks[s]), int(lows[s]), int(highs[s])
            lo = edges[k]
            keys = np.sort(rotate(fs[s:e], lo))
            if low == high:
                pairs = trie_self_join(keys, budget, exact=wide + (deep if low >= 0 else 0))
            else:  # the node of prefix low against that of prefix high
                at = int(np.searchsorted(keys << np.uint64(wide) >> np.uint64(64 - deep), high))
                pairs = trie_self_join(keys, budget, exact=wide + deep, halves=at)
            if not len(pairs):
                continue
            a, b = (rotate(keys[p], (64 - lo) % 64) for p in pairs.T)
            first = np.ones(len(a), bool)
            for m in range(k):
                mask = np.uint64(((1 << wide) - 1) << (64 - edges[m] - wide))
                first &= (a ^ b) & mask != 0
            a, b = a[first].view(np.int64), b[first].view(np.int64)
            yield common.batch(a=pa.array(np.minimum(a, b)), b=pa.array(np.maximum(a, b)))

    rows = total * n + (fullest * copies if fullest else 0)
    parts = max(fps.sparkSession.sparkContext.defaultParallelism if wide else 1, -(-rows // PARTITION))
    return sent.repartition(parts, "k", "v", "lo", "hi").select("k", "v", "fp", "lo", "hi").mapInArrow(join, "a long, b long")


# ---- components ------------------------------------------------------------------------


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list, by repeated hooking and jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != (r := root[root])).any():
            root = r


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root): the smallest node of each component of a staged edge table (a, b).

    Each partition first reduces its edges to a forest. If that is at most ``small`` edges, one
    task finishes it; otherwise large-star and small-star rounds do, each written to the shared folder.
    """

    def forest(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            node, root = union_find(*(np.concatenate(x) for x in zip(*got)))
            sel = node != root
            yield common.batch(a=pa.array(root[sel]), b=pa.array(node[sel]))

    def finish(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            node, root = union_find(*(np.concatenate(x) for x in zip(*got)))
            yield common.batch(node=pa.array(node), root=pa.array(root))

    trees, path = common.stage(edges.mapInArrow(forest, "a long, b long"), "forest")
    if trees.count() <= small:
        return trees.coalesce(1).mapInArrow(finish, "node long, root long")
    previous = None
    while True:
        # Every node joins its smallest neighbour: first those above it, then those below it and itself.
        both = trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(low2, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("b")).select(F.col("x").alias("a"), "b").filter("a != b").distinct()
        nxt, nxt_path = common.stage(star, "stars")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.drop_path(path)
        trees, path = nxt, nxt_path
        if state == previous:
            break
        previous = state
    return trees.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(trees.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL_EDGES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near (other rows within ``budget`` bits), component_id (smallest id reachable), component (smallest fingerprint, signed, reachable), text_hash.

    One row for each input row, repeated ids included (each counts as another row). A null or
    empty text has fingerprint zero and is linked like any other. A null id is kept and is never
    a component's id unless all its ids are null; ``component`` names it even then. An empty
    table gives no rows.

    Rows are first reduced to distinct fingerprints with their count and smallest id, so a
    group of copies is one row in the join and in the graph.
    """
    rows = common.two_columns(docs, id_col, text_col)

    def mark(batches):
        import xxhash

        for ids, raw in common.text_batches(batches):
            yield common.batch(doc_id=ids, fp=pa.array(fingerprints(raw).view(np.int64)), text_hash=pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in raw], np.uint64).view(np.int64)))

    marked, _ = common.stage(rows.mapInArrow(mark, "doc_id long, fp long, text_hash long"), "fingerprints")
    classes, _ = common.stage(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    edges, _ = common.stage(close_pairs(classes.select("fp"), budget), "links")
    root = components(edges, small)
    ends = edges.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    near = ends.join(classes.select(F.col("fp").alias("other"), F.col("n").alias("m")), "other").groupBy("fp").agg(F.sum("m").alias("m"))
    linked = classes.join(near, "fp").join(root.withColumnRenamed("node", "fp"), "fp")
    linked, _ = common.stage(linked, "linked")
    reach = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(reach, "root").select("fp", "m", "component_id", F.col("root").alias("component"))
    per = classes.join(known, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    # A class may hold a third of all rows: its row is repeated for each salt, and its documents are spread over them.
    total = classes.agg(F.sum("n")).first()[0] or 0
    least_hot = max(1000, total // 50_000)  # so at most 50,000 classes are hot
    spread = per.join(classes.select("fp", "n"), "fp").select("fp", "n_near", "component_id", "component", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= least_hot, 31).otherwise(0))).alias("salt"))
    hot = classes.filter(F.col("n") >= least_hot).select("fp", F.lit(32).alias("salts"))
    salted = marked.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int"))
    out = salted.join(spread, ["fp", "salt"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id", "component", "text_hash")
