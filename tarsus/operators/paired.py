"""Paired drift between comparison arms and one baseline arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels

ARM = ("model", "variety", "condition")
CELLS = ("clean_clean", "clean_to_hallucination", "hallucination_to_clean", "hallucination_hallucination")


def pairs(rows: DataFrame, baseline: str = "msa", baseline_condition: str = "direct") -> DataFrame:
    """Each comparison row beside its model's baseline row for the same qid.

    ``rows`` has one row a key, with ``decision`` and ``degeneration_reasons``. Arms without pairs vanish.
    """
    d = labels.decision(F.col("decision"), F.lit(None).cast("string"))
    marked = rows.withColumn("label", labels.factual_label(d)).withColumn("degenerate", labels.is_degenerate(d, F.col("degeneration_reasons")))
    base = marked.filter((F.col("variety") == baseline) & (F.col("condition") == baseline_condition)).select("model", "qid", F.col("label").alias("label_msa"), F.col("degenerate").alias("degenerate_msa"))
    return marked.filter(F.col("variety") != baseline).join(base, ["model", "qid"])


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of two discordant counts, summed in log space so that no count underflows."""
    n, k = b + c, F.least(b, c)
    # log of C(n, i) / 2^n, from one term to the next
    start = F.struct((n * F.log(F.lit(0.5))).alias("t"), F.exp(n * F.log(F.lit(0.5))).alias("s"))
    step = lambda a, i: F.struct((a.t + F.log(n - i + 1) - F.log(i)).alias("t"), (a.s + F.exp(a.t + F.log(n - i + 1) - F.log(i))).alias("s"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a.s)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def benjamini_hochberg(df: DataFrame, p: str, q: str, ties: tuple[str, ...]) -> DataFrame:
    """False-discovery-rate adjusted p values. One row a test: the ranking is over all of them in one place, after any grouping."""
    ranked = df.withColumn("__rank", F.row_number().over(W.orderBy(p, *ties))).withColumn("__m", F.count(F.lit(1)).over(W.partitionBy()))
    capped = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))
    return ranked.withColumn(q, F.min(capped).over(W.orderBy("__rank").rowsBetween(W.currentRow, W.unboundedFollowing))).drop("__rank", "__m")


def hds(paired: DataFrame, digits: int = 6) -> DataFrame:
    """The drift table: a row an arm, from one aggregation of the pairs."""
    both = F.col("label_msa").isNotNull() & F.col("label").isNotNull()
    cell = lambda x, y: F.count_if((F.col("label_msa") == x) & (F.col("label") == y))
    failed = lambda d, label: (F.col(d) | (F.coalesce(F.col(label), F.lit(0)) == 1)).cast("int")
    t = paired.groupBy(*ARM).agg(
        F.count("*").alias("n_paired_total"),
        F.count_if(both).alias("n_paired_factual"),
        F.count_if("degenerate_msa").alias("n_degenerated_msa"),
        F.count_if("degenerate").alias("n_degenerated_dialect"),
        F.avg(F.col("degenerate_msa").cast("int")).alias("degeneration_rate_msa"),
        F.avg(F.col("degenerate").cast("int")).alias("degeneration_rate_dialect"),
        F.avg(failed("degenerate_msa", "label_msa")).alias("headline_failure_rate_msa"),
        F.avg(failed("degenerate", "label")).alias("headline_failure_rate_dialect"),
        F.avg(F.when(both, F.col("label_msa"))).alias("hallucination_rate_msa"),
        F.avg(F.when(both, F.col("label"))).alias("hallucination_rate_dialect"),
        *(cell(x, y).alias(n) for n, (x, y) in zip(CELLS, ((0, 0), (0, 1), (1, 0), (1, 1)))),
        *([F.min_by("family", "qid").alias("family")] if "family" in paired.columns else []),
    )
    return from_cells(t, digits)


def from_cells(t: DataFrame, digits: int = 6) -> DataFrame:
    """Rates, drift, IoU, p and q from the four transition counts; existing rates are rounded."""
    cc, ch, hc, hh = map(F.col, CELLS)
    n = cc + ch + hc + hh
    base, arm = F.try_divide(hc + hh, n), F.try_divide(ch + hh, n)
    for c in t.columns:
        if c.endswith(("rate_msa", "rate_dialect")):
            t = t.withColumn(c, F.round(c, digits))
    t = (
        t.withColumn("hallucination_rate_msa", F.round(base, digits))
        .withColumn("hallucination_rate_dialect", F.round(arm, digits))
        .withColumn("hds", F.round(arm - base, digits))
        .withColumn("hallucination_iou", F.round(F.try_divide(hh, ch + hc + hh), digits))
        .withColumn("mcnemar_exact_p", F.round(mcnemar_exact(ch, hc), digits))
    )
    return benjamini_hochberg(t, "mcnemar_exact_p", "mcnemar_bh_q", ARM).withColumn("mcnemar_bh_q", F.round("mcnemar_bh_q", digits))


def percentile_ci(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Linearly interpolated lower, middle and upper percentiles of a value by group."""
    a = (1 - level) / 2
    return df.groupBy(*keys).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in (("ci_low", a), ("median", 0.5), ("ci_high", 1 - a))))


def bootstrap(arms: DataFrame, iterations: int = 2000, seed: int = 42, keys: tuple[str, ...] = ARM) -> DataFrame:
    """Percentile intervals of both rates and of the drift by paired resampling.

    ``arms`` has the four transition counts. Resampling pairs with replacement draws the four
    counts from a multinomial, so an arm costs ``iterations`` draws of four numbers however
    many pairs it has. Each arm's generator is seeded by SHA-256 of the seed and its keys.
    """
    import numpy as np
    import pandas as pd

    names = [f"{m}_ci_{s}" for m in ("hallucination_rate_msa", "hallucination_rate_dialect", "hds") for s in ("low", "high")]

    def run(batches):
        import hashlib

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = [getattr(row, x) for x in keys]
                cells = np.array([getattr(row, c) for c in CELLS], float)
                n = int(cells.sum())
                if not n:
                    out.append([*k, *[None] * 6])
                    continue
                r = np.random.default_rng(int(hashlib.sha256("|".join(map(str, [seed, *k])).encode()).hexdigest()[:16], 16))
                d = r.multinomial(n, cells / n, size=iterations)
                base, arm = (d[:, 2] + d[:, 3]) / n, (d[:, 1] + d[:, 3]) / n
                out.append([*k, *(round(float(v), 6) for x in (base, arm, arm - base) for v in np.percentile(x, [2.5, 97.5]))])
            yield pd.DataFrame(out, columns=[*keys, *names])

    return arms.select(*keys, *CELLS).mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + ", ".join(f"{n} double" for n in names))


def bootstrap_exact(paired: DataFrame, iterations: int = 2000, seed: int = 42, keys: tuple[str, ...] = ARM) -> DataFrame:
    """The same intervals by drawing pair after pair with Python's generator, pairs in order of the qid as text.

    For small arms, where a published interval is to be met: an arm's pairs must fit one task.
    """
    import pandas as pd

    from ..functions.stats import percentile, resampled

    names = [f"{m}_ci_{s}" for m in ("hallucination_rate_msa", "hallucination_rate_dialect", "hds") for s in ("low", "high")]

    def run(key, pdf):
        import hashlib

        pdf = pdf.sort_values("qid")
        n = len(pdf)
        x, y = resampled(pdf["label_msa"].to_numpy(), pdf["label"].to_numpy(), iterations, int(hashlib.sha256("|".join(map(str, [seed, *key])).encode()).hexdigest()[:16], 16))
        draws = [(a / n, b / n, b / n - a / n) for a, b in zip(x.tolist(), y.tolist())]
        ends = [round(percentile(list(c), p), 6) for c in zip(*draws) for p in (0.025, 0.975)]
        return pd.DataFrame([[*key, *ends]], columns=[*keys, *names])

    rows = paired.filter("label is not null and label_msa is not null").select(*keys, F.col("qid").cast("string"), "label", "label_msa")
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + ", ".join(f"{n} double" for n in names))
