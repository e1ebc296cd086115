"""Driver tables in the roles of the evaluation engine.

The star-schema and corpus tables hold no evaluation runs, so: ``events`` is a generation log
(view: baseline arm; click, purchase, signup and error: four comparison arms; the model from
``props``; small values failed or degenerated, large ones hallucinate); ``labels`` are two raters; turns
of ``conversations`` are questions and answers; a document's share of a length is a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import canonical

VARIETY = {"view": "msa", "click": "gulf", "purchase": "egyptian", "signup": "levantine", "error": "sudanese"}
FAILED, DEGENERATE, HALLUCINATED = 1.0, 2.6, 35.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if they come in fewer partitions than there are cores, as those of a single small file do; for work that costs more than moving them."""
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df  # it has a shuffle, and to count its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append log: qid, variety, condition, model, seq, value, ok, decision, degeneration_reasons."""
    e = table(spark, sf_dir, "events")
    variety = F.element_at(F.create_map(*(F.lit(x) for kv in VARIETY.items() for x in kv)), F.col("event_type"))
    v = F.col("value")
    model = F.concat(F.lit("m"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(6)).cast("string"))
    return e.select(
        F.col("user_id").cast("string").alias("qid"), variety.alias("variety"), F.lit("direct").alias("condition"), model.alias("model"), F.col("event_id").alias("seq"), v.alias("value"), (v >= FAILED).alias("ok"),
        F.when(v < DEGENERATE, "degeneration").when(v >= HALLUCINATED, "factual_hallucination").otherwise("clean").alias("decision"),
        F.when(v < FAILED, "generation_error").when(v < DEGENERATE, "heavy_repetition").otherwise("").alias("degeneration_reasons"),
    )


def canonical_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(generations(spark, sf_dir), F.col("ok"), "seq")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: conv_id, turn, question, answer."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(nxt, ["conv_id", "turn"])


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in steps of 0.001 that a text's length gives: doc_id, label, toxic, score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", "source", "lang", F.col("quality").alias("label"), "toxic", (F.pmod(F.col("n_chars") * 7919 + F.col("doc_id") * 104729, F.lit(1000)) / 1000.0).alias("score"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical generations with a probability (null where degenerate) and its threshold."""
    g = canonical_generations(spark, sf_dir)
    p = F.when(F.col("decision") != "degeneration", F.least(F.lit(1.0), F.round(F.col("value") / 70.0, 3)))
    return g.withColumn("p", p).withColumn("threshold", F.lit(0.5))
