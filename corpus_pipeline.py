"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage reads whole texts of all that its predecessor kept. All but the last return the
columns of documents. A row is named by its id and a 64-bit hash of its text, so repeated ids,
null ids and columns of any other name do no harm; null texts count as empty, texts of any length
are read whole, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.llm import common, decontam, packing, quality, simhash, suffix
from tarsus.llm.queries import table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7).

    A null or empty text has the score of an empty text; rows with equal texts have equal
    scores, so repeated rows stay or go together; without labels nothing reaches 0.7 and all go.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"), label="quality", threshold=0.7)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash one row: that with the smallest id (null ids last), of equal ids that with the smallest text hash, of equal rows any."""
    near = simhash.near_duplicates(docs, budget=2)
    one = near.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one"))
    return common.match(docs, one.select("one.doc_id", "one.text_hash"), "left_semi", once=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50 bytes of an earlier document; documents of which nothing is left go.

    A character of which only some bytes remain goes too. n_chars is counted again, where there
    is such a column. Null and empty texts stay as they are; rows with equal ids don't cut each other.
    """
    cut = suffix.remove_repeats(docs, length=50).filter("n_removed > 0").select("doc_id", "text_hash", F.expr("kept").alias("__tarsus_kept"))

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            k = b.schema.get_field_index("__tarsus_kept")
            text = pa.array([None if x is None else x.decode("utf-8", "ignore") for x in b.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != k), text], [*(n for i, n in enumerate(b.schema.names) if i != k), "__tarsus_kept"])

    texts = cut.mapInArrow(decode, "doc_id long, text_hash long, __tarsus_kept string")
    out = common.match(docs, texts, "left").filter("__tarsus_kept is null or __tarsus_kept <> ''")
    new = {"text": F.coalesce("__tarsus_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__tarsus_kept").isNull(), F.col("n_chars")).otherwise(F.length("__tarsus_kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Null and empty texts hold none and stay; an empty benchmark drops nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids. A null or empty text is one id, the end; repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), window=4096, end=2)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: SQL can't say a learned classifier, suffix arrays or a tokenizer; tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), common.staged()
    for name, stage in STAGES[:-1]:
        docs, path = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_staged(since=before, but=[path])  # what the stage needed, and its predecessor's rows
    return STAGES[-1][1](spark, docs, sf_dir)
