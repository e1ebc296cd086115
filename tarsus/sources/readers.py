"""Readers: text tables with explicit schemas and the empty-is-missing rule, JSON, logs, benchmark arms, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels, text

GENERATION = ("qid", "variety", "condition", "model", "family", "question", "gold_answer", "answer", "pivot_question", "model_id", "temperature", "resolved_model_id", "pivot_model_id", "timestamp", "error")
CANDIDATE = ("qid", "question_msa", "gold_answer", "dialect_candidate", "backtranslation_msa", "sub_variety", "requested_model", "translation_model", "backtranslation_model", "n_exemplars", "coda", "temperature")


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, line_feeds: bool = True) -> DataFrame:
    """A CSV table of text columns: quoted line feeds, doubled quotes, a byte-order mark; missing fields are empty texts.

    A file with quoted line feeds is read by one task; ``line_feeds=False`` states that there are none, so that large files are split.
    """
    r = spark.read.option("header", True).option("multiLine", line_feeds).option("escape", '"').option("quote", '"')
    r = r.schema(strings(columns)) if columns else r.option("inferSchema", False)
    return r.csv(list(paths) if not isinstance(paths, str) else paths).na.fill("")


def many(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, seq: str | None = None) -> DataFrame:
    """Several CSV tables as one, with ``source_file`` and, for more than one, ``analysis_run`` (the folder's name); ``seq``: an ordinal by table, file and row."""
    out = None
    for k, p in enumerate(paths):  # headers may differ from file to file
        one = with_sequence(csv(spark, p, columns), seq, k) if seq else csv(spark, p, columns)
        one = one.withColumn("source_file", F.col("_metadata.file_path"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if len(paths) > 1:
        out = out.withColumn("analysis_run", F.element_at(F.split("source_file", "/"), -2))
    return out.na.fill("")


def with_sequence(df: DataFrame, name: str = "_seq", table: int = 0) -> DataFrame:
    """An ordinal of a scanned CSV table, for readers whose order matters: files by name, rows as they stand. Spark reads the files in another order."""
    return df.withColumn(name, F.struct(F.lit(table).alias("table"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def labelled_rows(rows: DataFrame, label: str = "hallucinated") -> DataFrame:
    """Labelled answers: blank answers and bad tags are dropped, the label is derived."""
    tags = [F.col(f"`{t}`") for t in labels.TAGS if t in rows.columns]
    d = rows.filter(text.ws_trim(text.text_or_empty("answer")) != "")
    d = d.filter(labels.valid_tags(tags)) if tags else d
    return d.withColumn("label", labels.binary_label(tags, F.col(label) if label in rows.columns else None))


def judge_rows(rows: DataFrame, seq: str, label: str = "hallucinated") -> DataFrame:
    """Labelled answers with group ids, which follow first appearance of the question."""
    from ..operators.dedupe import group_ordinals

    return group_ordinals(labelled_rows(rows, label), "question", seq)


def benchmark(seed: DataFrame | None, arms: dict[str, DataFrame | None], limit: int | None = None, seq: str | None = None) -> DataFrame:
    """Questions of all varieties: the seed is required, missing arms are left out."""
    if seed is None:
        raise FileNotFoundError("the seed table is required")
    out = seed.select("qid", F.lit("msa").alias("variety"), F.col("question_msa").alias("question"), "gold_answer", *([seq] if seq else []))
    for name, arm in sorted(arms.items()):
        if arm is not None:
            out = out.unionByName(arm.select("qid", F.lit(name).alias("variety"), F.col("question_dialect").alias("question"), "gold_answer", *([seq] if seq else [])))
    if limit is not None:
        from ..operators.sampling import first_rows

        out = first_rows(out, ["variety"], seq or "qid", limit)
    return out


def exemplars(rows: DataFrame, seq: str, least: int = 1) -> tuple[DataFrame, str]:
    """Pairs with both sides, and the first stated sub-variety; an error below ``least`` pairs."""
    msa, dialect = (text.ws_trim(text.text_or_empty(c)).alias(c) for c in ("msa_question", "dialect_question"))
    both = (msa != "") & (dialect != "")
    sub = text.ws_trim(text.text_or_empty("sub_variety")) if "sub_variety" in rows.columns else F.lit("")
    got = rows.agg(F.count_if(both).alias("n"), F.min_by(sub, F.when(sub != "", F.col(seq))).alias("sub")).first()
    if got["n"] < least:
        raise ValueError(f"{got['n']} exemplars; at least {least} are needed")
    return rows.filter(both).select(msa, dialect), got["sub"] or ""


def annotation(rows: DataFrame, parse, column: str = "human_label", seq: str | None = None) -> DataFrame:
    """(sample_id, label) of an annotation sheet; the last of repeated rows counts."""
    from ..operators.dedupe import last_wins

    d = rows.withColumn("label", parse(F.col(column)))
    return (last_wins(d, ["sample_id"], seq) if seq else d.dropDuplicates(["sample_id"])).select("sample_id", "label")


def json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def find(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files of a name below a folder, in order; listed without being read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return sorted(r.path for r in df.collect())  # a path a run


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of a snapshot's files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.select(F.regexp_extract("path", rf"{root.rstrip('/').rpartition('/')[2]}/(.*)$", 1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Problems of a snapshot against its manifest: missing, extra, size, sha256. No rows: sound."""
    j = stated.alias("s").join(found.alias("f"), "path", "full")
    problem = F.when(F.col("f.size").isNull(), "missing").when(F.col("s.size").isNull(), "extra").when(F.col("s.size") != F.col("f.size"), "size").when(F.col("s.sha256") != F.col("f.sha256"), "sha256")
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def sha256(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file, or of the names and digests of a folder's files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    got = sorted(map(tuple, d.collect()))  # a digest a file
    if len(got) == 1:
        return got[0][1]
    import hashlib

    return hashlib.sha256("\n".join(f"{n} {h}" for n, h in got).encode()).hexdigest()


def total_size(stated: DataFrame) -> DataFrame:
    """Files and bytes of a manifest."""
    return stated.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def snapshot(spark: SparkSession, source: str, target: str, name: str = "manifest.json") -> dict:
    """Copy a folder of files into another and put a manifest beside it; returns files and bytes. Files are copied by tasks, as bytes."""
    found = manifest(spark, source)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")
    root = source.rstrip("/").rpartition("/")[2]
    wrapped, into = spark._jsc.hadoopConfiguration(), target.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for r in files.collect():  # a copy a file, between Hadoop file systems
        rest = r.path.rpartition(f"/{root}/")[2]
        a, b = path(r.path), path(f"{into}/{rest}")
        if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(wrapped), a, b.getFileSystem(wrapped), b, False, True, wrapped):
            raise OSError(f"{r.path} wasn't copied")
    from .sinks import json_and_csv

    json_and_csv(found.orderBy("path"), f"{into}.{name.removesuffix('.json')}")
    return total_size(found).first().asDict()
