"""The registered corpus queries on the smallest tables: columns, types, rows, and their SQL."""

import os

import pytest

from tarsus.llm import queries

from ..oracle import SMALL, same, views

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
CONTRACT = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_simhash": "doc_id bigint, fingerprint string, n_near bigint, component_id bigint",
    "op10_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    for column in CONTRACT.get(name, "doc_id bigint, item_id bigint").split(", "):
        n, kind = column.split()
        assert kinds[n] == kind
    if name in queries.ORACLE_SQL:
        same(df, views(SMALL), queries.ORACLE_SQL[name])
    elif name != "op5_packing":
        assert df.count() == queries.table(spark, SMALL, "pages" if name == "op1_warc" else "documents").count()


def test_quality_on_held_out_labels(spark):
    scored = queries.op3_quality(spark, SMALL).filter("held_out").join(queries.table(spark, SMALL, "labels"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)


def test_packing_leaves_little_padding(spark):
    from pyspark.sql import functions as F

    per = queries.op5_packing(spark, SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(4096 if r.n & (r.n - 1) else r.n for r in per)
    assert padded < 1.08 * sum(r.n for r in per)
