"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam, lm, packing, quality, rules, simhash, suffix, token_files, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))
    return warc.read(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50, kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality", threshold=0.7).drop("text_hash")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end=2)
    common.release(spark)
    return token_files.with_crc(token_files.read(spark, path))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), window=4096, end=2)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), order=3)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), budget=2).drop("text_hash", "component")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality")[0].drop("text_hash")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_lm": op8_lm,
    "op9_simhash": op9_simhash,
    "op10_rules": op10_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": r"""
        WITH bag AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
        it AS (SELECT item_id, w, len(w) AS n, len(w) - len(w) // 3 AS cut FROM bag WHERE len(w) > 0),
        c AS (SELECT count(*) AS items, avg(n) AS mean, greatest(48, max(n)) AS half FROM it),
        tf AS (SELECT item_id, n, term, count(*) AS tf FROM (SELECT item_id, n, unnest(w) AS term FROM it) GROUP BY item_id, n, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT item_id, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS s FROM tf JOIN df USING (term), c),
        post AS (SELECT item_id, term, s / sum(s) OVER (PARTITION BY item_id) AS weight FROM s),
        part AS (SELECT item_id, CASE WHEN len(w[1:cut]) >= 3 THEN list_distinct(list_transform(range(1, len(w[1:cut]) - 1), lambda i: w[1:cut][i] || chr(1) || w[1:cut][i + 1] || chr(1) || w[1:cut][i + 2])) WHEN len(w[1:cut]) > 0 THEN [array_to_string(w[1:cut], chr(1))] ELSE [] END AS q, CASE WHEN cut < n THEN CASE WHEN len(w[greatest(0, cut - 2) + 1:]) >= 3 THEN list_distinct(list_transform(range(1, len(w[greatest(0, cut - 2) + 1:]) - 1), lambda i: w[greatest(0, cut - 2) + 1:][i] || chr(1) || w[greatest(0, cut - 2) + 1:][i + 1] || chr(1) || w[greatest(0, cut - 2) + 1:][i + 2])) WHEN len(w[greatest(0, cut - 2) + 1:]) > 0 THEN [array_to_string(w[greatest(0, cut - 2) + 1:], chr(1))] ELSE [] END ELSE [] END AS a FROM it),
        doc AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
        word AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM doc),
        known AS (SELECT doc_id, term, pos // half AS k FROM word, c WHERE term IN (SELECT term FROM df)),
        pas AS (SELECT doc_id, term, k FROM known UNION SELECT doc_id, term, k - 1 FROM known WHERE k > 0),
        hit AS (SELECT doc_id, k, item_id, sum(weight) AS v FROM pas JOIN post USING (term) GROUP BY doc_id, k, item_id HAVING sum(weight) >= 0.5 - 1e-9),
        cand AS (SELECT h.doc_id, h.item_id, round(h.v, 6) AS score, h.k * half AS first_word, d.w[h.k * half + 1:(h.k + 2) * half] AS w FROM hit h JOIN doc d ON d.doc_id = h.doc_id, c),
        sh AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END AS have FROM cand),
        o AS (SELECT doc_id, sh.item_id, score, CASE WHEN len(q) > 0 THEN len(list_intersect(q, have)) / len(q) ELSE 1.0 END AS question_overlap, CASE WHEN len(a) > 0 THEN len(list_intersect(a, have)) / len(a) ELSE 1.0 END AS answer_overlap, first_word, len(w) AS n_words FROM sh JOIN part ON part.item_id = sh.item_id)
        SELECT doc_id, item_id, score, question_overlap, answer_overlap, first_word, n_words FROM o WHERE question_overlap >= 0.4 AND answer_overlap >= 0.4
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, first_word) = 1
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
        SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN d.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id > f.first_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
    """,
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
        hit AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE f.m < w.doc_id),
        edge AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS e FROM hit),
        grp AS (SELECT doc_id, i, sum(e) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
        run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY doc_id, g),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
        cut AS (SELECT d.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS k, sum(b - a) AS removed, count(*) AS spans FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY d.doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
    """,
}
