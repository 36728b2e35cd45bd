"""The queries of this subpackage's operators over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspark.llm import decontam, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, token_files, url_filter
from inkspark.llm.common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return rows.select("doc_id", "n_lines", "n_dropped", rows["kept"].alias("kept_sha256"))


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, 1)


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return rows.selectExpr("doc_id", "shard", "tier", "lang", "source", "n_chars", "octet_length(text) AS n_bytes", "sha2(text, 256) AS text_sha256")


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def decontam_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup_query,
    "op2_url_filter": url_filter_query,
    "op3_packing": packing_query,
    "op4_sharding": sharding_query,
    "op5_token_files": token_files_query,
    "op6_near_dedup": near_dedup_query,
    "op7_quality_classifier": quality_classifier_query,
    "op8_license_scan": license_scan_query,
    "op9_quality_rules": quality_rules_query,
    "op10_decontamination": decontam_query,
}

_LINES = """
SELECT doc_id, i, line, key, length(key) AS n FROM (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line,
         translate(regexp_replace(unnest(ls), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
"""

ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(regexp_extract_all(text, '[A-Z]{2,}[.,]?!')) AS n_shouts
  FROM split LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_lines >= 10 AND 100 * n_dup_lines > 50 * n_lines OR 10 * n_shouts > 3 * n_words) AS kept
FROM counted
""",
    "op1_line_dedup": f"""
WITH lines AS ({_LINES}),
keys AS (SELECT key, max(doc_id) AS last FROM lines WHERE n >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.last AS gone FROM lines l LEFT JOIN keys k ON l.key = k.key AND l.n >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_decontamination": """
WITH words AS (
  SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
shingles AS (
  SELECT DISTINCT k, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
items AS (SELECT id, count(*) AS n FROM shingles WHERE k = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.k = 'd' AND b.k = 'b' JOIN items i ON i.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n)
""",
}
