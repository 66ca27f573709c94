"""The subpackage's queries: op<N>_<name>(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm import chat, decontaminate, licenses, packing, pii, quality_model, quality_rules, secrets, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The conversation that imitates a template's marks.
TRICKY = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digest_rows(chat.format_conversations(turns.union(extra), vocabulary()))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_rows(licenses.scan(_table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), vocabulary_ranks())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_rows(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a damaged replica: one byte of every 97th page's
    body differs, and every seventh file has lost its last record."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n_files = max(1, -(-pages.count() // (warc.FILE_RECORDS // 2)))
    good = warc.archive(pages, n_files)
    hurt = pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html")))
    bad = warc.archive(hurt, n_files)
    last = bad.groupBy("file").agg(F.max("seq").alias("seq")).filter("file % 7 = 0")
    found = warc.audit(good, bad.join(last, ["file", "seq"], "left_anti"))
    return found.select("file", "seq", "kind", F.coalesce("key_a", "key_b").alias("page_id"), F.coalesce("offset_a", "offset_b").alias("offset"), F.coalesce("length_a", "length_b").alias("length"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_rows(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(pii.scan(_table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(secrets.scan(_table(spark, sf_dir, "documents")), secrets.BASE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_OP8 = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM fold, ks, unnest(range(1, greatest(1, len(w) - k + 2))) AS t(i)),
hit AS (SELECT doc_id, item, k, i FROM occ JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM fold f LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(r || x, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>') AS escaped FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(escaped)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP7 = r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 2048.0) AS BIGINT)) AS f FROM pages),
rec AS (
  SELECT CAST(((page_id % f) + f) % f AS INTEGER) AS file, page_id, coalesce(html, '') AS html,
    strlen('WARC/1.0..WARC-Type: resource..WARC-Target-URI: ' || coalesce(url, '') || '..Content-Type: text/html..Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || '....' || coalesce(html, '') || '....') AS length
  FROM pages, n),
pos AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", row_number() OVER (PARTITION BY file ORDER BY page_id DESC) = 1 AS tail
  FROM rec WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, seq, CASE WHEN tail AND file % 7 = 0 THEN 'missing' ELSE 'corrupt' END AS kind, page_id, "offset", CAST(length AS BIGINT) AS length
FROM pos WHERE tail AND file % 7 = 0 OR page_id % 97 = 13 AND html <> '' AND html NOT LIKE '#%'
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op7_warc_fixity": _OP7, "op8_decontaminate": _OP8}
