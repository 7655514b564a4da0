"""Registered queries of the document operators over their whole tables, and their comparison SQL."""
from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, fingerprints, jaccard_join, language, lm_score, oracle, packing, prefix_trie, quality,
               secret_scan, spelling, token_store, tokens, warc)
from .common import scratch, stage, table

QUERIES = {}
SQL: dict[str, str] = dict(oracle.SQL)


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(fingerprints.edits(table(spark, sf_dir, "documents")), "fingerprints")
    near = fingerprints.near_counts(rows.select(F.col("print").alias("fingerprint")))
    near = near.select(F.col("fingerprint").alias("print"), (F.col("copies") - 1 + F.col("near")).alias("near_docs"))
    return rows.join(near, "print").drop("print")


@register
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    network = language.fit(docs, learn="crc32(cast(doc_id as binary)) % 5 != 0")
    return language.predict(docs, network).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


@register
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@register
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@register
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), tokens.SPACED)
    return token_store.map_documents(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 bigint")


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tokens.WORDS,
                        with_ids=False).drop("ids")


SQL["op6_decontaminate"] = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, len(k) AS size, array_to_string(k, ' ') AS key FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS k
    FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM fold, size WHERE len(w) >= size)),
hit AS (SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_window d JOIN item_window t USING (size, key)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
              SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM hit GROUP BY doc_id)
SELECT f.doc_id, coalesce(len(f.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.chunk_table(table(spark, sf_dir, "pages")), path)
    return warc.records(warc.read_chunks(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, TRUE AS verified
FROM p LEFT JOIN k USING (d, n)
"""


@register
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@register
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)],
                                 "conv_id bigint, turn bigint, role string, text string")
    path = scratch(spark, "chat")
    chat.write(own.unionByName(more), path)
    return chat.digests(spark, path)


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))
