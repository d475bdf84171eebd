"""The operators bound to the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bitslices, collocations, decontam, lshforest, packing, pii, repair, substring, suffixes, template, toxicity, warc
from tidemark.llm.common import NULL_ID, table


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class (the smallest doc_id of its group) and its number of links."""
    found = lshforest.near_duplicates(table(spark, sf_dir, "documents"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(null("doc").alias("doc_id"), null("root_doc").alias("class_id"), "n_links")


def op3_superkmer_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null doc_id has no label and is no held-out row."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))


def op6_rotated_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's revisit: the earlier page of its URL, and whether that still holds."""
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")), with_payload=False).where("outcome <> 'full'")
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return found.select(
        page("record_id").alias("page_id"), F.col("url").alias("canonical_url"), "outcome", page("source_id").alias("source_page_id"),
        F.element_at("headers", "etag").alias("etag"), F.element_at("headers", "date").alias("date"), F.element_at("headers", "content-type").alias("content_type"),
    )


def op10_revisit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of op10: every page's revisit with all merged headers and the body of its response."""
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages"))).where("outcome <> 'full'")
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return found.select(page("record_id").alias("page_id"), F.col("url").alias("canonical_url"), "outcome", page("source_id").alias("source_page_id"), "headers", "payload")


OP10_SQL = """
WITH plain AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages),
cut AS (
  SELECT page_id, digest,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(substr(u, length(regexp_extract(u, '^[^/?]*')) + 1), '([?&])((utm_[a-z]*|ref|fbclid|gclid)=[^&]*(&|$))+', '\\1', 'g') AS rest
  FROM plain),
canon AS (
  SELECT page_id, digest, host || regexp_replace(regexp_replace(rest, '[?&]+$', ''), '/$', '') AS canonical_url FROM cut),
earlier AS (
  SELECT *, lag(page_id) OVER w AS before_id, lag(digest) OVER w AS before_digest
  FROM canon WINDOW w AS (PARTITION BY canonical_url ORDER BY page_id))
SELECT page_id, canonical_url,
       CASE WHEN before_id IS NULL THEN 'unresolved' WHEN before_digest = digest THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN before_digest = digest THEN before_id END AS source_page_id,
       '"' || digest || '"' AS etag, CAST(page_id AS VARCHAR) AS date,
       CASE WHEN before_digest = digest THEN 'text/html' END AS content_type
FROM earlier
"""


def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2(F.encode("pii.base", "UTF-8"), 256).alias("base_sha256"), "pii.spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_table(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitslices.near_duplicates(table(spark, sf_dir, "documents"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(null("doc").alias("doc_id"), bitslices.hex_digits(F.col("fp")).alias("fingerprint"), null("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op10_revisit_resolution": OP10_SQL, "op11_conversation_repair": repair.SQL, "op12_phrase_collocations": collocations.SQL}
