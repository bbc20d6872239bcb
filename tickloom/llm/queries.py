"""Queries of this subpackage's operators over the driver's tables, with SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_counts, lsi_decontam, mixing, near_dedup, quality_llr, rans, secret_scan, sharding, style_tree, suffix_dedup
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return lsi_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken")
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
-- with the first k sources clamped, the rest share what is left
l AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM o),
f AS (SELECT k, clamped, share, total FROM l WHERE (total - clamped) * w <= 3 * source_size * share ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.k < f.k THEN 3.0::DOUBLE * source_size ELSE (f.total - f.clamped)::DOUBLE * w / f.share END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
m AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS missing FROM p),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g)
SELECT d.doc_id, d.size, m.source_size, m.target,
       (d.size * least(3, m.whole + CASE WHEN 2 * c.upto - c.words <= 2 * m.missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extracted_pages(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_llr.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate, with the forest's verdict."""
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": OP3_SQL}
