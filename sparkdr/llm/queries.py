"""Registered queries of this subpackage and, where SQL can express them, their SQL.

Every query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import bpe_codec, exact_dedup, license_scan, media, mixing, near_dedup, rules, span_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.score_quality(docs, rules.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarize(_table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeated passages of 50 words and more; shorter page furniture stays
    return span_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents"), span=2, least_words=50)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_span_dedup": op7_span_dedup,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.near_duplicates_sql(words=4, percent=80),
    "op4_license_scan": license_scan.summary_sql(),
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS body
              FROM documents)
    """,
}
