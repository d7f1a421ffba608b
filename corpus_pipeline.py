"""Corpus pipeline over ``documents``: filter, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before it kept
and returns a frame that is written as Parquet and read again for the next stage; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdr.llm import bpe_codec, exact_dedup, mixing, near_dedup, rules, storage
from sparkdr.sources.readers import spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject.

    Rows are scored one by one: null and empty texts by the rules for statistics of 0, whole
    texts however long, repeated rows alike, null ids as others.  An empty table stays empty;
    all columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.keep_quality(docs, rules.fit_quality(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: that of the largest id.

    Null and empty texts are one group; texts are compared whole; of rows that repeat id and
    text one stays; a null id stays only in a group without others.  An empty table stays
    empty; all columns stay, whatever their names.
    """
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates (five words, similarity 0.8): that of the smallest id.

    Texts without words and rows with a null id are linked with nothing and stay; rows that
    repeat an id are one document, which stays or goes; texts are compared whole.  An empty
    table stays empty; all columns stay, whatever their names.
    """
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop and repeat documents so that sources meet their target weights.

    Null sources are a source of their own, last in order; texts without words weigh nothing
    and stay once; rows with null or repeated ids are rows of their own; a long text counts
    with all its words; ties go by hash, so reruns agree.  An empty table stays empty; all
    columns stay, whatever their names.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every row, with the digest of what they decode to.

    Null texts count as empty and have no tokens; texts are encoded whole; repeated rows and
    null ids give rows of their own.  An empty table stays empty; other columns are left out.
    """
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: Learned and probabilistic stages cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = storage.materialize(docs, f"stage-{name}")
    return docs
