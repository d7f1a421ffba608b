"""Exact duplicates by skew-safe combining.

Digests that occur once need no comparison: they are found by counting digests alone.
The rows of repeated digests are combined in three stages, each of which compares the
full normalised text (it is a grouping key, beside the digest): every task combines its
own equal texts; digest groups are merged by salt, so that a group holding any share of
all rows meets in many tasks; the few winners of the salts are combined into one.  The
decision goes back to every row by an equi-join on digest, length and a second hash,
whose hot keys Spark splits.

Two joins bring small sets of keys to whole texts: the repeated digests, and the rows to
drop.  Up to ``storage.BROADCAST_KEYS`` keys, which are counted first, they are broadcast and no
unique text is shuffled; beyond it both sides are shuffled.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z only; the row with the largest id stays; rows that repeat both id and
text share one decision (and :func:`drop_duplicates` keeps one of them); a null id never wins against another id; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from . import storage

#: Parts into which every digest group is dealt before the final combination.
SALTS = 32


def normalized(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(body: Column) -> Column:
    return F.sha2(F.encode(body, "UTF-8"), 256)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), normalized(F.col(f"`{text_column}`")).alias("body"))
    return rows.withColumn("sha", digest(F.col("body")))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, sha, length, check)`` of every row, as a shared table."""
    rows = _rows(docs, id_column, text_column)
    return storage.materialize(rows.select("id", "sha", F.octet_length("body").alias("length"), F.xxhash64("body").alias("check")), "digests")


def duplicate_groups(docs: DataFrame, marked: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """``(sha, length, check, keep_id, group_size)`` of each normalised text whose digest repeats in ``marked``."""
    repeated = storage.materialize(marked.groupBy("sha").count().filter("count > 1").select("sha"), "repeated-digests")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    rows = _rows(docs, id_column, text_column).withColumn("salt", salt)
    if repeated.count() <= storage.BROADCAST_KEYS:
        content = rows.join(F.broadcast(repeated), "sha")
    else:
        dealt = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        content = rows.join(dealt.hint("merge"), ["sha", "salt"])
    salted = content.groupBy("sha", "salt", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("sha", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.select("sha", F.octet_length("body").alias("length"), F.xxhash64("body").alias("check"), "keep_id", "group_size")


def _decided(docs: DataFrame, id_column: str, text_column: str, salts: int) -> DataFrame:
    """``(id, sha, length, check, keep_id, group_size, kept)`` of every row."""
    marked = digests(docs, id_column, text_column)
    groups = storage.materialize(duplicate_groups(docs, marked, id_column, text_column, salts), "duplicate-groups")
    joined = marked.join(groups.hint("merge"), ["sha", "length", "check"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "id", "sha", "length", "check",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row, dropped ones too."""
    rows = _decided(docs, id_column, text_column, salts)
    return rows.select(F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    repeats = storage.materialize(_decided(docs, id_column, text_column, salts).filter("group_size > 1"), "repeats")
    dropped = storage.materialize(repeats.filter("not kept").select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")).distinct(), "dropped")
    whole = storage.carried(docs, id=F.col(f"`{id_column}`"), sha=digest(normalized(F.col(f"`{text_column}`"))))
    left = whole.join(storage.sized(dropped), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    # rows that repeat id and text are rare: only they ask for a comparison of whole rows
    again = repeats.filter("kept").groupBy("id", "sha").count().filter("count > 1").take(1)
    return (left.dropDuplicates(["id", "sha"]) if again else left).select("row.*")
