"""Reranking of hits and the combination of old and new scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def combine(hits: DataFrame, method: str = "none", weight: float = 0.5) -> DataFrame:
    """Add ``combined`` from ``score`` and ``similarity``.

    ``none``: the similarity; ``weight``: ``w * similarity + (1 - w) * score``; ``rrf``:
    ``1 / (n + i) + 1 / (n + j)`` of the two ranks from 1 in lists of n hits.
    """
    own = Window.partitionBy("qid")
    if method == "none":
        value = F.col("similarity")
    elif method == "weight":
        value = weight * F.col("similarity") + (1 - weight) * F.col("score")
    elif method == "rrf":
        n = F.count(F.lit(1)).over(own)
        old = F.row_number().over(own.orderBy(F.desc("score"), "id"))
        new = F.row_number().over(own.orderBy(F.desc("similarity"), "id"))
        value = 1.0 / (n + old) + 1.0 / (n + new)
    else:
        raise ValueError(f"combination {method!r}")
    return hits.withColumn("combined", value.cast("double"))


def rerank(hits: DataFrame, similarity: Column, head: int = 0, method: str = "none", weight: float = 0.5) -> DataFrame:
    """New ranks by the combined score; hits beyond the first ``head`` (0: none) follow unchanged."""
    inside = F.lit(True) if head <= 0 else F.col("rank") <= head
    scored = hits.filter(inside).withColumn("similarity", similarity)
    front = combine(scored, method, weight).withColumn("in_head", F.lit(True))
    if head > 0:
        tail = hits.filter(~inside).withColumn("similarity", F.lit(None).cast("double")).withColumn("combined", F.col("score").cast("double")).withColumn("in_head", F.lit(False))
        front = front.unionByName(tail)
    order = Window.partitionBy("qid").orderBy(F.desc("in_head"), F.when(F.col("in_head"), F.col("combined")).desc_nulls_last(), "rank")
    return front.withColumn("new_rank", F.row_number().over(order))


def with_pair_scores(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], query_text: str = "query_text", text: str = "text", lower: bool = False) -> DataFrame:
    """Add ``similarity`` from a pair scorer (a cross-encoder) called on batches of texts."""
    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype="float64")

    q, t = F.col(query_text), F.col(text)
    return hits.withColumn("similarity", score(F.lower(q), F.lower(t)) if lower else score(q, t))


def with_encoded(hits: DataFrame, passages: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Encode each distinct passage of the hits once, across queries, and join the vectors back."""
    needed = passages.join(hits.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    return hits.join(encode(needed), key)


def with_sparse_similarity(hits: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Add ``similarity``: the dot product of ``queries(qid, term, weight)`` and ``passages(id, term, weight)``, 0 where no term is shared.

    Only the hits' pairs are scored: their passages' terms meet their own query's.
    """
    pairs = hits.select("qid", "id").distinct()
    held = pairs.join(passages.select("id", "term", F.col("weight").cast("double").alias("_p")), "id")
    both = held.join(queries.select("qid", "term", F.col("weight").cast("double").alias("_q")), ["qid", "term"])
    # rounded, so that ties do not depend on the order of additions
    sums = both.groupBy("qid", "id").agg(F.round(F.sum(F.col("_p") * F.col("_q")), 9).alias("similarity"))
    return hits.join(sums, ["qid", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
