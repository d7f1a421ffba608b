"""Fusion of ranked lists and of reranking scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .retrieval import top_k


def _together(lists: list[DataFrame]) -> DataFrame:
    if not lists:
        raise ValueError("no lists to fuse")
    marked = [one.select("qid", "id", "score", "rank").withColumn("list", F.lit(i)) for i, one in enumerate(lists)]
    return reduce(DataFrame.unionByName, marked)


def weights_of(given: list[float] | None, n: int) -> list[float]:
    """Weights that sum to one; equal ones by default."""
    given = [1.0] * n if given is None else list(given)
    if len(given) != n or min(given) < 0 or not sum(given):
        raise ValueError("one non-negative weight a list is needed, and not all zero")
    return [w / sum(given) for w in given]


def reciprocal_rank(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum over the lists of ``1 / (constant + rank)``."""
    fused = _together(lists).groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(fused, k)


def _scaled(method: str) -> Column:
    own = Window.partitionBy("qid", "list")
    s = F.col("score")
    if method == "arctan":
        return 2 * F.atan(s) / F.pi()
    if method == "minmax":
        low, high = F.min(s).over(own), F.max(s).over(own)
        return F.when(high > low, (s - low) / (high - low)).otherwise(F.lit(1.0))
    if method == "none":
        return s
    raise ValueError(f"normaliser {method!r}")


def weighted(lists: list[DataFrame], k: int, weights: list[float] | None = None, normalizer: str = "minmax") -> DataFrame:
    """Weighted sum of normalised scores; the weights are made to sum to one."""
    shares = weights_of(weights, len(lists))
    every = _together(lists).withColumn("part", _scaled(normalizer))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("list") + 1)
    return top_k(every.groupBy("qid", "id").agg(F.sum(share * F.col("part")).alias("score")), k)
