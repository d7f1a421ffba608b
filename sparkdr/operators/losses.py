"""Evaluation forms of training losses for shortened vectors, as aggregates.

``pairs`` hold the similarity ``full`` of two whole vectors and ``short`` of their prefixes.
:func:`prefix_sums` adds up the pairs of all rows with all queries where they are scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors
from . import retrieval


def pairwise(pairs: DataFrame) -> DataFrame:
    """``(loss)``: mean absolute difference of the two similarities."""
    return pairs.agg(F.avg(F.abs(F.col("full") - F.col("short"))).alias("loss"))


def neighbour(pairs: DataFrame, k: int) -> DataFrame:
    """``(loss)``: the same over each row's ``k`` nearest neighbours by the whole vectors."""
    order = Window.partitionBy("qid").orderBy(F.desc("full"), "id")
    return pairwise(pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k))


def reconstruction(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(loss)``: mean squared distance of two vector columns, over all cells."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return df.agg((F.sum(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size(a))).alias("loss"))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ranking(pairs: DataFrame, margin: float = 0.0) -> DataFrame:
    """``(loss)``: softplus of ``margin + negative - positive`` over each question's positives and negatives.

    ``pairs``: ``(qid, short, relevant)``.  A question's list is ranked, so it is bounded.
    """
    own = pairs.groupBy("qid").agg(F.collect_list(F.when(F.col("relevant"), F.col("short"))).alias("p"), F.collect_list(F.when(~F.col("relevant"), F.col("short"))).alias("n"))
    each = F.flatten(F.transform("p", lambda p: F.transform("n", lambda n: _softplus(F.lit(margin) + n - p))))
    flat = own.select(each.alias("losses")).filter(F.size("losses") > 0)
    return flat.agg((F.sum(F.aggregate("losses", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("losses"))).alias("loss"))


def triplet(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    """``(loss)``: mean of ``max(0, margin + negative - positive)`` over ``(positive, negative)`` similarities."""
    return rows.agg(F.avg(F.greatest(F.lit(margin) + F.col("negative") - F.col("positive"), F.lit(0.0))).alias("loss"))


def info_nce(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """``(loss)``: mean over questions of minus the log share of the positives among all candidates."""
    z = F.col("short") / temperature
    top = F.max(z).over(Window.partitionBy("qid"))
    own = pairs.withColumn("e", F.exp(z - top)).groupBy("qid").agg(F.sum(F.when(F.col("relevant"), F.col("e"))).alias("p"), F.sum("e").alias("a"))
    return own.filter("p > 0").agg(F.avg(-F.log(F.col("p") / F.col("a"))).alias("loss"))


def prefix_sums(rows: DataFrame, queries: DataFrame, size: int, temperature: float = 0.05, same: tuple[str, str] | None = None) -> DataFrame:
    """``(qid, difference, n, top, positive, every)`` over each query's pairs with other rows, one row a query.

    The summed difference of ``full`` and ``short``, the pairs, and of ``short / temperature``
    the maximum and the sums of ``exp`` less that maximum, over pairs of equal ``same``
    columns (query's, row's) and over all.
    """
    def fold(x):
        cut = lambda v: v[:, :size] / np.maximum(np.linalg.norm(v[:, :size], axis=1, keepdims=True), 1e-300)
        short, usable = np.round(cut(x.q) @ cut(x.v).T, retrieval.DIGITS), np.isfinite(x.score)
        z = np.where(usable, short / temperature, -np.inf)
        top = z.max(axis=1)
        e = np.exp(z - np.where(np.isfinite(top), top, 0.0)[:, None])
        alike = np.array(x.asked[same[0]], object)[:, None] == np.array(x.rows[same[1]], object)[None] if same else np.zeros(z.shape, bool)
        return np.where(usable, np.abs(np.where(usable, x.score, 0.0) - short), 0.0).sum(1), usable.sum(1), top, np.where(alike, e, 0.0).sum(1), e.sum(1)

    fields = {"query_fields": (same[0],), "row_fields": (same[1],)} if same else {}
    each = retrieval.dense_sums(rows, queries, fold, ["difference", "n", "top", "positive", "every"], exclude_self=True, **fields)
    least = F.exp(F.col("top") - F.max("top").over(Window.partitionBy("qid")))  # one row a query and batch
    own = each.filter("n > 0").withColumn("positive", F.col("positive") * least).withColumn("every", F.col("every") * least)
    return own.groupBy("qid").agg(F.sum("difference").alias("difference"), F.sum("n").cast("long").alias("n"), F.max("top").alias("top"), F.sum("positive").alias("positive"), F.sum("every").alias("every"))


def prefix_difference(sums: DataFrame) -> DataFrame:
    """``(mean_difference, n)`` of :func:`prefix_sums`: how far the prefixes' similarities are off, over all pairs."""
    return sums.agg((F.sum("difference") / F.sum("n")).alias("mean_difference"), F.sum("n").alias("n"))


def prefix_losses(rows: DataFrame, queries: DataFrame, size: int, k: int, same: tuple[str, str], temperature: float = 0.05) -> DataFrame:
    """``(pairwise, neighbour, info_nce)`` of the prefixes of all rows with all queries: one row."""
    sums = prefix_sums(rows, queries, size, temperature, same)
    share = F.when(F.col("positive") > 0, -F.log(F.col("positive") / F.col("every")))
    means = sums.agg((F.sum("difference") / F.sum("n")).alias("pairwise"), F.avg(share).alias("info_nce"))
    near = retrieval.dense_top_k(rows, queries, k, exclude_self=True)
    near = near.join(rows.select("id", F.col("vector").alias("_v")), "id").join(queries.select("qid", F.col("vector").alias("_q")), "qid")
    short = F.round(vectors.dot(vectors.prefix(F.col("_q"), size), vectors.prefix(F.col("_v"), size)), retrieval.DIGITS)
    near = neighbour(near.select("qid", "id", F.col("score").alias("full"), short.alias("short")), k)
    return means.crossJoin(near.withColumnRenamed("loss", "neighbour")).select("pairwise", "neighbour", "info_nce")  # single rows
