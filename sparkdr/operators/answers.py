"""Answer-level scores: ROUGE recall of hits, best passages, keyword accuracy, floored match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.stem import rouge_l, rouge_n, rouge_words


@F.pandas_udf(T.DoubleType())
def rouge1_recall(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([rouge_n(rouge_words(a), rouge_words(b))[1] for a, b in zip(reference, candidate)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l_recall(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(rouge_words(a), rouge_words(b))[1] for a, b in zip(reference, candidate)], dtype="float64")


def floored(value: Column, digits: int = 3) -> Column:
    """Cut, not rounded, to a number of decimals."""
    return F.floor(value * 10**digits) / 10**digits


def rouge_at_k(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``(k, rouge)``: mean over questions of the best ROUGE-1 recall of a gold passage in the first k hits."""
    pairs = hits.join(gold.select("qid", F.col("text").alias("_gold")), "qid").withColumn("recall", rouge1_recall("_gold", "text"))
    best = pairs.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("qid", "k").agg(F.max(F.when(F.col("rank") <= F.col("k"), F.col("recall")).otherwise(0.0)).alias("best"))
    return best.groupBy("k").agg(floored(F.avg("best")).alias("rouge"))


def top_hit_recall(hits: DataFrame, questions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(n, n_above, mean)``: ROUGE-L recall of each question in its first hit."""
    first = hits.filter("rank = 1").join(questions.select("qid", F.col("text").alias("_q")), "qid").withColumn("recall", rouge_l_recall("_q", "text"))
    return first.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("recall") >= threshold).cast("int")).alias("n_above"), F.avg("recall").alias("mean"))


def best_passage(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """``(qid, id, recall)``: the hit that holds most of the question's answer; ties by rank."""
    pairs = hits.join(answers.select("qid", F.col("text").alias("_a")), "qid").withColumn("recall", rouge1_recall("_a", "text"))
    order = F.struct(-F.col("recall"), F.col("rank"))
    return pairs.groupBy("qid").agg(F.min_by("id", order).alias("id"), F.max("recall").alias("recall"))


def keyword_accuracy(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(qid, accuracy)``: share of a question's ``keywords`` found among the keywords of its first k hits."""
    found = hits.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("_found"))
    wanted = questions.select("qid", F.array_distinct("keywords").alias("_wanted")).join(found, "qid", "left")
    share = F.size(F.array_intersect("_wanted", F.coalesce("_found", F.array().cast("array<string>")))) / F.size("_wanted")
    return wanted.filter(F.size("_wanted") > 0).select("qid", share.alias("accuracy"))
