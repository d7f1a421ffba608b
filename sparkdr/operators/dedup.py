"""De-duplication of ranked hits, and set operations on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stem import rouge_n, rouge_words


def keep_first(hits: DataFrame, *keys: str, query: str = "qid", rank: str = "rank", null_is_new: bool = False) -> DataFrame:
    """The best-ranked hit of each key within its query; with ``null_is_new`` null keys all stay."""
    order = Window.partitionBy(query, *keys).orderBy(rank)
    first = F.row_number().over(order) == 1
    if null_is_new:
        for key in keys:
            first = first | F.col(key).isNull()
    return hits.withColumn("_first", first).filter("_first").drop("_first")


def dense_rank_again(hits: DataFrame, query: str = "qid", rank: str = "rank", start: int = 1) -> DataFrame:
    """Ranks without gaps, in the old order."""
    return hits.withColumn(rank, (F.row_number().over(Window.partitionBy(query).orderBy(rank)) - 1 + start).cast("int"))


def drop_similar(hits: DataFrame, threshold: float = 0.9, query: str = "qid", rank: str = "rank", text: str = "text") -> DataFrame:
    """Greedy ROUGE-1: in rank order a hit goes when its F with a kept hit reaches the threshold.

    Sequential within a query by nature: each query's hits meet one worker in rank order,
    as a stream that holds the words of the kept ones only.
    """
    def run(frames):
        asked, words = object(), []
        for frame in frames:
            kept = []
            for at, (key, value) in enumerate(zip(frame[query].tolist(), frame[text].tolist())):
                if key != asked:
                    asked, words = key, []
                own = rouge_words(value)
                if all(rouge_n(w, own)[2] < threshold for w in words):
                    kept.append(at)
                    words.append(own)
            yield frame.iloc[kept]

    return hits.repartition(query).sortWithinPartitions(query, rank).mapInPandas(run, hits.schema)


def best_per_document(hits: DataFrame, query: str = "qid", document: str = "doc_id") -> DataFrame:
    """Highest score of each document of a query."""
    return hits.groupBy(query, document).agg(F.max("score").alias("score"))


def id_sets(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection and both differences of two one-column id frames, as sets."""
    return {"union": a.union(b).distinct(), "intersection": a.intersect(b), "left_only": a.subtract(b), "right_only": b.subtract(a)}
