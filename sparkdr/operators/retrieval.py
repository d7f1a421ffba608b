"""Top-k search over vectors, sparse terms, BM25 and hash codes.

Every search returns ``(qid, id, score, rank)`` with ranks from 1; scores fall, ties go by
id.  Exact search multiplies blocks of rows with the queries and keeps each partition's
best, so only ``k`` rows a query and partition are shuffled.  Queries travel to the rows only when
their size is checked; a larger query set is dealt into blocks of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors

#: Queries that travel to the rows at once (their vectors are broadcast).
QUERY_BLOCK = 2_000
#: Decimal digits of scores.
DIGITS = 9


def top_k(scored: DataFrame, k: int, query: str = "qid", item: str = "id", score: str = "score", group: str | None = None, ascending: bool = False) -> DataFrame:
    """The best ``k`` rows of each query (``k <= 0``: all), ranked; with ``group`` only the best of each group."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(item).asc()]
    if group is not None:
        best = Window.partitionBy(query, group).orderBy(*order)
        scored = scored.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked if k <= 0 else ranked.filter(F.col("rank") <= k)


def _metric(name: str) -> tuple[bool, bool, str]:
    """Normalise the vectors? distance? and the engine style of score."""
    known = {
        "ip": (False, False, "plain"), "cosine": (True, False, "plain"),
        "l2": (False, True, "inverse"), "dot_distance": (False, False, "plain"),
    }
    if name not in known:
        raise ValueError(f"metric {name!r}; known: {', '.join(known)}")
    return known[name]


def dense_top_k(
    rows: DataFrame, queries: DataFrame, k: int, metric: str = "ip", id_column: str = "id", query_column: str = "qid", vector: str = "vector",
    exclude_self: bool = False, match: tuple[str, str] | list[tuple[str, str]] | None = None, candidates=None,
    either: list[tuple[str, str]] | None = None, group: str | None = None,
) -> DataFrame:
    """Exact nearest rows of each query by inner product, cosine or L2 (score ``1 / (1 + distance)``).

    ``exclude_self`` leaves out equal ids; ``match`` is a pair (query column, row column), or
    several, that must be equal, ``either`` several of which one must be, applied before the
    ranking.  Rows or queries without a vector take no part.  ``candidates`` makes of the
    queries' vectors a function of row vectors that tells which rows (columns) each query
    (row) may have.  With ``group``, a row column, only the best row of each group counts:
    each batch of rows sends its ``k`` best groups of a query.
    """
    import pyarrow as pa

    match = [match] if isinstance(match, tuple) else list(match or ())
    either = list(either or ())
    id_type, q_type = dict(rows.dtypes)[id_column], dict(queries.dtypes)[query_column]
    schema = pa.schema([("qid", _arrow(q_type)), ("id", _arrow(id_type)), ("score", pa.float64())])

    def run(scored):
        best: list[list] | None = None  # (-score, id) of the partition's best rows, sorted
        prepared = None
        for x in scored:
            names, ids, score = x.names, x.ids, x.score
            if candidates is not None:
                prepared = prepared or candidates(x.q)
                score[~prepared(x.v)] = -np.inf
            if group:
                i, j = _group_best(score, ids, x.rows[group], k)
                yield pa.RecordBatch.from_pydict({"qid": [names[a] for a in i], "id": [ids[a] for a in j], "score": score[i, j]}, schema=schema)
                continue
            if k <= 0:
                i, j = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_pydict({"qid": [names[a] for a in i], "id": [ids[a] for a in j], "score": score[i, j]}, schema=schema)
                continue
            if best is None:
                best, least = [[] for _ in names], np.full(len(names), -np.inf)
            top = score.max(axis=1)
            for i in np.flatnonzero((top >= least) & np.isfinite(top)):
                s = score[i]
                bar = least[i] if len(s) <= k else max(least[i], np.partition(s, len(s) - k)[len(s) - k])
                new = [(-s[j], ids[j]) for j in np.flatnonzero((s >= bar) & np.isfinite(s))]
                best[i] = sorted(best[i] + new)[:k]
                if len(best[i]) == k:
                    least[i] = -best[i][-1][0]
        if best is not None:
            flat = [(names[i], x, -s) for i, found in enumerate(best) for s, x in found]
            yield pa.RecordBatch.from_pydict({"qid": [f[0] for f in flat], "id": [f[1] for f in flat], "score": [float(f[2]) for f in flat]}, schema=schema)

    fields = [b for _, b in match + either] + ([group] if group else [])
    out = _scored(rows, queries, run, f"qid {q_type}, id {id_type}, score double", metric, id_column, query_column, vector, exclude_self, match, either, fields)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"qid {q_type}, id {id_type}, score double, rank int")
    if group:
        out = out.join(rows.select(F.col(id_column).alias("id"), F.col(group).alias("_group")), "id")
        return top_k(out, k, group="_group").drop("_group")
    return top_k(out, k)


def _group_best(score: np.ndarray, ids: list, groups, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (query, row) of a matrix of scores: each query's best row of a group, ties by id, of its ``k`` best groups (``k <= 0``: all)."""
    code = pd.factorize(np.array(groups, object), use_na_sentinel=False)[0]
    order = np.array(sorted(range(len(ids)), key=lambda j: (code[j], ids[j])))
    ordered, code = score[:, order], code[order]
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    top = np.maximum.reduceat(ordered, starts, axis=1)
    column = np.where(ordered == top[:, np.cumsum(np.isin(np.arange(len(code)), starts)) - 1], np.arange(len(code)), len(code))
    first = np.minimum.reduceat(column, starts, axis=1)
    usable = np.isfinite(top)
    if 0 < k < top.shape[1]:  # all that tie with the k-th stay
        usable &= top >= np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k][:, None]
    i, g = np.nonzero(usable)
    return i, order[first[i, g]]


@dataclass
class Scored:
    """Scores of a batch of rows (columns) with a block of queries (rows); pairs left out are minus infinity."""

    score: np.ndarray
    names: list
    q: np.ndarray
    asked: dict[str, list]
    ids: list
    v: np.ndarray
    rows: dict[str, list]


def _scored(rows, queries, run, schema, metric, id_column, query_column, vector, exclude_self=False, match=(), either=(), row_fields=(), query_fields=()) -> DataFrame | None:
    """What ``run`` makes of the :class:`Scored` batches of each partition, over all blocks of queries; None without queries."""
    unit, distance, _ = _metric(metric)
    row_fields, query_fields = list(dict.fromkeys(row_fields)), list(dict.fromkeys([*query_fields, *[a for a, _ in [*match, *either]]]))
    wanted = queries.select(query_column, *query_fields, vector).filter(F.size(vector) > 0)
    data = rows.select(F.col(id_column), *row_fields, F.col(vector)).filter(F.size(vector) > 0)
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64(query_column), F.lit(blocks)) == block)
        # at most about QUERY_BLOCK rows: a stated query set, whose size was counted
        got = part.orderBy(query_column).collect()
        if not got:
            continue
        q = np.array([r[vector] for r in got], float)
        if unit:
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = rows.sparkSession.sparkContext.broadcast((q, [r[query_column] for r in got], {c: [r[c] for r in got] for c in query_fields}))

        def batches_of(batches, shared=shared):
            q, names, asked = shared.value
            own = np.array(names, object) if exclude_self else None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_pylist()
                held = {c: batch.column(1 + at).to_pylist() for at, c in enumerate(row_fields)}
                v = np.asarray(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
                if unit:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                score = q @ v.T
                if distance:
                    score = 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * score, 0)))
                # rounded, so that ties do not depend on the order of additions
                score = np.round(score, DIGITS)
                if own is not None:
                    score[own[:, None] == np.array(ids, object)[None]] = -np.inf

                def same(pair, held=held):
                    a = np.array(asked[pair[0]], object)[:, None]
                    return (a == np.array(held[pair[1]], object)[None]) & (a != None)  # noqa: E711

                for pair in match:
                    score[~same(pair)] = -np.inf
                if either:
                    score[~np.any([same(pair) for pair in either], axis=0)] = -np.inf
                yield Scored(score, names, q, asked, ids, v, held)

        found = data.mapInArrow(lambda batches, of=batches_of: run(of(batches)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def dense_sums(
    rows: DataFrame, queries: DataFrame, fold, names: list[str], metric: str = "ip", id_column: str = "id", query_column: str = "qid", vector: str = "vector",
    exclude_self: bool = False, row_fields: tuple[str, ...] = (), query_fields: tuple[str, ...] = (),
) -> DataFrame:
    """``(qid, names...)``: figures of each query over all rows, without any row a pair.

    ``fold`` makes of a :class:`Scored` batch an array a name, one value a query; there is one
    row for each query and batch, to be added up.
    """
    import pyarrow as pa

    q_type = dict(queries.dtypes)[query_column]

    def run(scored):
        for x in scored:
            yield pa.RecordBatch.from_arrays([pa.array(x.names, _arrow(q_type)), *(pa.array(np.asarray(c, float)) for c in fold(x))], ["qid", *names])

    schema = f"qid {q_type}, " + ", ".join(f"{n} double" for n in names)
    out = _scored(rows, queries, run, schema, metric, id_column, query_column, vector, exclude_self, row_fields=row_fields, query_fields=query_fields)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow(name: str):
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


#: Most query terms (of some tens of bytes) that travel to the postings.
QUERY_TERMS = 200_000


def sparse_top_k(postings: DataFrame, queries: DataFrame, k: int, must_match: tuple[str, str] | None = None, allowed=None) -> DataFrame:
    """Dot product of term weights: ``postings(id, term, weight)`` and ``queries(qid, term, weight)``.

    Where the queries' terms are few they are broadcast to postings that lie together by
    id, so scores add up where they are made, and frequent terms are no join keys; only the
    best ``k`` of each partition are shuffled.  ``allowed`` filters the scored pairs.
    """
    if queries.count() <= QUERY_TERMS:
        postings, queries = postings.repartition("id"), F.broadcast(queries)
    joined = queries.select("qid", "term", F.col("weight").alias("_qw"), *([must_match[0]] if must_match else [])).join(postings, "term")
    if must_match:
        joined = joined.filter(F.col(must_match[0]) == F.col(must_match[1]))
    scored = joined.groupBy("qid", "id").agg(F.sum(F.col("_qw").cast("double") * F.col("weight").cast("double")).alias("score"))
    # rounded, so that ties do not depend on the order of additions
    scored = scored.withColumn("score", F.round("score", DIGITS))
    return top_k(scored if allowed is None else allowed(scored), k)


def where_equal(rows: DataFrame, questions: DataFrame, match: list[tuple[str, str]], item: str = "id", either: list[tuple[str, str]] = ()):
    """A filter of scored pairs ``(qid, id)``: every pair (question column, row column) of ``match`` has equal values, and one of ``either``."""
    every = [*match, *either]
    asked = questions.select("qid", *[F.col(a).alias(f"_q{n}") for n, (a, _) in enumerate(every)])
    held = rows.select(F.col(item).alias("id"), *[F.col(b).alias(f"_d{n}") for n, (_, b) in enumerate(every)])

    def run(scored: DataFrame) -> DataFrame:
        joined = scored.join(asked, "qid").join(held, "id")
        same = [F.col(f"_q{n}") == F.col(f"_d{n}") for n in range(len(every))]
        for condition in same[: len(match)]:
            joined = joined.filter(condition)
        if either:
            joined = joined.filter(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), same[len(match) :]))
        return joined.select(scored.columns)

    return run


def bm25_statistics(texts: DataFrame, words, text: str = "text") -> DataFrame:
    """``(term, df, n_docs, avg_len)`` of a corpus: a table to save and to search other texts with."""
    terms = texts.select(words(F.col(text)).alias("words"))
    totals = F.broadcast(terms.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("words")).alias("avg_len")))  # one row
    return terms.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(totals)


def top_terms(weights: DataFrame, most: int, item: str = "id") -> DataFrame:
    """The ``most`` heaviest terms of each item; ties by term."""
    order = Window.partitionBy(item).orderBy(F.desc("weight"), "term")
    return weights.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def term_counts(texts: DataFrame, words: Column, item: str = "id") -> DataFrame:
    """``(item, term, tf)`` of an array-of-words column."""
    return texts.select(item, F.explode(words).alias("term")).groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_top_k(texts: DataFrame, questions: DataFrame, words, k: int, k1: float = 1.2, b: float = 0.75, floor_idf: bool = False, item: str = "id", text: str = "text", statistics: DataFrame | None = None, allowed=None) -> DataFrame:
    """BM25 of each question over all texts; ``words`` maps a text column to its terms.

    Only postings of question terms are kept, so the join moves what the questions touch.
    ``floor_idf`` uses the Okapi form with negative values floored at a quarter of the mean.
    ``statistics`` are those of :func:`bm25_statistics`, where not of these texts;
    ``allowed`` filters the scored pairs.
    """
    terms = texts.select(F.col(item).alias("id"), words(F.col(text)).alias("words"))
    if statistics is None:
        totals = terms.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("words")).alias("avg_len"))
    else:
        totals = statistics.select("n_docs", "avg_len").limit(1)
    totals = F.broadcast(totals)  # one row
    asked = questions.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    long = terms.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    if not floor_idf:  # other terms go before anything is shuffled, where the questions' terms fit a broadcast
        long = long.join(wanted, "term", "left_semi")
    counts = long.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    if statistics is None:  # tf is read, so that both uses of the counts share one shuffle
        df = counts.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df")).crossJoin(totals)
    else:
        df = statistics.select("term", "df", "n_docs", "avg_len")
    if floor_idf:  # the mean over all terms asks for all of them
        df = df.withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        df = df.crossJoin(F.broadcast(df.agg(F.avg("raw").alias("mean_idf"))))  # one row
        df = df.withColumn("idf", F.when(F.col("raw") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw")))
        counts = counts.join(wanted, "term", "left_semi")
    else:
        df = df.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    postings = counts.join(df.select("term", "idf", "avg_len"), "term").select("id", "term", weight.alias("weight"))
    return sparse_top_k(postings, asked.withColumn("weight", F.lit(1.0)), k, allowed=allowed)


def best_field(results: list[DataFrame], k: int) -> DataFrame:
    """Per query and item the best score over several fields' results."""
    every = results[0].select("qid", "id", "score")
    for one in results[1:]:
        every = every.unionByName(one.select("qid", "id", "score"))
    return top_k(every.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int, neurons: int, exclude_self: bool = False) -> DataFrame:
    """Least Hamming distance between codes, arrays ``active`` of positions out of ``neurons``; score: the distance."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(neurons - 1)), lambda i: F.array_contains("active", i).cast("double"))
    own = codes.select("id", spread.alias("vector"))
    asked = queries.select(F.col("id").alias("qid"), spread.alias("vector"))
    found = dense_top_k(own, asked, k, metric="l2", exclude_self=exclude_self)
    return found.withColumn("score", F.round(F.pow(1 / F.col("score") - 1, F.lit(2.0))).cast("int"))


def hash_top_k(
    rows: DataFrame, queries: DataFrame, model, k: int, recall: float = 0.9, sample: int = 500, exclude_self: bool = False,
) -> tuple[DataFrame, int]:
    """Largest inner products among the rows whose codes by ``model`` share enough positions with the query's.

    How many is measured: the most that leaves the share ``recall`` of the exact ``k`` best
    of ``sample`` queries (those of the smallest hashes) among the candidates.  Returns the
    hits and that number.
    """
    tested = queries.select("qid", "vector").orderBy(F.xxhash64("qid"), "qid").limit(sample)
    exact = dense_top_k(rows, tested, k, exclude_self=exclude_self).select("qid", "id")
    pairs = exact.join(tested.withColumnRenamed("vector", "own"), "qid").join(rows.select("id", "vector"), "id").select("own", "vector").collect()
    need = 0
    if pairs:
        a, b = (model.codes(np.array([r[c] for r in pairs], float)) for c in ("own", "vector"))
        shared = sorted((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)).tolist(), reverse=True)
        need = shared[int(np.ceil(recall * len(shared) - 1e-9)) - 1]

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(model.weights)), np.float32)
        out[np.arange(len(x))[:, None], model.codes(x)] = 1
        return out

    def near(q: np.ndarray):
        own = spread(q)
        return lambda v: own @ spread(v).T >= need - 0.5

    return dense_top_k(rows, queries, k, exclude_self=exclude_self, candidates=near), need


def agree_on(rows: DataFrame, vector: str, other: str) -> DataFrame:
    """Agreement of two vector columns of each row, and which row agrees least."""
    return rows.withColumn("agreement", vectors.agreement(F.col(vector), F.col(other)))


def mine_neighbours(rows: DataFrame, k: int, metric: str = "cosine", id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` nearest other rows of every row, in blocks of queries against all rows."""
    queries = rows.select(F.col(id_column).alias("qid"), vector)
    return dense_top_k(rows, queries, k, metric, id_column=id_column, vector=vector, exclude_self=True)
