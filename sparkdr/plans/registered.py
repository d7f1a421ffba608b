"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

Query sets of searches are all rows whose id is divisible by 20, against all rows.
Scores and means are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths, text as tx, vectors as vx
from ..operators import answers, biohash, calibration as cal, dedup, features, fusion, joins, losses, metrics, rerank, retrieval, statistics as st, tiler
from ..sources import writers
from ..sources.readers import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- dense retrieval ---------------------------------------------------------------------

SEARCHED = 20


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = rows.filter(F.col("id") % SEARCHED == 0).select(F.col("id").alias("qid"), "vector", F.col("label").alias("qlabel"))
    return rows, queries


def _search(spark, sf, k=10, metric="ip", size: int | None = None, **options) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    if size:
        rows, queries = (d.withColumn("vector", vx.prefix(F.col("vector"), size)) for d in (rows, queries))
    return retrieval.dense_top_k(rows, queries, k, metric=metric, exclude_self=True, **options)


def _sql_vectors(size: int | None = None) -> str:
    if not size:
        return "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
    return f"""v0 AS (SELECT vec_id AS id, list_slice(embedding::DOUBLE[], 1, {size}) AS vec, label FROM embeddings),
        v AS (SELECT id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec, label FROM v0)"""


_IP = "list_dot_product(q.vec, v.vec)"
_COSINE = "list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec))"
_L2 = "1 / (1 + sqrt(greatest(list_dot_product(q.vec, q.vec) + list_dot_product(v.vec, v.vec) - 2 * list_dot_product(q.vec, v.vec), 0)))"


def _sql_search(name: str, score: str = _IP, k: int = 10, size: int | None = None, where: str = "v.id <> q.id", vectors: bool = True) -> str:
    """CTEs that end in ``name(qid, id, score, rank, label, qlabel)``."""
    own = f"{_sql_vectors(size)}," if vectors else ""
    return f"""{own}
        {name}_s AS (SELECT q.id AS qid, v.id, v.label, q.label AS qlabel, round({score}, 9) AS score FROM v q, v WHERE q.id % {SEARCHED} = 0 AND {where}),
        {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_HITS = "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM h"


@query("dense_ip_top10", f"WITH {_sql_search('h')} {_HITS}")
def dense_ip_top10(spark, sf):
    return _hits(_search(spark, sf))


@query("dense_cosine_top10", f"WITH {_sql_search('h', _COSINE)} {_HITS}")
def dense_cosine_top10(spark, sf):
    return _hits(_search(spark, sf, metric="cosine"))


@query("dense_l2_top10", f"WITH {_sql_search('h', _L2)} {_HITS}")
def dense_l2_top10(spark, sf):
    return _hits(_search(spark, sf, metric="l2"))


@query("dense_same_label_filter", f"WITH {_sql_search('h', where='v.id <> q.id AND v.label = q.label')} {_HITS}")
def dense_same_label_filter(spark, sf):
    return _hits(_search(spark, sf, match=("qlabel", "label")))


@query(
    "dense_group_best",
    f"WITH {_sql_search('h', k=100000000)}, g AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS n FROM h), "
    "r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM g WHERE n = 1) "
    "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5",
)
def dense_group_best(spark, sf):
    return _hits(_search(spark, sf, k=5, group="label"))


@query("dense_either_filter", f"WITH {_sql_search('h', where='v.id <> q.id AND (v.label = q.label OR v.id % 7 = q.id % 7)')} {_HITS}")
def dense_either_filter(spark, sf):
    """Two filters of which a row must meet one."""
    rows, queries = _vectors(spark, sf)
    rows, queries = rows.withColumn("residue", F.col("id") % 7), queries.withColumn("qresidue", F.col("qid") % 7)
    return _hits(retrieval.dense_top_k(rows, queries, 10, exclude_self=True, either=[("qlabel", "label"), ("qresidue", "residue")]))


@query("dense_prefix32_top10", f"WITH {_sql_search('h', size=32)} {_HITS}")
def dense_prefix32_top10(spark, sf):
    return _hits(_search(spark, sf, size=32))


def _label_judgements(spark, sf) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return queries.join(rows, F.col("label") == F.col("qlabel")).filter("id <> qid").select("qid", F.col("id").alias("doc_id"))


_JUDGED = f"g AS (SELECT q.id AS qid, v.id AS doc_id FROM v q, v WHERE q.id % {SEARCHED} = 0 AND q.label = v.label AND q.id <> v.id), n AS (SELECT qid, count(*) AS num_gold FROM g GROUP BY qid)"


def _sql_per_query(hits: str, out: str, ranks=(1, 3, 5, 10)) -> str:
    return f"""{out}_rel AS (SELECT h.qid, h.rank, h.label = h.qlabel AS rel, sum((h.label = h.qlabel)::INT) OVER (PARTITION BY h.qid ORDER BY h.rank) AS hit_no FROM {hits} h),
        {out}_cut AS (SELECT n.qid, n.num_gold, k.k, r.rank, r.rel AND r.rank <= k.k AS inside, r.hit_no
                FROM n CROSS JOIN (SELECT unnest([{', '.join(map(str, ranks))}]) AS k) k LEFT JOIN {out}_rel r USING (qid)),
        {out} AS (SELECT qid, k, coalesce(max(inside::INT), 0) AS match, coalesce(1.0 / min(CASE WHEN inside THEN rank END), 0) AS mrr,
                coalesce(sum(CASE WHEN inside THEN 1 / log2(rank + 1) ELSE 0 END), 0) / list_sum(list_transform(range(1, least(k, num_gold)::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
                coalesce(sum(CASE WHEN inside THEN hit_no / rank ELSE 0 END), 0) / least(k, num_gold) AS ap,
                coalesce(sum(inside::INT), 0) / k AS precision, coalesce(sum(inside::INT), 0) / num_gold AS recall
            FROM {out}_cut GROUP BY qid, num_gold, k)"""


_MEANS = "round(avg(match), 6) AS match, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall"


@query("retrieval_metrics", f"WITH {_sql_search('h')}, {_JUDGED}, {_sql_per_query('h', 'm')} SELECT k, count(*) AS n_queries, {_MEANS} FROM m GROUP BY k")
def retrieval_metrics(spark, sf):
    hits = _search(spark, sf).withColumnRenamed("id", "doc_id")
    out = metrics.evaluate(hits, _label_judgements(spark, sf))
    return out.select("k", "n_queries", *[F.round(c, 6).alias(c) for c in ("match", "mrr", "ndcg", "map", "precision", "recall")])


@query("metrics_per_query", f"WITH {_sql_search('h')}, {_JUDGED}, {_sql_per_query('h', 'm')} SELECT qid, k, match, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM m")
def metrics_per_query(spark, sf):
    hits = _search(spark, sf).withColumnRenamed("id", "doc_id")
    out = metrics.per_query(hits, _label_judgements(spark, sf))
    return out.select("qid", "k", "match", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "ap")])


@query("gold_ranks", f"WITH {_sql_search('h')} SELECT qid, (rank - 1)::INT AS rank0 FROM h WHERE label = qlabel")
def gold_ranks(spark, sf):
    hits = _search(spark, sf).withColumnRenamed("id", "doc_id")
    return metrics.gold_ranks(hits, _label_judgements(spark, sf)).select("qid", F.col("rank0").cast("int").alias("rank0"))


@query(
    "label_map",
    f"WITH {_sql_search('h')}, r AS (SELECT qid, rank, label = qlabel AS rel, sum((label = qlabel)::INT) OVER (PARTITION BY qid ORDER BY rank) AS c FROM h) SELECT qid, round(100 * avg(c / rank), 6) AS ap FROM r WHERE rel GROUP BY qid",
)
def label_map(spark, sf):
    rows, queries = _vectors(spark, sf)
    hits = _search(spark, sf).join(rows.select("id", "label"), "id").join(queries.select("qid", "qlabel"), "qid")
    return metrics.label_map(hits.withColumn("relevant", F.col("label") == F.col("qlabel"))).select("qid", F.round("ap", 6).alias("ap"))


_TWO = f"{_sql_search('h')}, w AS (SELECT id, label, list_transform(list_slice(vec, 1, 32), lambda x: x / sqrt(list_dot_product(list_slice(vec, 1, 32), list_slice(vec, 1, 32)))) AS vec FROM v), {_sql_search('p', vectors=False).replace('FROM v q, v ', 'FROM w q, w v ')}"


@query(
    "first_rank_comparison",
    f"WITH {_TWO}, a AS (SELECT qid, min(rank - 1) AS x FROM h WHERE label = qlabel GROUP BY qid), b AS (SELECT qid, min(rank - 1) AS y FROM p WHERE label = qlabel GROUP BY qid) "
    "SELECT qid, coalesce(x, 100)::INT AS first_a, coalesce(y, 100)::INT AS first_b, (coalesce(x, 100) - coalesce(y, 100))::INT AS difference FROM a FULL JOIN b USING (qid)",
)
def first_rank_comparison(spark, sf):
    gold = _label_judgements(spark, sf)
    a, b = (metrics.gold_ranks(_search(spark, sf, size=s).withColumnRenamed("id", "doc_id"), gold) for s in (None, 32))
    out = metrics.first_rank_comparison(a, b)
    return out.select("qid", *[F.col(c).cast("int").alias(c) for c in ("first_a", "first_b", "difference")])


@query(
    "jaccard_at_10",
    f"WITH {_TWO}, a AS (SELECT qid, list(id) AS x FROM h GROUP BY qid), b AS (SELECT qid, list(id) AS y FROM p GROUP BY qid) SELECT qid, round(100.0 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a JOIN b USING (qid)",
)
def jaccard_at_10(spark, sf):
    return metrics.jaccard_at_k(_search(spark, sf), _search(spark, sf, size=32), 10).select("qid", F.round("jaccard", 6).alias("jaccard"))


_FUSED = "SELECT qid, id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 10"


def _fused(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


def _ranked_again(df: DataFrame, k: int = 10) -> DataFrame:
    return retrieval.top_k(df.withColumn("score", F.round("score", 9)).drop("rank"), k)


@query("fusion_rrf", f"WITH {_TWO}, u AS (SELECT qid, id, rank FROM h UNION ALL SELECT qid, id, rank FROM p), f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY qid, id) {_FUSED}")
def fusion_rrf(spark, sf):
    return _fused(_ranked_again(fusion.reciprocal_rank([_search(spark, sf), _search(spark, sf, size=32)], 0)))


@query(
    "fusion_weighted",
    f"WITH {_TWO}, u AS (SELECT qid, id, 0.7 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM h WINDOW w AS (PARTITION BY qid) "
    f"UNION ALL SELECT qid, id, 0.3 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM p WINDOW w AS (PARTITION BY qid)), f AS (SELECT qid, id, sum(s) AS score FROM u GROUP BY qid, id) {_FUSED}",
)
def fusion_weighted(spark, sf):
    return _fused(_ranked_again(fusion.weighted([_search(spark, sf), _search(spark, sf, size=32)], 0, [7.0, 3.0])))


def _rerankable(spark, sf) -> DataFrame:
    """IP hits with the cosine of their 32-dimension prefixes as similarity."""
    rows, queries = _vectors(spark, sf)
    hits = _search(spark, sf).join(rows.select("id", F.col("vector").alias("v")), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    return hits.withColumn("sim", F.round(vx.dot(vx.prefix(F.col("q"), 32), vx.prefix(F.col("v"), 32)), 9))


_SIM = "round(list_dot_product(list_slice(a.vec, 1, 32), list_slice(b.vec, 1, 32)) / sqrt(list_dot_product(list_slice(a.vec, 1, 32), list_slice(a.vec, 1, 32)) * list_dot_product(list_slice(b.vec, 1, 32), list_slice(b.vec, 1, 32))), 9)"
_RERANK = f"WITH {_sql_search('h')}, s AS (SELECT h.*, {_SIM} AS sim FROM h JOIN v a ON a.id = h.qid JOIN v b ON b.id = h.id)"


@query("rerank_weighted_head", f"{_RERANK}, c AS (SELECT *, CASE WHEN rank <= 5 THEN 0.6 * sim + 0.4 * score END AS combined FROM s) SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY rank <= 5 DESC, round(combined, 9) DESC NULLS LAST, rank))::INT AS new_rank FROM c")
def rerank_weighted_head(spark, sf):
    out = rerank.rerank(_rerankable(spark, sf), F.col("sim"), head=5, method="weight", weight=0.6)
    return out.select("qid", "id", F.col("new_rank").cast("int").alias("new_rank"))


@query(
    "rerank_rrf",
    f"{_RERANK}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS i, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS j, count(*) OVER (PARTITION BY qid) AS n FROM s) "
    "SELECT qid, id, round(1.0 / (n + i) + 1.0 / (n + j), 9) AS combined, (row_number() OVER (PARTITION BY qid ORDER BY 1.0 / (n + i) + 1.0 / (n + j) DESC, rank))::INT AS new_rank FROM r",
)
def rerank_rrf(spark, sf):
    out = rerank.rerank(_rerankable(spark, sf), F.col("sim"), method="rrf")
    return out.select("qid", "id", F.round("combined", 9).alias("combined"), F.col("new_rank").cast("int").alias("new_rank"))


@query("dedup_first_per_label", f"WITH {_sql_search('h', k=50)}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h) SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INT AS rank FROM d WHERE n = 1")
def dedup_first_per_label(spark, sf):
    hits = _search(spark, sf, k=50).join(_vectors(spark, sf)[0].select("id", "label"), "id")
    return dedup.dense_rank_again(dedup.keep_first(hits, "label")).select("qid", "id", "rank")


@query("best_score_per_document", f"WITH {_sql_search('h', k=50)} SELECT qid, label::BIGINT AS doc_id, round(max(score), 6) AS score FROM h GROUP BY qid, label")
def best_score_per_document(spark, sf):
    hits = _search(spark, sf, k=50).join(_vectors(spark, sf)[0].select("id", F.col("label").cast("long").alias("doc_id")), "id")
    return dedup.best_per_document(hits).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(
    "paired_randomization",
    f"WITH {_TWO}, {_JUDGED}, {_sql_per_query('h', 'm', (10,))}, {_sql_per_query('p', 'o', (10,))}, d AS (SELECT qid, round(o.ndcg - m.ndcg, 9) AS d FROM m JOIN o USING (qid)), t AS (SELECT sum(d) AS total, count(*) AS n, avg(d) AS difference FROM d), "
    "s AS (SELECT trial, sum(CASE WHEN ('0x' || substr(md5('42|' || qid || '|' || trial), 1, 1))::INT % 2 = 1 THEN -d ELSE d END) AS s FROM d, range(200) r(trial) GROUP BY trial) "
    "SELECT n, round(difference, 6) AS difference, round((sum((abs(s) >= abs(total) - 1e-12)::INT) + 1) / 201, 9) AS p_value FROM s, t GROUP BY n, difference",
)
def paired_randomization(spark, sf):
    gold = _label_judgements(spark, sf)
    a, b = (metrics.per_query(_search(spark, sf, size=s).withColumnRenamed("id", "doc_id"), gold, (10,)).select("qid", F.col("ndcg").alias(n)) for s, n in ((None, "baseline"), (32, "result")))
    pairs = a.join(b, "qid").select("qid", F.lit(0.0).alias("baseline"), F.round(F.col("result") - F.col("baseline"), 9).alias("result"))
    out = st.paired_randomization(pairs, trials=200)
    return out.select("n", F.round("difference", 6).alias("difference"), F.round("p_value", 9).alias("p_value"))


# --- vectors -----------------------------------------------------------------------------


@query("vector_norm_statistics", "WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings) SELECT round(min(x), 6) AS min_norm, round(max(x), 6) AS max_norm, round(avg(x), 6) AS avg_norm, round(stddev_pop(x), 6) AS std_norm, count(*) AS n FROM n")
def vector_norm_statistics(spark, sf):
    _, stats = writers.embedding_export(table(spark, sf, "embeddings"), "embedding")
    return stats.select(*[F.round(c, 6).alias(c) for c in ("min_norm", "max_norm", "avg_norm", "std_norm")], "n")


@query("vector_variance_order", "WITH c AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT dim, var_samp(x) AS variance FROM c GROUP BY dim) SELECT dim::INT AS dim, round(variance, 9) AS variance, (row_number() OVER (ORDER BY round(variance, 12) DESC, dim) - 1)::INT AS place FROM v")
def vector_variance_order(spark, sf):
    out = vx.variance_order(table(spark, sf, "embeddings"), "embedding")
    return out.select("dim", F.round("variance", 9).alias("variance"), F.col("place").cast("int").alias("place"))


@query("vector_prefix_agreement", "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_concat(list_slice(embedding::DOUBLE[], 1, 32), list_transform(range(32), lambda i: 0.0)) AS y FROM embeddings) SELECT vec_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 6) AS cosine, round(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) / 64, 9) AS mse, round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / 64, 9) AS mae FROM a")
def vector_prefix_agreement(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("cut", F.concat(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 32)))
    out = retrieval.agree_on(rows, "embedding", "cut")
    return out.select("vec_id", F.round("agreement.cosine", 6).alias("cosine"), F.round("agreement.mse", 9).alias("mse"), F.round("agreement.mae", 9).alias("mae"))


@query("vector_anisotropy", "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings), c AS (SELECT unnest(range(len(x))) AS dim, unnest(x) AS x FROM v), s AS (SELECT dim, sum(x) AS s FROM c GROUP BY dim) SELECT n, round((q - n) / (n * (n - 1)), 6) AS mean_cosine FROM (SELECT sum(s * s) AS q FROM s), (SELECT count(*) AS n FROM embeddings)")
def vector_anisotropy(spark, sf):
    return vx.anisotropy(table(spark, sf, "embeddings"), "embedding").select("n", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("vector_quantized", "WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, trunc(100.0 * unnest(embedding)::DOUBLE)::INT AS weight FROM embeddings) SELECT vec_id, sum(weight)::BIGINT AS total, count(*) FILTER (weight > 0) AS positive FROM c GROUP BY vec_id")
def vector_quantized(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    rows = rows.withColumn("weight", vx.quantized(F.col("x").cast("double"), 100.0))
    return rows.groupBy("vec_id").agg(F.sum("weight").alias("total"), F.count(F.when(F.col("weight") > 0, 1)).alias("positive"))


@query(
    "class_separation",
    f"WITH {_sql_vectors()}, p AS (SELECT q.label = v.label AS same, sqrt(greatest(2 - 2 * list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec)), 0)) AS d FROM v q, v WHERE q.id % {SEARCHED} = 0 AND q.id <> v.id) SELECT round(avg(d) FILTER (NOT same) / avg(d) FILTER (same), 6) AS separation FROM p",
)
def class_separation(spark, sf):
    rows, queries = _vectors(spark, sf)
    return metrics.class_separation(rows, queries, ("qlabel", "label")).select(F.round("separation", 6).alias("separation"))


@query("prefix_quality", f"WITH {_TWO.replace('WHERE rank <= 10', 'WHERE rank <= 1000000000')} SELECT round(avg(abs(h.score - p.score)), 6) AS mean_difference, count(*) AS n FROM h JOIN p USING (qid, id)")
def prefix_quality(spark, sf):
    out = losses.prefix_difference(losses.prefix_sums(*_vectors(spark, sf), 32))
    return out.select(F.round("mean_difference", 6).alias("mean_difference"), "n")


@query("hash_search_top10")
def hash_search_top10(spark, sf):
    """The candidates are as many as a measured recall of 0.9 takes."""
    rows, queries = _vectors(spark, sf)
    found, _ = retrieval.hash_top_k(rows, queries, biohash.fit(rows, "vector", "id"), 10, exclude_self=True)
    return found.select("qid", "id", "score", F.col("rank").cast("int").alias("rank"))


@query("hash_near_links")
def hash_near_links(spark, sf):
    """Class and number of near codes of every vector; the index is fitted with its default parameters."""
    rows = table(spark, sf, "embeddings")
    model = biohash.fit(rows, "embedding", "vec_id")
    return biohash.near_code_classes(biohash.encode(rows, model, "embedding", "vec_id"), 4)


# --- text and statistics -----------------------------------------------------------------

_TOKENS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


def _ascii_tokens(column):
    """Runs of a-z and digits after lower-casing A-Z only, alike in any engine."""
    import string

    lowered = F.translate(F.coalesce(column, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), F.lit(1))


_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS_EN)


@query("text_lengths", f"SELECT doc_id, length(text) AS chars, len({_TOKENS.format('text')}) AS tokens FROM documents")
def text_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.size(_ascii_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("text_stop_words", f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS w FROM documents) SELECT doc_id, count(*) AS kept FROM t WHERE w NOT IN ({_STOPS}) GROUP BY doc_id")
def text_stop_words(spark, sf):
    words = spread(table(spark, sf, "documents")).select("doc_id", F.explode(_ascii_tokens(F.col("text"))).alias("w"))
    return words.filter(~F.col("w").isin(*tx.STOP_WORDS_EN)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("text_token_frequencies", f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def text_token_frequencies(spark, sf):
    return st.token_frequencies(spread(table(spark, sf, "documents")), _ascii_tokens(F.col("text")))


@query(
    "text_vocabulary",
    f"WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token) SELECT token, n, (row_number() OVER (ORDER BY token IN ('and', 'der') DESC, n DESC, token) - 1)::INT AS new_id FROM f ORDER BY new_id LIMIT 1000",
)
def text_vocabulary(spark, sf):
    chosen = st.select_vocabulary(st.token_frequencies(spread(table(spark, sf, "documents")), _ascii_tokens(F.col("text"))), 1000, ["and", "der"])
    return chosen.select("token", "n", F.col("new_id").cast("int").alias("new_id"))


@query(
    "text_interpolated_frequencies",
    f"WITH f AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_TOKENS.format('text')}) AS token FROM documents WHERE lang IN ('en', 'fr')) GROUP BY lang, token), t AS (SELECT lang, sum(n) AS total FROM f GROUP BY lang) SELECT token, round(sum((CASE WHEN lang = 'en' THEN 0.7 ELSE 0.3 END) * n / total), 12) AS p FROM f JOIN t USING (lang) GROUP BY token",
)
def text_interpolated_frequencies(spark, sf):
    docs = table(spark, sf, "documents")
    parts = [(st.token_frequencies(docs.filter(F.col("lang") == lang), _ascii_tokens(F.col("text"))), w) for lang, w in (("en", 0.7), ("fr", 0.3))]
    return st.interpolate(parts).select("token", F.round("p", 12).alias("p"))


@query(
    "text_vocabulary_coverage",
    f"WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token), v AS (SELECT token FROM f ORDER BY n DESC, token LIMIT 500) SELECT round(100.0 * sum(CASE WHEN token IN (SELECT token FROM v) THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM f",
)
def text_vocabulary_coverage(spark, sf):
    counts = st.token_frequencies(table(spark, sf, "documents"), _ascii_tokens(F.col("text")))
    return st.coverage(counts, st.select_vocabulary(counts, 500)).select(F.round("coverage", 6).alias("coverage"))


@query("text_truncation_rate", f"SELECT round(100.0 * avg((len({_TOKENS.format('text')}) > 512)::INT), 6) AS rate FROM documents")
def text_truncation_rate(spark, sf):
    return st.truncation_rate(table(spark, sf, "documents"), _ascii_tokens(F.col("text")), 512).select(F.round("rate", 6).alias("rate"))


@query(
    "text_corpus_statistics",
    f"WITH t AS (SELECT doc_id, length(text) AS c, len({_TOKENS.format('text')}) AS k FROM documents) SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_tiles, round(count(*) / count(DISTINCT doc_id), 6) AS tiles_per_doc, min(c)::BIGINT AS min_chars, max(c)::BIGINT AS max_chars, round(avg(c), 6) AS avg_chars, min(k)::BIGINT AS min_tokens, max(k)::BIGINT AS max_tokens, round(avg(k), 6) AS avg_tokens FROM t",
)
def text_corpus_statistics(spark, sf):
    out = st.corpus_statistics(table(spark, sf, "documents"), _ascii_tokens(F.col("text")))
    whole = [F.col(c).cast("long").alias(c) for c in ("n_docs", "n_tiles", "min_chars", "max_chars", "min_tokens", "max_tokens")]
    return out.select(*whole, *[F.round(c, 6).alias(c) for c in ("tiles_per_doc", "avg_chars", "avg_tokens")])


@query("text_token_windows", f"WITH t AS (SELECT doc_id, len({_TOKENS.format('text')}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(0, n - 11) + 1, 54)) AS first FROM t WHERE n > 0) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS part, least(64, n - first)::BIGINT AS size FROM w")
def text_token_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _ascii_tokens(F.col("text")).alias("words"))
    return tiler.token_windows(docs, "words", 64, 10).select("doc_id", F.col("window").alias("part"), F.size("tokens").cast("long").alias("size"))


@query("text_char_windows", "WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(0, length(text) - 31) + 1, 170)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS part, start::INT AS start, md5(substring(text, start::INT + 1, 200)) AS digest FROM w")
def text_char_windows(spark, sf):
    out = tiler.char_windows(table(spark, sf, "documents").select("doc_id", "text"), "text", 200, 30)
    return out.select("doc_id", F.col("window").alias("part"), "start", F.md5(F.encode("piece", "UTF-8")).alias("digest"))


@query("text_trimmed", "SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || ' [...]' ELSE text END) AS digest FROM documents")
def text_trimmed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.trim_chars(F.col("text"), 100, " [...]")).alias("digest"))


@query("text_trimmed_fields", "SELECT doc_id, md5(substring(text, 1, 50)) AS digest, substring(source, 1, 3) AS source, substring(lang, 1, 1) AS lang FROM documents")
def text_trimmed_fields(spark, sf):
    """Every string of a nested record is cut, wherever it lies."""
    docs = table(spark, sf, "documents").withColumn("record", F.struct("text", F.array(F.struct("source")).alias("parts"), F.create_map(F.lit("lang"), F.col("lang")).alias("more")))
    kind, at = docs.schema["record"].dataType, F.col("r")
    docs = docs.select("doc_id", tx.trim_strings(F.col("record"), kind, 50).alias("r"), tx.trim_strings(F.col("record"), kind, 3).alias("s"), tx.trim_strings(F.col("record"), kind, 1).alias("t"))
    return docs.select("doc_id", F.md5(at["text"]).alias("digest"), F.col("s")["parts"][0]["source"].alias("source"), F.col("t")["more"]["lang"].alias("lang"))


@query("text_masked_urls", "SELECT page_id, md5(regexp_replace(html, 'https?://[^ \\t\\n\\r\\f\\v<>\"'']+', 'URL', 'g')) AS digest FROM pages")
def text_masked_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.mask_urls(F.col("html"))).alias("digest"))


@query("text_normalized_urls", "SELECT page_id, regexp_replace(url || '/docs/en/app/2.5.0?topic=' || page_id, '(://[^/]+/docs/[^?]+?)/[0-9]+([.][0-9]+)*([?]|$)', '\\1/latest\\3') AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS url FROM pages))")
def text_normalized_urls(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    url = F.concat(host, F.lit("/docs/en/app/2.5.0?topic="), F.col("page_id").cast("string"), F.lit("#part"))
    return table(spark, sf, "pages").select("page_id", tx.normalize_doc_url(url).alias("url"))


@query("text_original_ids", "SELECT doc_id, source || '-' || doc_id AS original FROM documents")
def text_original_ids(spark, sf):
    tile_id = F.concat_ws("-", "source", F.col("doc_id").cast("string"), F.lit("0"), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").select("doc_id", tx.original_id(tile_id).alias("original"))


@query("text_with_titles", "SELECT page_id, md5(CASE WHEN strpos(html, substr(html, 1, 9)) BETWEEN 1 AND 3 AND page_id % 2 = 0 THEN html ELSE url || chr(10) || html END) AS digest FROM pages")
def text_with_titles(spark, sf):
    title = F.when(F.col("page_id") % 2 == 0, F.expr("left(html, 9)")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.md5(tx.with_title(F.col("html"), title)).alias("digest"))


@query("text_identifiers", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM pages")
def text_identifiers(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.identifier(F.col("url")).alias("name"))


def _sql_detokenized(text: str) -> str:
    steps = (
        (" ([.,:;!?)])", r"\1"), (r"\( ", "("), (" - ", "-"), (" ('s|n't)", r"\1"), (" ' ", "' "), ("`` (.*?) ''", r'"\1"'),
        (r"([0-9]+)\s+:\s+([0-9]+)\s+:\s+([0-9]+)", r"\1:\2:\3"), (" +", " "),
    )
    for pattern, new in steps:
        pattern, new = pattern.replace("'", "''"), new.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10))"


_SPACED = r"regexp_replace(text, '([.,;])', ' \1', 'g')"


@query("text_detokenized", f"SELECT doc_id, md5({_sql_detokenized(_SPACED)}) AS digest FROM documents")
def text_detokenized(spark, sf):
    spaced = F.regexp_replace("text", "([.,;])", " $1")
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.detokenize(spaced)).alias("digest"))


_ANALYZED = r"list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[''’]s\b', '', 'g'), '[\p{L}\p{N}]+'), lambda w: w NOT IN (" + _STOPS + "))"
_STEM = "CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[^aeious]s$') THEN regexp_replace(w, 's$', '') ELSE w END"


@query("text_analyzed", f"SELECT doc_id, len({_ANALYZED})::INT AS n_terms, md5(array_to_string(list_transform({_ANALYZED}, lambda w: {_STEM}), ' ')) AS digest FROM documents")
def text_analyzed(spark, sf):
    terms = spread(table(spark, sf, "documents")).select("doc_id", tx.analyze(F.col("text"), "text_stop").alias("terms"))
    return terms.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("digest"))


@query("nested_passages", "SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS doc_id, md5(text) AS digest FROM conversations")
def nested_passages(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("passages"))
    return tiler.nested_passages(own, "passages", "conv_id", "text", "turn").select("id", "doc_id", F.md5("text").alias("digest"))


@query("tiles")
def tiles(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "text")
    out = tiler.tile(docs, most=256, stride=32)
    return out.select("id", "doc_id", "start", "end", "tlen")


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", paths.json_first_present(F.col("props"), "missing|k").alias("k"))


@query("profile_by_language", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY lang")
def profile_by_language(spark, sf):
    out = st.profile(table(spark, sf, "documents"), "n_chars", ("lang",))
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "p05", "median", "p95")])


_SPAN = "WITH s AS (SELECT min(value) AS low, max(value) AS high, count(value) AS total FROM events)"


@query("histogram_right_closed", f"{_SPAN} SELECT greatest(1, least(ceil((value - low) / ((high - low) / 10)), 10))::INT AS bin, count(*) AS n FROM events, s GROUP BY 1")
def histogram_right_closed(spark, sf):
    return st.right_closed_histogram(table(spark, sf, "events"), "value")


@query("histogram_left_closed", f"{_SPAN} SELECT least(floor((value - low) / ((high - low) / 10)) + 1, 10)::INT AS bin, count(*) AS n, round(100.0 * count(*) / max(total), 6) AS percent FROM events, s GROUP BY 1")
def histogram_left_closed(spark, sf):
    return st.left_closed_histogram(table(spark, sf, "events"), "value").select("bin", "n", F.round("percent", 6).alias("percent"))


_CUTS = (0.0, 1.0, 5.0, 20.0, 50.0, 100.0)


@query("histogram_edges", f"SELECT least(len(list_filter({list(_CUTS)}, lambda e: e <= value)), {len(_CUTS) - 1})::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN {_CUTS[0]} AND {_CUTS[-1]} GROUP BY 1")
def histogram_edges(spark, sf):
    return st.edged_histogram(table(spark, sf, "events"), "value", list(_CUTS))


@query("source_counters", "SELECT source, lang, count(*) AS count FROM documents GROUP BY source, lang")
def source_counters(spark, sf):
    return st.counters(table(spark, sf, "documents"), "source", "lang")


@query("stage_times", "WITH o AS (SELECT event_type || '::u' || user_id % 5 AS name, sum(value) AS t FROM events GROUP BY 1), a AS (SELECT split_part(name, '::', 1) AS name, sum(t) AS t FROM o GROUP BY 1), b AS (SELECT name, t, '' AS parent FROM a UNION ALL SELECT name, t, split_part(name, '::', 1) FROM o) SELECT b.name, round(greatest(b.t, 0.01), 6) AS total_ms, round(100 * greatest(b.t, 0.01) / CASE WHEN a.t IS NULL THEN greatest(b.t, 0.01) ELSE greatest(a.t, 0.01) END, 6) AS percent FROM b LEFT JOIN a ON a.name = b.parent")
def stage_times(spark, sf):
    samples = table(spark, sf, "events").select(F.concat(F.col("event_type"), F.lit("::u"), (F.col("user_id") % 5).cast("string")).alias("name"), F.col("value").alias("ms"))
    return st.stage_times(samples).select("name", F.round("total_ms", 6).alias("total_ms"), F.round("percent", 6).alias("percent"))


@query("throughput", "WITH b AS (SELECT event_type, 10 AS items, value AS a, value * 3 AS e FROM events) SELECT round(sum(a + e), 4) AS total_ms, round(avg(a + e), 6) AS mean_ms, round(stddev_pop(a + e), 6) AS std_ms, round(1000 * sum(items) / sum(a + e), 6) AS items_per_s, round(sum(a + e) / sum(items), 6) AS ms_per_item, round(100 * sum(a) / sum(a + e), 6) AS tokenize_percent FROM b")
def throughput(spark, sf):
    batches = table(spark, sf, "events").select(F.lit(10).alias("items"), F.col("value").alias("tokenize_ms"), (F.col("value") * 3).alias("encode_ms"))
    out = st.throughput(batches)
    return out.select(F.round("total_ms", 4).alias("total_ms"), *[F.round(c, 6).alias(c) for c in out.columns if c != "total_ms"])


@query("leaderboard", "WITH m AS (SELECT 'u' || user_id % 7 AS model, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'error' THEN value ELSE -value END, model) AS n FROM m) SELECT metric, model AS best_model, value FROM r WHERE n = 1")
def leaderboard(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("model"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    kinds = {"error": True, "click": False, "purchase": False, "signup": False, "view": False}
    return st.leaderboard(rows, kinds)


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("metric_table", "SELECT user_id % 7 AS model, " + ", ".join(f"round(avg(value) FILTER (event_type = '{e}'), 6) AS {e}" for e in _EVENTS) + " FROM events GROUP BY 1")
def metric_table(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 7).alias("model"), F.col("event_type").alias("metric"), "value")
    return st.metric_table(rows, _EVENTS).select("model", *[F.round(c, 6).alias(c) for c in _EVENTS])


# --- calibration -------------------------------------------------------------------------

_SCORES = "s AS (SELECT d.doc_id, n_chars / (n_chars + 2000.0) AS p, quality AS y FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL)"
_EDGES = "[" + ", ".join(repr(e) for e in cal.edges(10)[1:-1]) + "]"
_LOWER = "[" + ", ".join(repr(e) for e in cal.edges(15)[:-1]) + "]"
_BINS = f"{_SCORES}, b AS (SELECT len(list_filter({_EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM s GROUP BY 1)"


def _scores(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).filter("y is not null")
    return cal.validated(docs.join(labels, "doc_id"))


@query("calibration_errors", f"WITH {_BINS} SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, round(max(abs(mean_p - mean_y)), 6) AS mce FROM b")
def calibration_errors(spark, sf):
    return cal.calibration_errors(cal.bin_table(_scores(spark, sf))).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("calibration_curve", f"WITH {_BINS} SELECT bin::INT AS bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM b")
def calibration_curve(spark, sf):
    return cal.bin_table(_scores(spark, sf)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(
    "calibration_quantile_errors",
    f"WITH {_SCORES}, c AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS cuts FROM s), b AS (SELECT len(list_filter(list_slice(cuts, 2, len(cuts) - 1), lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM s, c GROUP BY 1) SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, round(max(abs(mean_p - mean_y)), 6) AS mce FROM b",
)
def calibration_quantile_errors(spark, sf):
    return cal.calibration_errors(cal.quantile_bin_table(_scores(spark, sf))).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("calibration_class_wise", f"WITH {_SCORES}, c AS (SELECT 0 AS c, 1 - p AS p, (y = 0)::INT AS y FROM s UNION ALL SELECT 1, p, y FROM s), b AS (SELECT c, len(list_filter({_EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM c GROUP BY 1, 2), e AS (SELECT c, sum(n * gap) / sum(n) AS ece FROM b GROUP BY c) SELECT round(avg(ece), 6) AS ece FROM e")
def calibration_class_wise(spark, sf):
    rows = _scores(spark, sf).select(F.array(1 - F.col("p"), F.col("p")).alias("probs"), F.col("y").alias("label"))
    return cal.class_wise_ece(rows).select(F.round("ece", 6).alias("ece"))


@query("reliability_diagram", f"WITH {_SCORES}, b AS (SELECT len(list_filter({_LOWER}, lambda e: e < p)) - 1 AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM s WHERE p > 0 GROUP BY 1) SELECT bin::INT AS bin, round((bin + 0.5) / 15, 6) AS center, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(abs(mean_p - mean_y), 6) AS gap FROM b")
def reliability_diagram(spark, sf):
    out = cal.reliability_diagram(_scores(spark, sf))
    return out.select("bin", F.round("center", 6).alias("center"), "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "mean_y", "gap")])


@query("brier_scores", f"WITH {_SCORES}, b AS (SELECT avg((p - y) * (p - y)) AS b, avg(y) * (1 - avg(y)) AS c FROM s) SELECT round(b, 6) AS brier, round(c, 6) AS climatology, round(1 - b / c, 6) AS skill FROM b")
def brier_scores(spark, sf):
    out = cal.brier(_scores(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in ("brier", "climatology", "skill")])


@query("brier_multiclass", f"WITH {_SCORES} SELECT round(avg((1 - p - (y = 0)::INT) ** 2 + (p - (y = 1)::INT) ** 2), 6) AS brier FROM s")
def brier_multiclass(spark, sf):
    rows = _scores(spark, sf).select(F.array(1 - F.col("p"), F.col("p")).alias("probs"), F.col("y").alias("label"))
    return cal.brier_multiclass(rows).select(F.round("brier", 6).alias("brier"))


@query("brier_decomposition", f"WITH {_BINS}, o AS (SELECT avg(y) AS base FROM s) SELECT round(sum(n * (mean_p - mean_y) ** 2) / sum(n), 6) AS reliability, round(sum(n * (mean_y - base) ** 2) / sum(n), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM b, o")
def brier_decomposition(spark, sf):
    out = cal.brier_decomposition(_scores(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query("calibrators")
def calibrators(spark, sf):
    rows = _scores(spark, sf)
    held = rows.cache()  # read by every round of the fits, then released
    temperature, platt, isotonic = cal.fit_temperature(held), cal.fit_platt(held), cal.fit_isotonic(held)
    held.unpersist()
    out = isotonic.transform(rows)
    return out.select("doc_id", F.round(cal.apply_temperature(F.col("p"), temperature), 6).alias("temperature"), F.round(cal.apply_platt(F.col("p"), *platt), 6).alias("platt"), F.round("calibrated", 6).alias("isotonic"))


#: The largest, over beginnings up to a value, of the smallest mean of the values from there to beyond it.
_ISOTONIC = f"""{_SCORES}, g AS (SELECT p, count(*) AS n, sum(y) AS y FROM s GROUP BY p), c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS n, sum(y) OVER (ORDER BY p) AS y, n AS own_n, y AS own_y FROM g),
    a AS (SELECT b.i AS j, e.i AS k, (e.y - b.y + b.own_y) / (e.n - b.n + b.own_n) AS mean FROM c b JOIN c e ON e.i >= b.i), m AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM a), f AS (SELECT i, max(least) AS fit FROM m GROUP BY i)"""


@query("calibrator_isotonic", f"WITH {_ISOTONIC} SELECT doc_id, round(fit, 6) AS isotonic FROM s JOIN c USING (p) JOIN f USING (i)")
def calibrator_isotonic(spark, sf):
    rows = _scores(spark, sf)
    return cal.fit_isotonic(rows).transform(rows).select("doc_id", F.round("calibrated", 6).alias("isotonic"))


# --- joins, filters and sets -------------------------------------------------------------


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf):
    return joins.seeded_sample(table(spark, sf, "documents").select("doc_id"), 100, "doc_id")


@query("seeded_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def seeded_split(spark, sf):
    return joins.seeded_split(table(spark, sf, "documents").select("doc_id"), 0.1, "doc_id")


@query("include_exclude", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def include_exclude(spark, sf):
    labels = table(spark, sf, "labels")
    return joins.include_exclude(table(spark, sf, "documents").select("doc_id"), labels, labels.filter("toxic = 1"), key="doc_id")


@query("non_empty", "SELECT count(*) AS n FROM documents WHERE text <> ''")
def non_empty(spark, sf):
    return joins.non_empty(table(spark, sf, "documents")).agg(F.count(F.lit(1)).alias("n"))


@query("id_sets", "WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT 'intersection' AS kind, count(*) AS n FROM a JOIN b USING (doc_id) UNION ALL SELECT 'left_only', count(*) FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT 'right_only', count(*) FROM b ANTI JOIN a USING (doc_id) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)")
def id_sets(spark, sf):
    parts = dedup.id_sets(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))
    out = None
    for kind, ids in parts.items():
        one = ids.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("merged_corpora", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, d.source) AS source, d.lang FROM documents d FULL JOIN labels l USING (doc_id)")
def merged_corpora(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "source", "lang")
    right = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("source"))
    return joins.merge_corpora(left, right, key="doc_id", combine=True)


@query(
    "reduced_corpus",
    "WITH need AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 5000), rest AS (SELECT doc_id FROM documents ANTI JOIN need USING (doc_id) ORDER BY md5('42|' || doc_id), doc_id LIMIT 50) SELECT doc_id FROM documents SEMI JOIN need USING (doc_id) UNION ALL SELECT doc_id FROM rest",
)
def reduced_corpus(spark, sf):
    docs = table(spark, sf, "documents")
    return joins.reduce_corpus(docs.select("doc_id"), table(spark, sf, "labels").filter("toxic = 1"), docs.filter("n_chars > 5000"), 50)


@query("url_groups", "WITH h AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+') AS url, page_id FROM pages) SELECT url, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id, max(page_id) - min(page_id) + 1 = count(*) AS contiguous FROM h GROUP BY url")
def url_groups(spark, sf):
    return joins.url_groups(table(spark, sf, "pages"), F.regexp_extract("url", "^[a-z]+://[^/]+", 0))


@query("lookup_join", "SELECT d.doc_id::VARCHAR AS doc_id, p.url AS url, coalesce(p.url, d.source) AS source FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def lookup_join(spark, sf):
    """Urls of pages by id with a ``.txt`` ending; a document without a page keeps its source."""
    lookup = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("doc_id"), "url", F.col("url").alias("source"))
    return joins.attach_lookup(table(spark, sf, "documents").select("doc_id", "source"), lookup, fields=("url", "source")).select("doc_id", "url", "source")


@query("missing_positives", "WITH w AS (SELECT DISTINCT unnest([doc_id, doc_id + 100000000]) AS doc_id FROM labels) SELECT count(*) AS n_missing FROM w ANTI JOIN documents USING (doc_id)")
def missing_positives(spark, sf):
    questions = table(spark, sf, "labels").select(F.array(F.col("doc_id"), F.col("doc_id") + 100_000_000).alias("positive_passages"))
    return joins.missing_positives(questions, table(spark, sf, "documents"))


@query("expanded_codes", "WITH c AS (SELECT doc_id // 4 AS code, doc_id FROM documents), q AS (SELECT DISTINCT vec_id AS qid, unnest([vec_id // 2, label]) AS code FROM embeddings) SELECT qid, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT DISTINCT qid, doc_id FROM q JOIN c USING (code)) GROUP BY qid")
def expanded_codes(spark, sf):
    """Four documents a code, two codes a question."""
    codes = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("code"), "doc_id")
    questions = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.floor(F.col("vec_id") / 2).alias("a"), F.col("label").cast("long").alias("b"))
    return joins.expand_codes(questions, codes, ["a", "b"]).select("qid", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query("judged_hits", f"WITH {_sql_search('h')} SELECT qid, id::VARCHAR AS doc_id, label = qlabel AS relevant FROM h")
def judged_hits(spark, sf):
    hits = _search(spark, sf).select("qid", F.col("id").cast("string").alias("doc_id"))
    return joins.judge_hits(hits, _label_judgements(spark, sf)).select("qid", "doc_id", "relevant")


@query("questions_with_gold", f"WITH {_sql_vectors()}, {_JUDGED} SELECT qid, num_gold AS n_gold FROM n")
def questions_with_gold(spark, sf):
    questions = _vectors(spark, sf)[1].select("qid")
    return joins.drop_without_gold(joins.attach_gold(questions, _label_judgements(spark, sf))).select("qid", F.size("relevant").cast("long").alias("n_gold"))


@query("training_triplets")
def training_triplets(spark, sf):
    return joins.triplets(_label_judgements(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


# --- lexical retrieval -------------------------------------------------------------------

_LEXICAL = f"""d AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents), l AS (SELECT id, count(*) AS len FROM d GROUP BY id),
    c AS (SELECT id, term, count(*) AS tf FROM d GROUP BY id, term), asked AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM c GROUP BY term), t AS (SELECT count(*) AS n_docs, (SELECT avg(coalesce(l.len, 0)) FROM documents x LEFT JOIN l ON l.id = x.doc_id) AS avg_len FROM documents)"""
_BM25 = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"
_LEXICAL_HITS = "r AS (SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"


def _lexical(spark, sf, **options) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _hits(retrieval.bm25_top_k(docs, questions, _ascii_tokens, 10, item="doc_id", **options))


@query("bm25_top10", f"WITH {_LEXICAL}, s AS (SELECT qid, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * {_BM25}) AS score FROM asked JOIN c USING (term) JOIN df USING (term) JOIN l USING (id), t GROUP BY qid, id), {_LEXICAL_HITS}")
def bm25_top10(spark, sf):
    return _lexical(spark, sf)


@query(
    "bm25_floored_top10",
    f"WITH {_LEXICAL}, i AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM df, t), m AS (SELECT avg(raw) AS mean FROM i), w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM i, m), s AS (SELECT qid, id, sum(idf * {_BM25}) AS score FROM asked JOIN c USING (term) JOIN w USING (term) JOIN l USING (id), t GROUP BY qid, id), {_LEXICAL_HITS}",
)
def bm25_floored_top10(spark, sf):
    return _lexical(spark, sf, floor_idf=True)


@query("sparse_dot_top10", f"WITH {_LEXICAL}, q AS (SELECT qid, term, 1.0 AS w FROM asked), p AS (SELECT id, term, ln(1 + tf) AS w, row_number() OVER (PARTITION BY id ORDER BY round(ln(1 + tf), 9) DESC, term) AS n FROM c), s AS (SELECT qid, id, sum(q.w * p.w) AS score FROM q JOIN p USING (term) WHERE n <= 64 GROUP BY qid, id), {_LEXICAL_HITS}")
def sparse_dot_top10(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), _ascii_tokens(F.col("text")).alias("words"))
    weights = retrieval.term_counts(docs, F.col("words")).select("id", "term", F.round(F.log(1.0 + F.col("tf")), 9).alias("weight"))
    postings = retrieval.top_terms(weights, 64)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(_ascii_tokens(F.col("text")))).alias("term")).withColumn("weight", F.lit(1.0))
    return _hits(retrieval.sparse_top_k(postings, asked, 10))


@query(
    "rerank_sparse",
    f"WITH {_LEXICAL}, s AS (SELECT qid, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * {_BM25}) AS score FROM asked JOIN c USING (term) JOIN df USING (term) JOIN l USING (id), t GROUP BY qid, id), "
    f"h AS ({_LEXICAL_HITS.replace('r AS (', 'WITH r AS (', 1)}), p AS (SELECT id, term, round(ln(1 + tf), 9) AS w, row_number() OVER (PARTITION BY id ORDER BY round(ln(1 + tf), 9) DESC, term) AS n FROM c), "
    "m AS (SELECT qid, id, round(sum(w), 9) AS sim FROM h JOIN asked USING (qid) JOIN p USING (id, term) WHERE n <= 64 GROUP BY qid, id) "
    "SELECT qid, id, round(coalesce(sim, 0), 6) AS similarity, (row_number() OVER (PARTITION BY qid ORDER BY coalesce(sim, 0) DESC, rank))::INT AS new_rank FROM h LEFT JOIN m USING (qid, id)",
)
def rerank_sparse(spark, sf):
    """BM25 hits ranked again by the dot product of sparse term weights."""
    hits = _lexical(spark, sf)
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text").join(hits.select("id").distinct(), "id", "left_semi")
    weights = retrieval.term_counts(docs.select("id", _ascii_tokens(F.col("text")).alias("words")), F.col("words")).select("id", "term", F.round(F.log(1.0 + F.col("tf")), 9).alias("weight"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(_ascii_tokens(F.col("text")))).alias("term")).withColumn("weight", F.lit(1.0))
    scored = rerank.with_sparse_similarity(hits, asked, retrieval.top_terms(weights, 64))
    out = rerank.rerank(scored, F.col("similarity"))
    return out.select("qid", "id", F.round("similarity", 6).alias("similarity"), F.col("new_rank").cast("int").alias("new_rank"))


@query("similar_hits_dropped")
def similar_hits_dropped(spark, sf):
    """Greedy ROUGE-1 de-duplication of the lexical hits of each question."""
    hits = _lexical(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return dedup.drop_similar(hits, 0.7).select("qid", "id", "rank")


@query("trec_lines", f"WITH {_sql_search('h')} SELECT qid, id AS doc_id, round(score, 6) AS score, qid || chr(9) || '0' || chr(9) || id AS head FROM h")
def trec_lines(spark, sf):
    lines = writers.trec_run(_search(spark, sf).withColumnRenamed("id", "doc_id"))
    return lines.select("qid", "doc_id", F.round("score", 6).alias("score"), F.regexp_extract("value", r"^(.*)\t[^\t]*$", 1).alias("head"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    from ..streaming.incremental import windowed_counts

    out = windowed_counts(table(spark, sf, "events"), "1 hour")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "text_feature_table",
    f"WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term), "
    "t AS (SELECT count(*) AS n_docs FROM documents), f AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM c GROUP BY term) SELECT term, n, df, round(ln((1.0 + n_docs) / (1 + df)) + 1, 9) AS idf FROM f, t WHERE df <= 0.95 * n_docs ORDER BY n DESC, term LIMIT 5000",
)
def text_feature_table(spark, sf):
    out = features.feature_table(table(spark, sf, "documents"), _ascii_tokens(F.col("text")))
    return out.select("term", "n", "df", F.round("idf", 9).alias("idf"))


_SPACED_WORDS = _TOKENS.format("text").replace("[a-z0-9]+", r"[^ \t\n\r\f\v]+")


@query("text_token_difference", f"WITH t AS (SELECT {_TOKENS.format('text')} AS a, {_SPACED_WORDS} AS b FROM documents) SELECT count(*) AS n, sum((a <> b)::INT)::BIGINT AS n_different, round(avg(len(a)), 6) AS mean_a, round(avg(len(b)), 6) AS mean_b FROM t")
def text_token_difference(spark, sf):
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = table(spark, sf, "documents").select(_ascii_tokens(F.col("text")).alias("a"), F.regexp_extract_all(lowered, F.lit(r"([^ \t\n\r\f\x0b]+)"), F.lit(1)).alias("b"))
    out = features.tokenization_difference(docs, F.col("a"), F.col("b"))
    return out.select("n", "n_different", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@query("same_text", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM (SELECT text FROM documents JOIN labels USING (doc_id)) l WHERE trim(regexp_replace(d.text, '[ \t\n\r\f\v]+', ' ', 'g')) = trim(regexp_replace(l.text, '[ \t\n\r\f\v]+', ' ', 'g')))")
def same_text(spark, sf):
    docs = table(spark, sf, "documents")
    return features.same_text(docs, docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")).select("doc_id")


@query("zipped_json", "SELECT event_id, position::INT AS position, x AS a, y AS b FROM (SELECT event_id, unnest(range(2)) AS position, unnest([event_type, user_id::VARCHAR]) AS x, unnest([user_id::VARCHAR, event_type]) AS y FROM events)")
def zipped_json(spark, sf):
    a = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    b = F.to_json(F.array(F.col("user_id").cast("string"), "event_type"))
    return features.zip_json_arrays(table(spark, sf, "events").select("event_id", a.alias("a"), b.alias("b")), "a", "b")


@query("timing_comparison", "SELECT event_type AS name, 's' || user_id % 3 AS system, count(*) AS n, round(sum(value), 4) AS total, round(avg(value) / 8, 6) AS mean, round(quantile_cont(value, 0.5) / 8, 6) AS median, round(stddev_pop(value) / 8, 6) AS std, round(min(value) / 8, 6) AS min, round(max(value) / 8, 6) AS max FROM events GROUP BY 1, 2")
def timing_comparison(spark, sf):
    samples = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("system"), F.col("value").alias("ms"))
    out = st.timing_comparison(samples, 8)
    return out.select("name", "system", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


_PAIRS = f"WITH {_TWO.replace('WHERE rank <= 10', 'WHERE rank <= 1000000000')}, x AS (SELECT h.qid, h.id, h.score AS f, p.score AS s, h.label = h.qlabel AS rel, row_number() OVER (PARTITION BY h.qid ORDER BY h.score DESC, h.id) AS n FROM h JOIN p USING (qid, id))"


@query(
    "prefix_losses",
    f"{_PAIRS}, e AS (SELECT qid, exp(s / 0.05 - max(s / 0.05) OVER (PARTITION BY qid)) AS e, rel FROM x), n AS (SELECT qid, sum(CASE WHEN rel THEN e END) AS p, sum(e) AS a FROM e GROUP BY qid) "
    "SELECT round((SELECT avg(abs(f - s)) FROM x), 6) AS pairwise, round((SELECT avg(abs(f - s)) FROM x WHERE n <= 10), 6) AS neighbour, round((SELECT avg(-ln(p / a)) FROM n WHERE p > 0), 6) AS info_nce",
)
def prefix_losses(spark, sf):
    out = losses.prefix_losses(*_vectors(spark, sf), 32, 10, ("qlabel", "label"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("answer_recall")
def answer_recall(spark, sf):
    """ROUGE recall of each question's hits, by depth."""
    hits = _lexical(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return answers.rouge_at_k(hits, table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query("table_description")
def table_description(spark, sf):
    return st.describe_table(table(spark, sf, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES", "Window"]
