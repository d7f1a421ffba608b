"""More registered queries: fields of records, joins by url, features, losses and fields of BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text as tx
from ..operators import answers, dedup, features, joins, losses, metrics, retrieval, statistics as st
from ..sources import readers, writers
from ..sources.readers import spread
from .registered import _TOKENS, _ascii_tokens, _search, _sql_search, _sql_vectors, _vectors, query, table

# --- records -----------------------------------------------------------------------------


@query("first_present_field", "SELECT doc_id, lang AS value, source AS other FROM documents")
def first_present_field(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.struct("lang", F.struct("source").alias("inner")).alias("record"))
    return docs.select("doc_id", paths.first_present(docs, "missing|record.none|record.lang").alias("value"), paths.first_present(docs, "record.inner.source|doc_id").alias("other"))


@query("nested_path", "SELECT conv_id, count(*)::INT AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def nested_path(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")).alias("talk"))
    roles = paths.nested(own, "talk.turns[*].role")
    return own.select("conv_id", F.size(roles).alias("n"), F.array_join(roles, ",").alias("roles"))


@query("question_records", "SELECT item_id::VARCHAR AS qid, md5(text) AS digest, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS n_relevant, item_id::VARCHAR || '|' || (item_id + 1)::VARCHAR AS answers FROM benchmark")
def question_records(spark, sf):
    """Ids between commas, answers between colons; every third question has no judged id."""
    own, following = F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string")
    records = table(spark, sf, "benchmark").select(F.col("item_id").alias("_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(own, F.lit(", "), following)).alias("relevant"), F.concat(own, F.lit("::"), following).alias("answers"))
    return readers.read_questions(records).select("qid", F.md5("text").alias("digest"), F.size("relevant").alias("n_relevant"), F.array_join("answers", "|").alias("answers"))


@query("mapped_fields", "SELECT doc_id AS id, lang, source, 'base' AS origin FROM documents")
def mapped_fields(spark, sf):
    out = readers.map_fields(table(spark, sf, "documents"), {"doc_id": "id", "lang": "meta.language.code", "source": "meta.source"}, {"meta.origin": "base"})
    return out.select("id", F.col("meta.language.code").alias("lang"), F.col("meta.source").alias("source"), F.col("meta.origin").alias("origin"))


@query("last_input", "SELECT conv_id, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def last_input(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("input"))
    return readers.last_input_text(own).select("conv_id", F.md5("text").alias("digest"))


@query("extracted_texts", "SELECT md5(text) AS digest, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def extracted_texts(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("text")).alias("turns"))
    return readers.extract_texts(own, "turns[*].text").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("relevance_records", "SELECT vec_id::VARCHAR AS qid, label::VARCHAR AS doc_id, 2.0::DOUBLE AS relevance FROM embeddings")
def relevance_records(spark, sf):
    """Half of the records name their fields in one way, half in another."""
    rows = table(spark, sf, "embeddings")
    one = rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("corpus_id"), F.lit(2).alias("score"))
    other = rows.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("qid"), F.col("label").alias("docid"), F.lit(2.0).alias("relevance"))
    return readers.read_relevance_records(one.unionByName(other, allowMissingColumns=True))


@query("stored_results", f"WITH {_sql_search('h')} SELECT qid::VARCHAR AS qid, 'q' || qid AS question, id::VARCHAR AS id, rank::INT AS rank, round(score, 6) AS score FROM h")
def stored_results(spark, sf):
    """Hits nested under their questions, as stored, and read back."""
    hits = _search(spark, sf).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("retrieved_passages"))
    nested = hits.select(F.struct(F.col("qid").cast("string").alias("id"), F.concat(F.lit("q"), F.col("qid").cast("string")).alias("text")).alias("question"), "retrieved_passages")
    return readers.read_results(nested).select("qid", "question", "id", "rank", F.round("score", 6).alias("score"))


@query("first_contexts", "SELECT conv_id AS id, md5(arg_min(text, turn)) AS digest, count(*)::VARCHAR AS n FROM conversations GROUP BY conv_id")
def first_contexts(spark, sf):
    own = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("contexts"), F.count(F.lit(1)).alias("n"))
    out = writers.first_context(own.withColumn("answers", F.lit("none")))
    return out.select("id", F.md5("text").alias("digest"), F.get_json_object("metadata", "$.n").alias("n"))


@query("upserted", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def upserted(spark, sf):
    docs = table(spark, sf, "documents")
    return writers.upsert(docs.filter("doc_id % 2 = 0").select("doc_id", "source"), docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source")), "doc_id")


@query("log_fields", "SELECT DISTINCT event_type AS kind, (user_id % 10)::VARCHAR AS part FROM events WHERE event_type <> 'error'")
def log_fields(spark, sf):
    lines = table(spark, sf, "events").select(F.concat(F.when(F.col("event_type") == "error", "?").otherwise("run "), F.col("event_type"), F.lit(" part="), (F.col("user_id") % 10).cast("string"), F.lit(" end")).alias("value"))
    return features.log_records(lines, r"^run (\w+) part=(\d+)", ["kind", "part"])


# --- texts and urls ----------------------------------------------------------------------


@query("text_trimmed_tokens", r"SELECT doc_id, md5(array_to_string(list_slice(string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' '), 1, 20), ' ')) AS digest, md5(substring(text, 1, 30)) AS chars FROM documents")
def text_trimmed_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.trim(F.col("text"), "20t")).alias("digest"), F.md5(tx.trim(F.col("text"), "30c")).alias("chars"))


@query("title_policy", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id % 2 = 0 ELSE true END AS every, page_id % 3 = 0 AND page_id % 2 = 0 AS first, false AS never FROM pages")
def title_policy(spark, sf):
    """Which tiles get a title: pages stand for tiles 0 to 2, odd ones open with it."""
    index, opens = F.col("page_id") % 3, F.col("page_id") % 2 == 1
    return table(spark, sf, "pages").select("page_id", *[tx.needs_title(index, policy, opens).alias(name) for policy, name in (("all", "every"), ("first", "first"), ("none", "never"))])


@query("path_fields", "SELECT page_id, split_part(p, '/', 1) AS product, split_part(split_part(p, '/', 1), '-', 1) AS coarse_product, page_id || '' AS file FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) || '-v' || page_id % 3 || '/a/' || page_id AS p FROM pages)")
def path_fields(spark, sf):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    own = F.concat(F.lit("/"), host, F.lit("-v"), (F.col("page_id") % 3).cast("string"), F.lit("/a/"), F.col("page_id").cast("string"), F.lit(".txt"))
    return joins.path_parts(table(spark, sf, "pages").withColumn("path", own)).select("page_id", "product", "coarse_product", "file")


@query("judged_by_url", "SELECT page_id AS id, page_id % 5 < 2 AS relevant FROM pages")
def judged_by_url(spark, sf):
    """Hits and judgements of other fragments and versions of the same page."""
    url = lambda version, part: F.concat(F.lit("https://x.org/docs/en/p"), F.col("page_id").cast("string"), F.lit(version), F.lit(part))
    pages = table(spark, sf, "pages").withColumn("qid", F.lit("q"))
    hits = pages.select("qid", F.col("page_id").alias("id"), F.col("page_id").alias("doc_id"), url("/1.2", "#a").alias("url"))
    gold = pages.filter("page_id % 5 < 2").select("qid", (-F.col("page_id") - 1).alias("doc_id"), url("/3.0.1", "#b").alias("url"))
    return joins.judge_hits(hits, gold, by_url=True).select("id", "relevant")


# --- hits, features and losses -----------------------------------------------------------


@query("dedup_null_keys", f"WITH {_sql_search('h', k=50)}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h) SELECT qid, id FROM d WHERE n = 1 OR label % 2 = 0")
def dedup_null_keys(spark, sf):
    """Hits of even labels have no key and all stay."""
    key = F.when(F.col("label") % 2 == 1, F.col("label"))
    hits = _search(spark, sf, k=50).join(_vectors(spark, sf)[0].select("id", key.alias("key")), "id")
    return dedup.keep_first(hits, "key", null_is_new=True).select("qid", "id")


@query("keyword_accuracy", f"WITH {_sql_search('h')}, f AS (SELECT qid, list(DISTINCT label) AS found FROM h WHERE rank <= 5 GROUP BY qid), q AS (SELECT id AS qid, list_distinct([label, label + 1, id % 10]) AS wanted FROM v WHERE id % 20 = 0) SELECT qid, round(len(list_intersect(wanted, found))::DOUBLE / len(wanted), 6) AS accuracy FROM q JOIN f USING (qid)")
def keyword_accuracy(spark, sf):
    rows, queries = _vectors(spark, sf)
    words = lambda *c: F.array(*[x.cast("string") for x in c])
    hits = _search(spark, sf).join(rows.select("id", words(F.col("label")).alias("keywords")), "id")
    asked = queries.select("qid", words(F.col("qlabel"), F.col("qlabel") + 1, F.col("qid") % 10).alias("keywords"))
    return answers.keyword_accuracy(hits, asked, 5).select("qid", F.round("accuracy", 6).alias("accuracy"))


_COUNTS = f"w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term)"


@query(
    "text_tf_idf",
    f"WITH {_COUNTS}, t AS (SELECT count(*) AS n_docs FROM documents), i AS (SELECT term, ln((1.0 + n_docs) / (1 + count(*))) + 1 AS idf FROM c, t GROUP BY term, n_docs HAVING count(*) <= 0.95 * n_docs ORDER BY sum(tf) DESC, term LIMIT 500), "
    "r AS (SELECT doc_id, tf * idf AS w FROM c JOIN i USING (term)) SELECT doc_id, count(*) AS n, round(sum(w) / sqrt(sum(w * w)), 6) AS total FROM r GROUP BY doc_id",
)
def text_tf_idf(spark, sf):
    docs, words = spread(table(spark, sf, "documents")).select("doc_id", "text"), _ascii_tokens(F.col("text"))
    weights = features.tf_idf(docs, words, features.feature_table(docs, words, size=500, longest=1), longest=1)
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query("text_average_vectors", f"WITH w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT doc_id, round(avg(length(term)), 6) AS a, round(avg((term < 'm')::INT), 6) AS b FROM w GROUP BY doc_id")
def text_average_vectors(spark, sf):
    """Each word's vector holds its length and whether it comes before m."""
    docs, words = spread(table(spark, sf, "documents")).select("doc_id", "text"), _ascii_tokens(F.col("text"))
    vectors = st.token_frequencies(docs, words).select("token", F.array(F.char_length("token").cast("double"), (F.col("token") < "m").cast("double")).alias("vector")).withColumnRenamed("token", "term")
    out = features.average_vectors(docs, words, vectors, 2)
    return out.select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("a"), F.round(F.get("vector", F.lit(1)), 6).alias("b"))


_SHORT = f"{_sql_search('h')}, s AS (SELECT qid, id, score AS short, label = qlabel AS rel FROM h)"


@query(
    "vector_losses",
    f"WITH {_SHORT}, p AS (SELECT a.short AS positive, b.short AS negative FROM s a JOIN s b USING (qid) WHERE a.rel AND NOT b.rel) "
    "SELECT (SELECT round(avg(ln(1 + exp(0.1 + negative - positive))), 6) FROM p) AS ranking, (SELECT round(avg(greatest(0.2 + negative - positive, 0)), 6) FROM p) AS triplet, "
    "(SELECT round(avg(list_sum(list_transform(embedding::DOUBLE[], lambda x: (0.1 * x) * (0.1 * x))) / len(embedding)), 9) FROM embeddings) AS reconstruction",
)
def vector_losses(spark, sf):
    rows, queries = _vectors(spark, sf)
    hits = _search(spark, sf).join(rows.select("id", "label"), "id").join(queries.select("qid", "qlabel"), "qid")
    pairs = hits.select("qid", F.col("score").alias("short"), (F.col("label") == F.col("qlabel")).alias("relevant"))
    good, bad = (pairs.filter(F.col("relevant") == F.lit(x)).select("qid", F.col("short").alias(n)) for x, n in ((True, "positive"), (False, "negative")))
    near = rows.select("vector", F.transform("vector", lambda x: x.cast("double") * 0.9).alias("near"))
    parts = [losses.ranking(pairs, 0.1).select(F.round("loss", 6).alias("ranking")), losses.triplet(good.join(bad, "qid"), 0.2).select(F.round("loss", 6).alias("triplet")), losses.reconstruction(near, "vector", "near").select(F.round("loss", 9).alias("reconstruction"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # single rows


@query("macro_average", "SELECT event_type AS qid, round(avg(value), 6) AS baseline, round(avg(user_id), 6) AS result FROM events GROUP BY 1")
def macro_average(spark, sf):
    out = st.macro_average(table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("value").alias("baseline"), F.col("user_id").cast("double").alias("result")))
    return out.select("qid", F.round("baseline", 6).alias("baseline"), F.round("result", 6).alias("result"))


@query("best_of_two_fields", f"WITH {_sql_vectors()}, b AS (SELECT q.id AS qid, v.id, max(round(list_dot_product(list_slice(q.vec, f, f + 31), list_slice(v.vec, f, f + 31)), 9)) AS score FROM v q, v, (SELECT unnest([1, 33]) AS f) WHERE q.id % 20 = 0 AND q.id <> v.id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b) SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def best_of_two_fields(spark, sf):
    """The halves of the vectors stand for two fields; the best ten of either hold the best ten of both."""
    rows, queries = _vectors(spark, sf)
    halves = [[d.withColumn("vector", F.slice("vector", at, 32)) for d in (rows, queries)] for at in (1, 33)]
    out = retrieval.best_field([retrieval.dense_top_k(r, q, 10, exclude_self=True) for r, q in halves], 10)
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("unjudged_dropped", f"WITH {_sql_search('h')}, m AS (SELECT qid, max((label = qlabel)::INT) AS match FROM h GROUP BY qid) SELECT count(*) AS n_queries, round(avg(match), 6) AS match FROM m WHERE qid % 40 <> 0")
def unjudged_dropped(spark, sf):
    """Every second question carries the mark of unjudged ones beside its judgements, and is left out."""
    rows, queries = _vectors(spark, sf)
    text = lambda c: F.col(c).cast("string")
    gold = queries.join(rows, F.col("label") == F.col("qlabel")).filter("id <> qid").select("qid", text("id").alias("doc_id"))
    gold = gold.unionByName(queries.filter("qid % 40 = 0").select("qid", F.lit(metrics.UNJUDGED).alias("doc_id")))
    hits = _search(spark, sf).select("qid", text("id").alias("doc_id"), "rank")
    return metrics.evaluate(hits, gold, (10,)).select("n_queries", F.round("match", 6).alias("match"))
