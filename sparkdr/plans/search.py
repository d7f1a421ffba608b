"""End-to-end plans: read, tile, index, search, rerank, de-duplicate, evaluate; all lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import analyze, tokens
from ..operators import dedup, fusion, joins, metrics, rerank, retrieval, tiler
from ..sources import readers, writers
from .config import Config, ConfigError, build, load, preset


def hashed_encoder(dimensions: int = 256) -> Callable[[DataFrame], DataFrame]:
    """A deterministic stand-in for a text encoder: terms hashed to buckets, square-root counts, unit length.

    It carries no meaning beyond shared words; plug in a model-backed encoder for that.
    """

    def encode(texts: DataFrame) -> DataFrame:
        terms = F.transform(tokens(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
        zero = F.array_repeat(F.lit(0.0), dimensions)
        long = texts.select("*", F.explode_outer(terms).alias("_bucket"))
        own = long.groupBy(*texts.columns, "_bucket").agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("_w"))
        cells = own.groupBy(*texts.columns).agg(F.map_from_entries(F.collect_list(F.when(F.col("_bucket").isNotNull(), F.struct("_bucket", "_w")))).alias("_cells"))
        size = F.sqrt(F.aggregate(F.map_values("_cells"), F.lit(0.0), lambda s, w: s + w * w))
        vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("_cells", i) / size, F.lit(0.0)))
        return cells.select(*texts.columns, F.when(F.size("_cells") > 0, vector).otherwise(zero).alias("vector"))

    return encode


@dataclass
class Engine:
    """A search engine over passages ``(id, doc_id, title, text, ...)`` kept as ordinary frames."""

    spark: SparkSession
    config: Config
    encoder: Callable[[DataFrame], DataFrame] | None = None
    pair_scorer: Callable[[list[str], list[str]], list[float]] | None = None
    passages: DataFrame | None = None

    @classmethod
    def from_preset(cls, spark: SparkSession, name: str, **overrides) -> Engine:
        from .config import merge

        return cls(spark, build(merge(preset(name), overrides)))

    @classmethod
    def from_files(cls, spark: SparkSession, preset_name: str | None = None, file: str | None = None, overrides: list[str] = ()) -> Engine:
        return cls(spark, load(preset_name, file, overrides))

    # reading

    def read_data(self, source, id_path: str = "id|_id|document_id|doc_id", text_path: str = "text|document", title_path: str = "title", keep: tuple[str, ...] = ()) -> DataFrame:
        """Passages of a path, a list of paths, a list of dictionaries or a frame."""
        from ..functions.paths import first_present

        if isinstance(source, DataFrame):
            df = source
        elif isinstance(source, str):
            df = readers.read_many(self.spark, [source])
        elif source and isinstance(source[0], dict):
            df = self.spark.createDataFrame(source)
        else:
            df = readers.read_many(self.spark, list(source))
        title = first_present(df, title_path, default="").cast("string")
        docs = df.select(first_present(df, id_path).cast("string").alias("id"), title.alias("title"), first_present(df, text_path).cast("string").alias("text"), *keep)
        t = self.config.tiling
        return tiler.tile(docs, t.most, t.stride, t.title, t.aligned, t.mask_urls, keep=keep).filter("text <> ''")

    def read_questions(self, source, judgements: DataFrame | None = None, limit: int | None = None, need_gold: bool = False) -> DataFrame:
        df = source if isinstance(source, DataFrame) else readers.read_records(self.spark, source) if isinstance(source, str) else self.spark.createDataFrame(source)
        questions = readers.read_questions(df, limit=limit)
        if judgements is not None:
            questions = joins.attach_gold(questions, judgements)
        return joins.drop_without_gold(questions) if need_gold else questions

    # indexing

    def ingest(self, passages: DataFrame, name: str | None = None, exists: str = "skip", buckets: int | None = None) -> DataFrame:
        """Use passages as the index, as a table of that name if given."""
        if name:
            writers.save_table(passages, name, exists, buckets=buckets)
            passages = self.spark.table(name)
        self.passages = passages
        return passages

    # searching

    def _encode(self, texts: DataFrame, question: bool = False) -> DataFrame:
        r = self.config.retrieval
        prefix = r.query_prefix if question else r.document_prefix
        if prefix:
            texts = texts.withColumn("text", F.concat(F.lit(prefix), "text"))
        return (self.encoder or hashed_encoder(r.dimensions))(texts)

    def _one(self, engine: str, questions: DataFrame, k: int) -> DataFrame:
        r, rows = self.config.retrieval, self.passages
        if other := [f for f in r.filters if f.get("type", "must") not in ("must", "should")]:
            raise ConfigError(f"filters of type {other[0]['type']!r}; known: 'must', 'should'")
        match, either = ([(f["query"], f["document"]) for f in r.filters if f.get("type", "must") == kind] for kind in ("must", "should"))
        allowed = retrieval.where_equal(rows, questions, match, either=either) if r.filters else None
        if engine == "bm25":
            return retrieval.bm25_top_k(rows, questions, lambda c: analyze(c, "text_stop"), k, r.k1, r.b, r.floor_idf, allowed=allowed)
        if engine == "dense":
            fields = lambda side: list(dict.fromkeys(f[side] for f in r.filters))
            own = rows if "vector" in rows.columns else self._encode(rows.select("id", "text", *fields("document")))
            asked = questions if "vector" in questions.columns else self._encode(questions.select("qid", "text", *fields("query")), question=True)
            return retrieval.dense_top_k(own, asked, k, r.metric, match=match, either=either)
        if engine == "sparse":
            return retrieval.sparse_top_k(self._sparse(rows), self._sparse_questions(questions), k, allowed=allowed)
        raise ConfigError(f"engine {engine!r}")

    def _sparse(self, rows: DataFrame) -> DataFrame:
        """``(id, term, weight)``: the heaviest terms of each passage."""
        counts = retrieval.term_counts(rows.select("id", analyze(F.col("text"), "text_stop").alias("w")), F.col("w"))
        return retrieval.top_terms(counts.select("id", "term", F.log1p("tf").alias("weight")), self.config.retrieval.terms)

    def _sparse_questions(self, questions: DataFrame) -> DataFrame:
        return questions.select("qid", F.explode(F.array_distinct(analyze(F.col("text"), "text_stop"))).alias("term")).withColumn("weight", F.lit(1.0))

    def search(self, questions: DataFrame) -> DataFrame:
        """``(qid, id, doc_id, score, rank, title, text)`` of every question."""
        r = self.config.retrieval
        if r.engine == "file":
            return readers.read_results(readers.read_records(self.spark, r.path)).join(questions.select("qid"), "qid", "left_semi")
        if self.passages is None:
            raise ConfigError("ingest passages before a search")
        if r.engine == "hybrid":
            lists = [self._one(m, questions, r.top_k) for m in r.members]
            hits = fusion.reciprocal_rank(lists, r.top_k, r.constant) if r.fusion == "rrf" else fusion.weighted(lists, r.top_k, r.weights, r.normalizer)
        else:
            hits = self._one(r.engine, questions, r.top_k)
        hits = hits.select("qid", "id", "score", "rank").join(self.passages.select("id", "doc_id", "title", "text"), "id")
        hits = self._rerank(hits, questions)
        return self._distinct(hits)

    def _rerank(self, hits: DataFrame, questions: DataFrame) -> DataFrame:
        c = self.config.rerank
        if c.kind == "none":
            return hits
        if c.kind == "pairs":
            if self.pair_scorer is None:
                raise ConfigError("a pair scorer is needed")
            scored = rerank.with_pair_scores(hits.join(questions.select("qid", F.col("text").alias("query_text")), "qid"), self.pair_scorer).withColumnRenamed("similarity", "_sim")
        elif c.kind == "sparse":
            needed = self.passages.select("id", "text").join(hits.select("id").distinct(), "id", "left_semi")
            scored = rerank.with_sparse_similarity(hits, self._sparse_questions(questions), self._sparse(needed)).withColumnRenamed("similarity", "_sim")
        else:
            from ..functions.vectors import cosine

            own = rerank.with_encoded(hits, self.passages.select("id", "text"), lambda p: self._encode(p.select("id", "text")).select("id", F.col("vector").alias("_v")))
            asked = self._encode(questions.select("qid", "text"), question=True).select("qid", F.col("vector").alias("_q"))
            scored = own.join(asked, "qid").withColumn("_sim", F.coalesce(cosine(F.col("_q"), F.col("_v")), F.lit(0.0)))
        out = rerank.rerank(scored, F.col("_sim"), c.head, c.method, c.weight)
        return out.select("qid", "id", "doc_id", F.coalesce("combined", "score").alias("score"), F.col("new_rank").alias("rank"), "title", "text")

    def _distinct(self, hits: DataFrame) -> DataFrame:
        how = self.config.retrieval.duplicate_removal
        if how == "none":
            return hits
        if how == "exact":
            hits = dedup.keep_first(hits, "text")
        elif how == "rouge":
            hits = dedup.drop_similar(hits, self.config.retrieval.similarity)
        elif how.startswith("key:"):
            hits = dedup.keep_first(hits, how[4:], null_is_new=True)
        else:
            raise ConfigError(f"duplicate removal {how!r}")
        return dedup.dense_rank_again(hits)

    # evaluation

    def evaluate(self, hits: DataFrame, judgements: DataFrame) -> DataFrame:
        """Metrics at each rank; of several passages of a document the first counts."""
        first = dedup.dense_rank_again(dedup.keep_first(hits.select("qid", F.col("doc_id").cast("string").alias("doc_id"), "rank"), "doc_id"))
        gold = judgements.select("qid", F.col("doc_id").cast("string").alias("doc_id"))
        return metrics.evaluate(first, gold, tuple(self.config.evaluation.ranks), self.config.evaluation.ideal)
