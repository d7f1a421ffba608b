"""Writers: results, run files and tables, each one action."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def nested_results(hits: DataFrame, questions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(question struct, retrieved_passages array)``, one row a question, hits by rank."""
    names = ["id", "title", "text", "score", *extra]
    item = F.struct("rank", *[F.col(n) if n in hits.columns else F.lit(None).cast("string").alias(n) for n in names])
    own = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("found"))
    q = questions.select("qid", F.struct(F.col("text"), F.col("qid").alias("id"), *[F.col(c) for c in ("relevant", "answers") if c in questions.columns]).alias("question"))
    bare = F.transform("found", lambda p: F.struct(*[p.getField(n).alias(n) for n in names]))
    return q.join(own, "qid", "left").select("question", F.coalesce(bare, F.array().cast(own.select(bare.alias("x")).schema["x"].dataType)).alias("retrieved_passages"))


def write_results(hits: DataFrame, questions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nested_results(hits, questions).write.mode(mode).json(path)


def write_metrics(values: DataFrame, path: str, system: str, kind: str = "csv", mode: str = "append") -> None:
    """Metrics of a system (a few rows) as one more file of a CSV, TSV or JSON table with a column ``system``."""
    named = values.select(F.lit(system).alias("system"), *[F.col(f"`{c}`") for c in values.columns]).coalesce(1)
    if kind == "json":
        named.write.mode(mode).json(path)
    elif kind in ("csv", "tsv"):
        named.write.mode(mode).csv(path, header=True, sep="," if kind == "csv" else "\t")
    else:
        raise ValueError(f"kind {kind!r}; known: csv, tsv, json")


def write_timings(spark: SparkSession, stages: dict[str, float], path: str, system: str, mode: str = "append") -> None:
    """Seconds of named stages as one more CSV file of ``(system, stage, seconds, share)``."""
    total = sum(stages.values()) or 1.0
    rows = [(name, float(seconds), seconds / total) for name, seconds in stages.items()]
    write_metrics(spark.createDataFrame(rows, "stage string, seconds double, share double"), path, system, mode=mode)


def trec_run(hits: DataFrame, tag: str = "0", document: str = "doc_id") -> DataFrame:
    """``(value)`` lines ``qid iter doc score`` of each document's best score, best first within a question."""
    best = hits.groupBy("qid", document).agg(F.max("score").alias("score"))
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.lit(tag), F.col(document).cast("string"), F.col("score").cast("string"))
    return best.select("qid", document, "score", line.alias("value"))


def write_trec(hits: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    lines = trec_run(hits, **options)
    lines.repartitionByRange("qid").sortWithinPartitions("qid", F.desc("score")).select("value").write.mode(mode).text(path)


def versioned(path: str) -> str:
    """A fresh folder name beside a path, for outputs that must not replace older ones."""
    return f"{path.rstrip('/')}.{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}"


def first_context(df: DataFrame) -> DataFrame:
    """``(text, id, answers, metadata)`` of records with ``contexts``: the first context's text."""
    meta = [c for c in df.columns if c not in ("contexts", "id", "answers")]
    return df.select(F.get("contexts", F.lit(0)).getField("text").alias("text"), "id", "answers", F.to_json(F.struct(*meta)).alias("metadata") if meta else F.lit(None).cast("string").alias("metadata"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def table_action(spark: SparkSession, name: str, exists: str = "skip") -> str:
    """What to do with a table: ``create``, or ``skip``, ``replace``, ``append``, ``update`` where it exists."""
    if exists not in ("skip", "replace", "append", "update"):
        raise ValueError(exists)
    return exists if spark.catalog.tableExists(name) else "create"


def save_table(df: DataFrame, name: str, exists: str = "skip", key: str = "id", buckets: int | None = None) -> str:
    """Create or change a table; returns what was done.  ``buckets`` co-locates later joins on the key."""
    spark = df.sparkSession
    action = table_action(spark, name, exists)
    if action == "skip":
        return action
    if action == "update":
        merged = upsert(spark.table(name), df, key)
        fresh, old = f"{name}__new", f"{name}__old"
        writer = merged.write.mode("overwrite")
        (writer.bucketBy(buckets, key).sortBy(key) if buckets else writer).saveAsTable(fresh)
        # the old table is dropped last: whenever the driver dies, one of the two is whole
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        spark.sql(f"DROP TABLE {old}")
        return action
    writer = df.write.mode("append" if action == "append" else "overwrite")
    if buckets and action != "append":
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return action


def embedding_export(df: DataFrame, vector: str, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (at unit length if asked) and one row of norm statistics."""
    from ..functions.vectors import norm, normalized

    n = norm(F.col(vector))
    stats = df.agg(F.min(n).alias("min_norm"), F.max(n).alias("max_norm"), F.avg(n).alias("avg_norm"), F.stddev_pop(n).alias("std_norm"), F.count(F.lit(1)).alias("n"))
    return (df.withColumn(vector, normalized(F.col(vector))) if unit else df), stats
