"""Significance tests, histograms, profiles, timing summaries and token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sign_bit(seed: int, key: Column, trial: Column) -> Column:
    """A fair bit of (seed, key, trial), the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), trial.cast("string")))
    return F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 2


def paired_randomization(scores: DataFrame, trials: int = 1_000, seed: int = 42, group: str | None = None) -> DataFrame:
    """Two-sided paired randomisation test of ``(qid, baseline, result)``.

    Each trial swaps each pair with probability one half; ``p`` is the share of trials
    (and the observed one) whose mean difference is as large.  Differences are summed per
    trial before anything is shuffled.
    """
    keys = [group] if group else []
    diff = scores.select(*keys, "qid", (F.col("result") - F.col("baseline")).alias("d"))
    seen = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("difference"), F.sum("d").alias("total"))
    swapped = diff.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    swapped = swapped.withColumn("s", F.when(sign_bit(seed, F.col("qid"), F.col("trial")) == 1, -F.col("d")).otherwise(F.col("d")))
    sums = swapped.groupBy(*keys, "trial").agg(F.sum("s").alias("s"))
    sums = sums.join(F.broadcast(seen), keys) if keys else sums.crossJoin(F.broadcast(seen))  # a row a group
    large = (F.abs(F.col("s")) >= F.abs(F.col("total")) - 1e-12).cast("int")
    return sums.groupBy(*keys, "n", "difference").agg(((F.sum(large) + 1) / (trials + 1)).alias("p_value"))


def macro_average(scores: DataFrame, tasks: dict[str, str] | None = None) -> DataFrame:
    """``(qid = task, baseline, result)``: task means as pairs of their own, for a test across tasks."""
    return scores.groupBy("task").agg(F.avg("baseline").alias("baseline"), F.avg("result").alias("result")).withColumnRenamed("task", "qid")


def right_closed_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``(bin, n)`` from 1: equal width between minimum and maximum, right-closed, the minimum in bin 1."""
    x = F.col(value).cast("double")
    span = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") == F.col("low"), 1).otherwise(F.greatest(F.lit(1), F.least(F.ceil((x - F.col("low")) / step), F.lit(bins))))
    return df.crossJoin(F.broadcast(span)).filter(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def left_closed_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``(bin, n, percent)`` from 1: left-closed bins, the last one closed on both sides."""
    x = F.col(value).cast("double")
    span = df.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("total"))
    step = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.floor((x - F.col("low")) / step) + 1, F.lit(bins)))
    own = df.crossJoin(F.broadcast(span)).filter(x.isNotNull()).groupBy(at.cast("int").alias("bin"), "total").agg(F.count(F.lit(1)).alias("n"))
    return own.select("bin", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def edged_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``(bin, n)`` from 1 between given rising edges: left-closed bins, the last one closed on both sides; values outside fall out."""
    x = F.col(value).cast("double")
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("at least two rising edges are needed")
    at = F.least(sum((x >= float(e)).cast("int") for e in edges), F.lit(len(edges) - 1))
    return df.filter(x.between(float(edges[0]), float(edges[-1])) & ~F.isnan(x)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def metric_table(rows: DataFrame, metrics: list[str], model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """``(model, <metric>...)``: the mean value of each listed metric of each model, null where it has none."""
    return rows.groupBy(model).pivot(metric, metrics).agg(F.avg(value))


PERCENTILES = (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))


def profile(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, mean, population spread, extremes and percentiles of a value."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        *[F.percentile(x, F.lit(q)).alias(name) for name, q in PERCENTILES],
    )


def counters(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key, most first, ties by key."""
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *keys)


def token_frequencies(df: DataFrame, words: Column) -> DataFrame:
    """``(token, n)`` over all rows."""
    return df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def interpolate(distributions: list[tuple[DataFrame, float]]) -> DataFrame:
    """``(token, p)``: weighted mean of token distributions over the union of their vocabularies."""
    whole = sum(w for _, w in distributions)
    parts = None
    for counts, weight in distributions:
        total = counts.agg(F.sum("n").alias("total"))
        part = counts.crossJoin(F.broadcast(total)).select("token", (F.lit(weight / whole) * F.col("n") / F.col("total")).alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("token").agg(F.sum("p").alias("p"))


def select_vocabulary(frequencies: DataFrame, size: int, special: list[str] = (), every: DataFrame | None = None) -> DataFrame:
    """``(token, new_id)``: special tokens, then the most frequent, unseen ones last; ids without gaps from 0.

    The ranking is a distributed sort with a limit, and only the chosen tokens are numbered.
    """
    pool = frequencies if every is None else every.select("token").distinct().join(frequencies, "token", "left")
    pool = pool.select("token", F.coalesce("n", F.lit(0)).alias("n")).withColumn("kept", F.col("token").isin(list(special)).cast("int") if special else F.lit(0))
    chosen = pool.orderBy(F.desc("kept"), F.desc("n"), "token").limit(size)
    return chosen.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("kept"), F.desc("n"), "token")) - 1).alias("new_id"))


def coverage(frequencies: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(coverage)``: percent of token occurrences that a vocabulary holds."""
    marked = frequencies.join(vocabulary.select("token").withColumn("held", F.lit(1)), "token", "left")
    return marked.agg((100.0 * F.sum(F.when(F.col("held") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def corpus_statistics(tiles: DataFrame, words: Column, document: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents, tiles, tiles a document, and extremes and means of lengths in characters and tokens."""
    own = tiles.select(F.col(document).alias("d"), F.char_length(text).alias("chars"), F.size(words).alias("toks"))
    return own.agg(
        F.count_distinct("d").alias("n_docs"), F.count(F.lit(1)).alias("n_tiles"), (F.count(F.lit(1)) / F.count_distinct("d")).alias("tiles_per_doc"),
        F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.avg("chars").alias("avg_chars"),
        F.min("toks").alias("min_tokens"), F.max("toks").alias("max_tokens"), F.avg("toks").alias("avg_tokens"),
    )


def truncation_rate(df: DataFrame, words: Column, limit: int) -> DataFrame:
    """``(rate)``: percent of rows of more than ``limit`` tokens."""
    return df.agg((100.0 * F.avg((F.size(words) > limit).cast("double"))).alias("rate"))


def stage_times(samples: DataFrame, least_ms: float = 0.01) -> DataFrame:
    """``(name, total_ms, percent)`` of a tree of ``a::b::c`` samples ``(name, ms)``.

    A node's time is its own recorded total, else the sum of its children; percent is of
    the parent.  Names have few levels, so each level is one aggregation.
    """
    own = samples.groupBy("name").agg(F.sum("ms").alias("own"))
    depth = own.agg(F.max(F.size(F.split("name", "::")))).first()[0] or 0
    parent = lambda c: F.array_join(F.slice(F.split(c, "::"), 1, F.size(F.split(c, "::")) - 1), "::")
    every = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "::"))), lambda i: F.array_join(F.slice(F.split("name", "::"), 1, i), "::"))).alias("name")).distinct()
    level = every.join(own, "name", "left").withColumn("level", F.size(F.split("name", "::")))
    done = None
    for d in range(depth, 0, -1):
        here = level.filter(F.col("level") == d)
        if done is None:
            here = here.select("name", F.coalesce("own", F.lit(0.0)).alias("total_ms"))
        else:
            below = done.filter(F.size(F.split("name", "::")) == d + 1).groupBy(parent(F.col("name")).alias("name")).agg(F.sum("total_ms").alias("below"))
            here = here.join(below, "name", "left").select("name", F.coalesce("own", "below", F.lit(0.0)).alias("total_ms"))
        done = here if done is None else done.unionByName(here)
    if done is None:
        return samples.sparkSession.createDataFrame([], "name string, total_ms double, percent double")
    done = done.withColumn("total_ms", F.greatest("total_ms", F.lit(least_ms)))
    up = done.select(F.col("name").alias("parent"), F.col("total_ms").alias("of"))
    return done.withColumn("parent", parent(F.col("name"))).join(up, "parent", "left").select("name", "total_ms", (100 * F.col("total_ms") / F.coalesce("of", "total_ms")).alias("percent"))


def throughput(batches: DataFrame) -> DataFrame:
    """Totals and rates of ``(items, tokenize_ms, encode_ms)`` batches."""
    ms = F.col("tokenize_ms") + F.col("encode_ms")
    return batches.agg(
        F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"), (1000 * F.sum("items") / F.sum(ms)).alias("items_per_s"),
        (F.sum(ms) / F.sum("items")).alias("ms_per_item"), (100 * F.sum("tokenize_ms") / F.sum(ms)).alias("tokenize_percent"),
    )


def leaderboard(rows: DataFrame, lower_is_better: dict[str, bool]) -> DataFrame:
    """``(metric, best_model, value)`` of rows ``(model, metric, value)``."""
    sign = F.lit(1.0)
    for name, lower in lower_is_better.items():
        sign = F.when(F.col("metric") == name, F.lit(1.0 if lower else -1.0)).otherwise(sign)
    order = F.struct((sign * F.col("value")).alias("v"), F.col("model"))
    return rows.groupBy("metric").agg(F.min_by("model", order).alias("best_model"), F.min_by("value", order).alias("value"))


def timing_comparison(samples: DataFrame, batch_size: int) -> DataFrame:
    """``(name, system, n, total, mean, median, std, min, max)``: statistics of each timing key and system, per item.

    All but the count and the sum are divided by the batch size.
    """
    own = profile(samples, "ms", ("name", "system"))
    each = [(F.col(c) / batch_size).alias(c) for c in ("mean", "median", "std", "min", "max")]
    return own.select("name", "system", "n", "total", *each)


def describe_table(df: DataFrame) -> DataFrame:
    """``(column, type, n, nulls, distinct)`` of every column, in one pass."""
    spark = df.sparkSession
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(df.columns) for x in (F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"z{i}"), F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))]).first()
    return spark.createDataFrame([(c, t, row["n"], row[f"z{i}"] or 0, row[f"d{i}"]) for i, (c, t) in enumerate(df.dtypes)], "column string, type string, n long, nulls long, distinct long")
