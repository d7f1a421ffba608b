"""Text features: n-gram TF-IDF, averaged word vectors, and comparisons of tokenisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def grams(words: Column, longest: int = 2) -> Column:
    """All runs of 1 to ``longest`` words, joined by spaces."""
    out = words
    if longest >= 2:
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        out = F.concat(words, pairs)
    return out


def feature_table(docs: DataFrame, words: Column, size: int = 5_000, max_df: float = 0.95, longest: int = 2, key: str = "doc_id") -> DataFrame:
    """``(term, n, df, idf)`` of the ``size`` most frequent terms that at most ``max_df`` of the texts hold."""
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    own = docs.select(key, F.explode(grams(words, longest)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    found = own.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    found = found.filter(F.col("df") <= max_df * F.col("n_docs")).orderBy(F.desc("n"), "term").limit(size)
    return found.select("term", "n", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tf_idf(docs: DataFrame, words: Column, table: DataFrame, longest: int = 2, key: str = "doc_id") -> DataFrame:
    """``(key, term, weight)`` at unit length a text, over the terms of a feature table."""
    own = docs.select(key, F.explode(grams(words, longest)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = own.join(table.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, key).select(key, "term", (F.col("w") / F.col("size")).alias("weight"))


def average_vectors(docs: DataFrame, words: Column, vectors: DataFrame, dimensions: int, key: str = "doc_id") -> DataFrame:
    """``(key, vector)``: mean of the vectors ``(term, vector)`` of a text's words; texts without any are left out."""
    long = docs.select(key, F.explode(words).alias("term")).join(vectors, "term")
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(dimensions)]
    return long.groupBy(key).agg(F.array(*means).alias("vector"))


def tokenization_difference(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``(n, n_different, mean_a, mean_b)`` of two tokenisations of each row."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.sum((a != b).cast("int")).alias("n_different"),
        F.avg(F.size(a)).alias("mean_a"), F.avg(F.size(b)).alias("mean_b"),
    )


def zip_json_arrays(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(…, position, a, b)``: elements of two JSON array columns by position; the shorter one gives nulls."""
    parse = lambda c: F.from_json(F.col(c), "array<string>")
    rest = [c for c in df.columns if c not in (a, b)]
    zipped = F.arrays_zip(parse(a).alias("x"), parse(b).alias("y"))
    return df.select(*rest, F.posexplode(zipped).alias("position", "p")).select(*rest, "position", F.col("p.x").alias(a), F.col("p.y").alias(b))


def same_text(df: DataFrame, other: DataFrame, text: str = "text", other_text: str = "text") -> DataFrame:
    """Rows whose text, with line breaks as spaces, is among another frame's."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.withColumn("_plain", plain(F.col(text))).join(other.select(plain(F.col(other_text)).alias("_plain")).distinct(), "_plain", "left_semi").drop("_plain")


def log_records(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Distinct groups of a pattern over ``(value)`` lines; lines that do not match are left out."""
    parts = [F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return lines.filter(F.col("value").rlike(pattern)).select(*parts).dropDuplicates()
