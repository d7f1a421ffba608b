"""Vector functions over array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column, drop_zero: bool = False) -> Column:
    """Unit length; a zero vector stays, or is null with ``drop_zero``."""
    n = norm(a)
    scaled = F.transform(a, lambda x: x.cast("double") / n)
    return F.when(n > 0, scaled).otherwise(F.lit(None) if drop_zero else F.transform(a, lambda x: x.cast("double")))


def prefix(a: Column, size: int) -> Column:
    """The first ``size`` dimensions at unit length (a zero prefix stays)."""
    return normalized(F.slice(a, 1, size))


def permuted(a: Column, order) -> Column:
    """Dimensions in a given order."""
    return F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(a, i))


def quantized(weight: Column, scale: float) -> Column:
    return (F.lit(scale) * weight).cast("int")


def agreement(a: Column, b: Column) -> Column:
    """Cosine, mean squared and mean absolute difference of two vectors."""
    n = F.size(a)
    differences = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.struct(
        cosine(a, b).alias("cosine"),
        (F.aggregate(differences, F.lit(0.0), lambda s, d: s + d * d) / n).alias("mse"),
        (F.aggregate(differences, F.lit(0.0), lambda s, d: s + F.abs(d)) / n).alias("mae"),
    )


def variance_order(df: DataFrame, vector: str) -> DataFrame:
    """``(dim, variance, place)``: dimensions by falling sample variance, 0-based; one row a dimension."""
    cells = df.select(F.posexplode(vector).alias("dim", "x"))
    found = cells.groupBy("dim").agg(F.var_samp(F.col("x").cast("double")).alias("variance"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("variance"), "dim")) - 1)


def anisotropy(df: DataFrame, vector: str) -> DataFrame:
    """``(n, mean_cosine)`` over all pairs of rows, from the squared length of the sum of unit vectors: no pairs are formed."""
    cells = df.select(F.posexplode(normalized(F.col(vector))).alias("dim", "x"))
    sums = cells.groupBy("dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return sums.agg(n.alias("n"), ((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cosine"))
