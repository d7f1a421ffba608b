"""Calibration measures and calibrators over ``(p double, y int)`` rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def edges(bins: int) -> list[float]:
    """Edges of equal bins, as multiples of the width."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def validated(df: DataFrame) -> DataFrame:
    """The rows, each checked when it is read: 0 <= p <= 1 and y in {0, 1}."""
    p, y = F.col("p").cast("double"), F.col("y").cast("int")
    good = p.between(0, 1) & y.isin(0, 1)
    return df.select(F.when(good, p).otherwise(F.raise_error(F.lit("probabilities must lie in [0, 1] and labels be 0 or 1"))).alias("p"), y.alias("y"), *[c for c in df.columns if c not in ("p", "y")])


def left_closed_bin(p: Column, inner: list[float]) -> Column:
    """Number of inner edges that are not above ``p``."""
    return F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= p))


def right_closed_bin(p: Column, bins: int) -> Column:
    """Number of lower edges below ``p``; null for ``p = 0``, which is in no bin."""
    at = F.size(F.filter(F.array(*map(F.lit, edges(bins)[:-1])), lambda e: e < p))
    return F.when(at > 0, at - 1)


def bin_table(df: DataFrame, bins: int = 10, right_closed: bool = False) -> DataFrame:
    """``(bin, n, mean_p, mean_y)`` of the bins that hold rows."""
    at = right_closed_bin(F.col("p"), bins) if right_closed else left_closed_bin(F.col("p"), edges(bins)[1:-1])
    return df.withColumn("bin", at).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def quantile_bin_table(df: DataFrame, bins: int = 10) -> DataFrame:
    """As :func:`bin_table` with bins of equal weight: distinct percentiles are the edges."""
    shares = [i / bins for i in range(bins + 1)]
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile("p", F.array(*map(F.lit, shares))))).alias("cuts"))
    inner = F.when(F.size("cuts") > 2, F.expr("slice(cuts, 2, size(cuts) - 2)")).otherwise(F.array(*map(F.lit, edges(bins)[1:-1])))
    own = df.crossJoin(F.broadcast(cuts.select(inner.alias("inner"))))  # one row
    return own.withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("p")))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def calibration_errors(table: DataFrame) -> DataFrame:
    """``(ece, mce)`` of a bin table: weighted mean and maximum of the gaps."""
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def class_wise_ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """``(ece)``: mean of one-against-rest errors over ``(probs array<double>, label int)``."""
    rows = df.select(F.posexplode("probs").alias("class", "p"), "label").withColumn("y", (F.col("class") == F.col("label")).cast("int"))
    own = rows.withColumn("bin", left_closed_bin(F.col("p"), edges(bins)[1:-1])).groupBy("class", "bin")
    own = own.agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg(F.col("y").cast("double"))).alias("gap"))
    each = own.groupBy("class").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return each.agg(F.avg("ece").alias("ece"))


def brier(df: DataFrame) -> DataFrame:
    """``(brier, climatology, skill)``: mean squared error, that of the base rate, and 1 minus their ratio."""
    y = F.col("y").cast("double")
    own = df.agg(F.avg(F.pow(F.col("p") - y, F.lit(2.0))).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("climatology"))
    return own.withColumn("skill", 1 - F.try_divide("brier", "climatology"))


def brier_multiclass(df: DataFrame) -> DataFrame:
    """``(brier)``: mean over rows of the squared distance from the one-hot label."""
    parts = F.transform(F.col("probs"), lambda p, i: F.pow(p - (i == F.col("label")).cast("double"), F.lit(2.0)))
    return df.agg(F.avg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).alias("brier"))


def brier_decomposition(df: DataFrame, bins: int = 10) -> DataFrame:
    """``(reliability, resolution, uncertainty)`` over equal bins."""
    base = df.agg(F.avg(F.col("y").cast("double")).alias("base"))
    own = bin_table(df, bins).crossJoin(F.broadcast(base))  # one row
    n = F.sum("n")
    return own.agg(
        (F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("mean_y"), F.lit(2.0))) / n).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("mean_y") - F.col("base"), F.lit(2.0))) / n).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def reliability_diagram(df: DataFrame, bins: int = 15) -> DataFrame:
    """``(bin, center, n, mean_p, mean_y, gap)`` of right-closed bins."""
    center = (F.col("bin") + 0.5) / bins
    return bin_table(df, bins, right_closed=True).select("bin", center.alias("center"), "n", "mean_p", "mean_y", F.abs(F.col("mean_p") - F.col("mean_y")).alias("gap"))


def _logit(p: Column, clip: float = 1e-7) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(p / (1 - p))


def apply_temperature(p: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-_logit(p) / temperature))


def fit_temperature(df: DataFrame, low: float = 0.01, high: float = 1000.0, rounds: int = 6, grid: int = 24) -> float:
    """Temperature of least negative log-likelihood: a grid in log scale, refined; one aggregation a round."""
    z, y = _logit(F.col("p")), F.col("y").cast("double")
    a, b = math.log(low), math.log(high)
    best = 0.0
    for _ in range(rounds):
        points = [a + (b - a) * i / grid for i in range(grid + 1)]
        loss = lambda t: F.avg(F.log1p(F.exp(-F.abs(z / t))) + F.greatest(z / t, F.lit(0.0)) - y * z / t)
        row = df.agg(*[loss(math.exp(t)).alias(f"l{i}") for i, t in enumerate(points)]).first()
        at = min(range(len(points)), key=lambda i: (row[i], i))
        best = points[at]
        a, b = points[max(0, at - 1)], points[min(grid, at + 1)]
    return math.exp(best)


def fit_platt(df: DataFrame, regularization: float = 1.0, steps: int = 30) -> tuple[float, float]:
    """``(slope, intercept)`` of a logistic curve over ``p`` with an L2 penalty on the slope; Newton steps, one aggregation each."""
    slope, intercept = 0.0, 0.0
    p, y = F.col("p"), F.col("y").cast("double")
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(slope * p + intercept)))
        w = q * (1 - q)
        r = df.agg(F.sum((q - y) * p), F.sum(q - y), F.sum(w * p * p), F.sum(w * p), F.sum(w)).first()
        ga, gb, haa, hab, hbb = r[0] + slope / regularization, r[1], r[2] + 1 / regularization, r[3], r[4] + 1e-12
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        slope, intercept = slope - da, intercept - db
        if abs(da) + abs(db) < 1e-10:
            break
    return slope, intercept


def apply_platt(p: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * p + F.lit(intercept))))


def fit_isotonic(df: DataFrame):
    """Isotonic regression of y on p (pool adjacent violators); the model clips outside its range."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(df.select(F.col("p"), F.col("y").cast("double")))


def fold_of(key: Column, folds: int = 10, seed: int = 42) -> Column:
    """Cross-validation fold of a row, from a hash of its key."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 6), 16, 10).cast("long") % folds).cast("int")


def choose_calibrator(df: DataFrame, key: str = "id", folds: int = 10, seed: int = 42, bins: int = 15) -> tuple[str, dict[str, float]]:
    """Calibrator (none, temperature, platt, isotonic) of least mean held-out ECE, and the means."""
    marked = df.withColumn("fold", fold_of(F.col(key), folds, seed))
    sums: dict[str, list[float]] = {"none": [], "temperature": [], "platt": [], "isotonic": []}
    for fold in range(folds):
        train, test = marked.filter(F.col("fold") != fold), marked.filter(F.col("fold") == fold)
        if not test.take(1):
            continue
        temperature, platt = fit_temperature(train), fit_platt(train)
        forms = {
            "none": test.select("p", "y"),
            "temperature": test.select(apply_temperature(F.col("p"), temperature).alias("p"), "y"),
            "platt": test.select(apply_platt(F.col("p"), *platt).alias("p"), "y"),
            "isotonic": fit_isotonic(train).transform(test).select(F.col("calibrated").alias("p"), "y"),
        }
        for name, rows in forms.items():
            value = calibration_errors(bin_table(rows, bins, right_closed=True)).first()["ece"]
            sums[name].append(0.0 if value is None else value)
    means = {name: sum(v) / len(v) for name, v in sums.items() if v}
    return min(means, key=lambda n: (means[n], n)), means


def padded(df: DataFrame) -> DataFrame:
    """The rows and one certain hit ``(1, 1)``, so that a calibrator sees the upper end."""
    return df.select("p", "y").unionByName(df.sparkSession.createDataFrame([(1.0, 1)], "p double, y int"))


def calibrated_report(dev: DataFrame, test: DataFrame, bins: int = 15) -> DataFrame:
    """``(calibrator, ece, mce, brier)`` on test rows of calibrators fitted on development rows."""
    train = padded(dev)
    temperature, platt = fit_temperature(train), fit_platt(train)
    forms = {
        "none": test.select("p", "y"),
        "temperature": test.select(apply_temperature(F.col("p"), temperature).alias("p"), "y"),
        "platt": test.select(apply_platt(F.col("p"), *platt).alias("p"), "y"),
        "isotonic": fit_isotonic(train).transform(test).select(F.col("calibrated").alias("p"), "y"),
    }
    out = None
    for name, rows in forms.items():
        errors = calibration_errors(bin_table(rows, bins, right_closed=True)).crossJoin(brier(rows).select("brier"))  # single rows
        one = errors.select(F.lit(name).alias("calibrator"), "ece", "mce", "brier")
        out = one if out is None else out.unionByName(one)
    return out
