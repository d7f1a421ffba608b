"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows, every path from a
root becomes a conjunctive rule over statistics, an L1-penalised logistic regression
weighs the rules (and drops most of them), and the survivors are compiled into one Spark
column expression over the statistics columns.

The sample is the ``sample_rows`` labelled rows of the smallest id hashes, so its size,
the model and what the driver holds do not grow with the input.

Defined results: null and empty texts have all statistics 0 and get the score that the
rules give them; statistics are of whole texts, however long; labels that are null are not
learned from; of an id that several labelled rows or texts have, the highest label and the
first text by code point are learned; rows are independent, so repeated rows get equal
scores, and so do rows with a null id; ties of statistics fall on the same side of a
threshold; without labelled rows of both classes every score is the
share of label 1 (0.5 without any); an empty table gives an empty table.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import storage

#: Statistics of a text, in the order in which :func:`text_statistics` gives them.
STATISTICS = (
    "n_words", "mean_word", "upper_share", "symbol_share", "digit_share", "stop_share",
    "unique_share", "repeat_share", "top_word_share", "line_repeat_share", "marked_word_share", "space_share",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:'\"-()")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = False
_SYMBOL &= ~_STOP
_SYMBOLS = bytes(np.flatnonzero(_SYMBOL).tolist())
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def text_statistics(text: str | None) -> tuple[float, ...]:
    """Statistics of one whole text; linear in its length."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, letters = len(raw), max(1, len(raw) - int(seen[_BLANK].sum()))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    marked = sum(w[-1] in _SYMBOLS for w in words)
    return (
        float(n),
        letters / n,
        seen[_UPPER].sum() / letters,
        seen[_SYMBOL].sum() / letters,
        seen[_DIGIT].sum() / letters,
        seen[_STOP].sum() / letters,
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values()) / n,
        1.0 - len(set(lines)) / len(lines),
        marked / n,
        1.0 - letters / size,
    )


def add_statistics(docs: DataFrame, id_column: str, text_column: str, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """``(id, carried..., statistics...)`` of each row: one scan, no shuffle."""
    import pyarrow as pa

    names = [id_column, *carried]
    kept = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_column}`").alias("__statistics_of"))

    def run(batches):
        for batch in batches:
            rows = [text_statistics(t) for t in batch.column(len(names)).to_pylist()]
            table = np.array(rows, float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c) for c in table.T)], [*names, *STATISTICS])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], *(StructField(s, DoubleType()) for s in STATISTICS)]))


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, greater?, threshold) conditions, all of which must hold


@dataclass
class RuleModel:
    """Intercept and weighted rules; ``share``: label 1 among the learned rows."""

    intercept: float
    rules: list[tuple[Rule, float]]
    share: float

    def score_column(self) -> Column:
        """The model as a column expression over the statistics columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = None
            for at, greater, threshold in rule:
                value, bound = F.col(STATISTICS[at]), F.lit(float(threshold))
                one = value > bound if greater else value <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        text = lambda rule: " and ".join(f"{STATISTICS[a]} {'>' if g else '<='} {t:.4g}" for a, g, t in rule)
        return [f"{w:+.3f} if {text(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def _fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, greater, threshold in rule:
        out &= x[:, at] > threshold if greater else x[:, at] <= threshold
    return out


def _grow(x, residual, rows, depth, least, bins, path, leaves, paths):
    """One regression tree by best squared-error split over binned thresholds."""
    value = residual[rows].mean()
    best = None
    if depth and len(rows) >= 2 * least:
        total, n = residual[rows].sum(), len(rows)
        for at in range(x.shape[1]):
            edges = bins[at]
            if not len(edges):
                continue
            where = np.searchsorted(edges, x[rows, at], side="left")
            number = np.cumsum(np.bincount(where, minlength=len(edges) + 1))[:-1]
            left = np.cumsum(np.bincount(where, residual[rows], minlength=len(edges) + 1))[:-1]
            fine = (number >= least) & (n - number >= least)
            if fine.any():
                gain = np.where(fine, left**2 / np.maximum(number, 1) + (total - left) ** 2 / np.maximum(n - number, 1), -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (gain[k], at, edges[k])
        if best is not None and best[0] <= total**2 / n + 1e-9:
            best = None
    if best is None:
        leaves.append((rows, value))
        return
    _, at, threshold = best
    low = x[rows, at] <= threshold
    for part, greater in ((rows[low], False), (rows[~low], True)):
        step = (*path, (at, greater, float(threshold)))
        paths.append(step)
        _grow(x, residual, part, depth - 1, least, bins, step, leaves, paths)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4, steps: int = 1500, least: int = 8) -> RuleModel:
    """Trees by boosting, paths as rules, lasso logistic weights by accelerated proximal steps."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 * least or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), [], share)
    bins = [np.unique(np.quantile(column, np.linspace(0, 1, 129)[1:-1])) for column in x.T]
    margin, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        _grow(x, y - p, np.arange(len(y)), depth, least, bins, (), leaves, paths)
        for rows, value in leaves:
            spread = max((p[rows] * (1 - p[rows])).mean(), 1e-3)
            margin[rows] += rate * np.clip(value / spread, -4, 4)
    rules, fires, seen = [], [], set()
    for rule in dict.fromkeys(paths):
        hit = _fires(rule, x)
        key = hit.tobytes()
        if key not in seen and least <= hit.sum() <= len(y) - least:
            seen.add(key)
            rules.append(rule)
            fires.append(hit)
    z = np.array(fires, float).T.reshape(len(y), len(rules))
    scale = z.std(axis=0) + 1e-12
    z = (z - z.mean(axis=0)) / scale
    size = np.linalg.norm(z, 2) ** 2 / (4 * len(y)) + 0.25
    w = v = np.zeros(len(rules))
    b = c = float(np.log(share / (1 - share)))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        new = v - z.T @ (p - y) / len(y) / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_b = c - (p - y).mean() / size
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    z_mean = np.array(fires, float).T.reshape(len(y), len(rules)).mean(axis=0)
    weights = w / scale
    kept = [(r, float(a)) for r, a in zip(rules, weights) if abs(a) > 1e-6]
    return RuleModel(float(b - (weights * z_mean).sum()), kept, share)


def learnable(id_column: str, modulus: int, held: int) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo, is not ``held``."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")), F.lit(modulus)) != held, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample_rows: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(__id, text, label)`` of at most ``sample_rows`` learnable ids, one row each, by smallest id hash.

    The sampled labels are at most ``sample_rows`` small rows, so they may be broadcast.
    """
    picked = labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("__id").isNotNull())
    picked = picked.filter(learnable("__id", modulus, held)).groupBy("__id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_column}`").alias("__id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")).join(F.broadcast(picked), "__id")
    return texts.groupBy("__id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, sample_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> RuleModel:
    """Fit on the bounded sample: its statistics (a few numbers a row) come to the driver."""
    sample = labelled_sample(docs, labels, label, modulus, held, sample_rows, id_column, text_column)
    rows = add_statistics(sample, "__id", "text", ["label"]).orderBy("__id", "label").toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3, modulus: int = 5, held: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of each row."""
    scored = add_statistics(docs, id_column, text_column).withColumn("score", model.score_column())
    return scored.select(id_column, (~learnable(id_column, modulus, held)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever their names, and no shuffle."""
    whole = storage.carried(docs, text=F.col(f"`{text_column}`"))
    return add_statistics(whole, "row", "text").filter(model.score_column() >= threshold).select("row.*")
