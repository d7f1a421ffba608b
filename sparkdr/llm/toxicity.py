"""Toxicity by maximum-scoring segment search.

Tokens (words, backing off to their leading letters, longest first) get log-odds between toxic
and clean labelled texts under an informative Dirichlet prior.  Less a drift, these are
segment scores whose mean over clean text is negative, so the linear-time scan for all
maximal scoring segments finds passages that stand out.  Segment scores are normalised
by extreme-value statistics: ``lambda`` solves ``sum p exp(lambda s) = 1`` over clean
tokens and ``K`` comes from the highest segments of clean texts; a segment of score S in
a text of n tokens has the expected number ``K n exp(-lambda S)`` by chance.  A text's
evidence is the sum of ``-log`` of that over its significant segments, and a logistic
curve turns evidence into a score.

Everything is learned from a bounded sample (``sample_rows``) of labelled rows; the table
holds every token of it whose log-odds are ``least_z`` standard deviations from 0.

Defined results: null, empty and token-free texts have no segments and get the lowest
score; whole texts are scanned, however long; repeated rows get equal scores, and rows with
a null id are scored as others; tokens of equal frequency in both classes count only as
drift; other columns are ignored, whatever their names; without labels of both classes all scores are the
share of label 1; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import storage
from .rules import labelled_sample, learnable

_WORDS = re.compile(r"[^\W_]+").findall
#: Numbers of leading letters of a longer word that make its back-off tokens.
STEMS = (8, 7, 6, 5, 4, 3)
_REMEMBERED = 300_000


def tokens_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time.

    Runs of equal sign are summed first; the scan keeps a list of candidate segments with
    the running totals before and after each, and merges a new positive run leftwards as
    long as an earlier candidate starts lower and ends lower than the new one.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    jumps = np.flatnonzero(np.diff(at) > 1)
    firsts = at[np.concatenate(([0], jumps + 1))]
    lasts = at[np.concatenate((jumps, [len(at) - 1]))] + 1
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest earlier candidate with a lower start
    for start, end in zip(firsts.tolist(), lasts.tolist()):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


@dataclass
class ToxicModel:
    """Token log-odds, extreme-value parameters and the final logistic curve."""

    odds: dict[str, float]
    drift: float = 0.2
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -2.0
    level: float = 0.05
    share: float = 0.5
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"} | {"_known": {}}

    def scores(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > _REMEMBERED:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), float, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    value = next((self.odds[t] for t in (w, *stems(w)) if t in self.odds), 0.0)
                    known[w] = value - self.drift
            return np.fromiter(map(known.__getitem__, words), float, len(words))

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens, and significant segments (start, end, score, evidence)."""
        words = tokens_of(text)
        if not words:
            return 0, []
        segments = maximal_segments(self.scores(words))
        noise = self.log_k + math.log(len(words))
        out = [(s, e, v, self.decay * v - noise) for s, e, v in segments]
        return len(words), [x for x in out if x[3] > -math.log(self.level)]

    def evidence(self, text: str | None) -> float:
        return sum(x[3] for x in self.passages(text)[1])

    def score(self, evidence: float) -> float:
        if not self.odds:
            return self.share
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.offset))))


def _token_counts(sample: DataFrame) -> DataFrame:
    """``(token, toxic, clean)``: texts of each class that hold the token, per sample row once."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(tokens_of(text))
                for token in words.union(*map(stems, words)):
                    counts.setdefault(token, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
                ["token", "toxic", "clean"],
            )

    parts = sample.select("text", "label").mapInArrow(run, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, sample_rows: int = 20_000,
    prior: float = 5_000.0, least_z: float = 2.5, drift: float = 0.2, id_column: str = "doc_id", text_column: str = "text",
) -> ToxicModel:
    """Learn token log-odds, extreme-value parameters and the curve from the bounded sample."""
    sample = storage.materialize(labelled_sample(docs, labels, label, modulus, held, sample_rows, id_column, text_column), "toxicity-sample")
    counts = _token_counts(sample)
    size = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n_toxic, n_clean = float(size["toxic"] or 0), float(size["clean"] or 0)
    if not n_toxic or not n_clean:
        share = sample.agg(F.avg("label")).first()[0]
        return ToxicModel({}, share=0.5 if share is None else float(share))
    pseudo = F.lit(prior) * (F.col("toxic") + F.col("clean")) / F.lit(n_toxic + n_clean) + F.lit(0.01)
    odds = lambda c, n: F.log((F.col(c) + pseudo) / (F.lit(n + prior) - F.col(c) - pseudo))
    spread = F.sqrt(1 / (F.col("toxic") + pseudo) + 1 / (F.col("clean") + pseudo))
    table = counts.withColumn("odds", odds("toxic", n_toxic) - odds("clean", n_clean)).withColumn("z", F.col("odds") / spread)
    # the tokens of a bounded sample, of which few stand out
    table = table.filter(F.abs("z") >= least_z).orderBy("token")
    model = ToxicModel({r["token"]: float(r["odds"]) for r in table.select("token", "odds").collect()}, drift=drift)

    rows = _segment_statistics(sample, model).toPandas()
    rows = rows.sort_values(["id", "label", "best"], kind="stable")
    clean = rows[(rows["label"] == 0) & (rows["n"] > 0)]
    # lambda: the positive root of the mean of exp(lambda s) over clean tokens, from a histogram of positive scores
    positives: dict[float, float] = {}
    for held in clean["positives"]:
        for x in held:
            positives[x["score"]] = positives.get(x["score"], 0) + x["n"]
    n = float(clean["n"].sum()) or 1.0
    values, weights = np.array(list(positives) or [1.0]), np.array(list(positives.values()) or [0.5]) / n
    rest, mean_rest = 1 - weights.sum(), -model.drift
    excess = lambda t: (weights * np.exp(np.minimum(t * values, 600))).sum() + rest * math.exp(t * mean_rest) - 1
    low, high = 1e-3, 1e-2
    while excess(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    model.decay = high
    best = clean[clean["best"] > 0]
    if len(best):
        model.log_k = float((model.decay * best["best"] - 0.5772 - np.log(best["n"])).mean())
    # evidence of each sample row, and the curve by Newton steps
    found = _segment_statistics(sample, model).toPandas().sort_values(["id", "label", "evidence"], kind="stable")
    x, y = np.log1p(found["evidence"].to_numpy(float)), found["label"].to_numpy(float)
    model.slope, model.offset = _logistic(x, y)
    model.share = float(y.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def _segment_statistics(sample: DataFrame, model: ToxicModel) -> DataFrame:
    """``(id, label, n, best, evidence, positives)`` of each sample row; positives: its positive scores and their counts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = tokens_of(text)
                scores = model.scores(words) if words else np.zeros(0)
                best = max((s[2] for s in maximal_segments(scores)), default=0.0)
                values, counts = np.unique(np.round(scores[scores > 0], 2), return_counts=True)
                out.append((len(words), best, model.evidence(text), [{"score": float(v), "n": int(c)} for v, c in zip(values, counts)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.struct([("score", pa.float64()), ("n", pa.int64())])))],
                ["id", "label", "n", "best", "evidence", "positives"],
            )

    kept = sample.select(F.col("__id").alias("id"), "text", "label")
    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, label int, n long, best double, evidence double, positives array<struct<score:double,n:long>>")


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, modulus: int = 4, held: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted, n_passages)`` of each row: one scan, no shuffle."""
    import pyarrow as pa

    kept = docs.select(F.col(id_column), F.col(text_column).alias("__text"))
    id_type = dict(kept.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            found = [model.passages(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(sum(x[3] for x in p)) for p in found], pa.float64()), pa.array([len(p) for p in found], pa.int64())],
                [id_column, "score", "n_passages"],
            )

    scored = kept.mapInArrow(run, f"`{id_column}` {id_type}, score double, n_passages long")
    return scored.select(id_column, (~learnable(id_column, modulus, held)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def toxic_passages(docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, start, end, score, evidence)``: every significant passage, as token positions."""
    import pyarrow as pa

    kept = docs.select(F.col(id_column), F.col(text_column).alias("__text"))
    id_type = dict(kept.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *p) for i, t in zip(ids, batch.column(1).to_pylist()) for p in model.passages(t)[1]]
            columns = list(zip(*rows)) or [[]] * 5
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [id_column, "start", "end", "score", "evidence"])

    return kept.mapInArrow(run, f"`{id_column}` {id_type}, start long, end long, score double, evidence double")
