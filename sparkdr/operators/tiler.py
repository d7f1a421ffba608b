"""Tiling: documents into overlapping passages that fit a token budget."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import URL, mask_urls, original_id, title_opens, with_title

_TOKEN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")


def pack_segments(lengths: list[int], most: int, first: int | None = None, stride: int = 0) -> list[list[int]]:
    """Intervals ``[first, last]`` of consecutive segments that fit ``most`` (the first one: ``first``).

    After a full interval the next one starts early enough to repeat up to ``stride`` of
    the old one, as far as the segment that did not fit can still follow, but always
    later than the last start.
    """
    if not lengths:
        return []
    out, n = [], len(lengths)
    start, room = 0, most if first is None else first
    while True:
        total, end = lengths[start], start + 1
        while end < n and total + lengths[end] <= room:
            total += lengths[end]
            end += 1
        out.append([start, end - 1])
        if end >= n:
            return out
        room = most
        begin = end
        if end - 1 > start and lengths[end - 1] + lengths[end] <= room:
            repeated, begin = lengths[end - 1], end - 1
            while begin > start + 1 and repeated < stride and repeated + lengths[begin - 1] + lengths[end] <= room:
                begin -= 1
                repeated += lengths[begin]
        start = begin


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences, which together cover the text."""
    cuts = [m.end() for m in _SENTENCE_END.finditer(text)]
    ends = sorted({c for c in cuts if 0 < c < len(text)}) + [len(text)]
    return [(a, b) for a, b in zip([0, *ends], ends) if a < b]


def split_text(text: str, most: int, stride: int, title_length: int = 0, policy: str = "all", opens: bool = False, aligned: bool = True) -> list[tuple[int, int]]:
    """Character ranges of the passages of one text; lengths count white-space tokens.

    Aligned passages consist of whole sentences; a longer sentence is halved at its middle
    token until its parts fit.  Otherwise windows of ``most`` tokens overlap by ``stride``.
    """
    words = [m.span() for m in _TOKEN.finditer(text)]
    if policy == "all":
        most = max(1, most - title_length)
    if len(words) <= most:
        return [(0, len(text))]
    if not aligned:
        step = max(1, most - stride)
        starts = range(0, max(1, len(words) - stride), step)
        return [(words[s][0], words[min(s + most, len(words)) - 1][1]) for s in starts]
    pieces: list[tuple[int, int, int]] = []
    at = 0
    for begin, end in sentence_bounds(text):
        first = at
        while at < len(words) and words[at][0] < end:
            at += 1
        stack = [(first, at, begin, end)]
        while stack:
            a, b, lo, hi = stack.pop()
            if b - a <= most:
                pieces.append((b - a, lo, hi))
            else:
                middle = (a + b) // 2
                cut = words[middle][0]
                stack += [(middle, b, cut, hi), (a, middle, lo, cut)]
    room = most - title_length if policy in ("all", "first") and not opens else most
    return [(pieces[i][1], pieces[j][2]) for i, j in pack_segments([p[0] for p in pieces], most, max(1, room), stride)]


def tile(
    docs: DataFrame, most: int = 512, stride: int = 100, policy: str = "all", aligned: bool = True, mask: bool = True,
    id_column: str = "id", text_column: str = "text", title_column: str | None = "title", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, doc_id, start, end, title, text, tlen, kept...)``: passages of each document.

    A null text gives none.  A document that fits, title included, is one passage with id
    ``<doc>-0-<length>``; passages of others get their character range.  The title goes
    before every passage (``all``), the first (``first``) or none, unless it opens the
    text.  Short documents stay in the JVM; only long ones go through the splitter.
    """
    if policy not in ("all", "first", "none"):
        raise ValueError(f"title policy {policy!r}")
    title = F.coalesce(F.col(title_column), F.lit("")) if title_column else F.lit("")
    text = mask_urls(F.col(text_column)) if mask else F.col(text_column)
    base = docs.filter(F.col(text_column).isNotNull()).select(F.col(id_column).cast("string").alias("doc_id"), title.alias("title"), F.regexp_replace(text, " {2,}", " ").alias("body"), *keep)
    base = base.withColumn("opens", title_opens(F.col("body"), F.col("title")))
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    base = base.withColumn("tlen", count(with_title(F.col("body"), F.col("title"))))
    fits = F.col("tlen") <= most

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(bodies, titles, opens):
        return pd.Series([[{"start": a, "end": b} for a, b in split_text(t, most, stride, len(_TOKEN.findall(h)), policy, bool(o), aligned)] for t, h, o in zip(bodies, titles, opens)])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("body").alias("end")))
    short = base.filter(fits).withColumn("piece", F.explode(whole)).withColumn("index", F.lit(0))
    long = base.filter(~fits).withColumn("pieces", ranges("body", "title", "opens")).select("*", F.posexplode("pieces").alias("index", "piece")).drop("pieces")
    both = short.unionByName(long.select(short.columns))
    part = F.substring(F.col("body"), F.col("piece.start") + 1, F.col("piece.end") - F.col("piece.start"))
    first = F.lit(policy in ("all", "first")) & ~F.col("opens")
    headed = F.when(F.col("index") == 0, first).otherwise(F.lit(policy == "all") & (F.col("title") != "")) & (F.col("title") != "")
    out = F.when(headed, F.concat(F.col("title"), F.lit("\n"), part)).otherwise(part)
    tile_id = F.concat_ws("-", "doc_id", F.col("piece.start").cast("string"), F.col("piece.end").cast("string"))
    return both.select(tile_id.alias("id"), "doc_id", F.col("piece.start").alias("start"), F.col("piece.end").alias("end"), "title", out.alias("text"), count(out).alias("tlen"), *keep)


def nested_passages(docs: DataFrame, passages: str, id_column: str = "id", text: str = "text", passage_id: str = "id") -> DataFrame:
    """``(id, doc_id, text)``: every element of an array of passage structs, with id ``<doc>-<passage>``."""
    one = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.explode(passages).alias("p"))
    return one.select(F.concat_ws("-", "doc_id", F.col("p").getField(passage_id).cast("string")).alias("id"), "doc_id", F.col("p").getField(text).alias("text"))


def token_windows(df: DataFrame, words: str, size: int, stride: int) -> DataFrame:
    """``(…, window, tokens)``: windows of ``size`` tokens of an array column that overlap by ``stride``, by built-in functions."""
    step = max(1, size - stride)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - stride - 1), F.lit(step)))
    return df.select("*", F.posexplode(starts).alias("window", "_at")).withColumn("tokens", F.slice(F.col(words), F.col("_at") + 1, F.lit(size))).drop("_at")


def char_windows(df: DataFrame, text: str, size: int, stride: int) -> DataFrame:
    """``(…, window, start, piece)``: windows of ``size`` characters that overlap by ``stride``; null and empty texts have none."""
    step = max(1, size - stride)
    length = F.char_length(text)
    starts = F.when(length > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), length - stride - 1), F.lit(step)))
    return df.select("*", F.posexplode(starts).alias("window", "start")).withColumn("piece", F.substring(F.col(text), F.col("start") + 1, F.lit(size)))


__all__ = ["URL", "char_windows", "nested_passages", "original_id", "pack_segments", "sentence_bounds", "split_text", "tile", "token_windows"]
