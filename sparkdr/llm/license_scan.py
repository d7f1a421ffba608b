"""Licence scan: Dice coefficient of word bigrams between text units and templates.

Units are the lines of a text and, where it has several, the whole text.  Normalised
(A-Z lower-cased, runs of anything but letters a-z and digits as one space), a unit and a
template are sets of distinct word bigrams; they match when ``2 |A & B| / (|A| + |B|)``
is at least ``threshold``.

Runs are stretches of consecutive words, over any line breaks, of at most ``(2 - t) / t``
times a template's bigrams; they are compared with the templates and with whole licence
texts.  A run begins and ends where bigrams of the template do: longer ones only lower
the coefficient.  Runs that hold words of a matching unit are left out, of those that
overlap the highest coefficient stays, then the longest, so wrapped and embedded notices count once.

Pruning loses nothing: a match needs ``|B| t / (2 - t) <= |A| <= |B| (2 - t) / t``, which
bounds the units worth comparing with any template and, in the join, the templates worth
comparing with a unit.  It also needs ``|B| t / (2 - t)`` shared bigrams, so a unit holds
one of a few *anchor* words that occur in more than the other bigrams of the template.

Only DataFrame functions are used.  The templates are a table of fixed, small size (their
bigrams are broadcast); nothing of a text is gathered beyond its own units.

Defined results: null and empty texts and units of fewer than two words match nothing;
of templates that match a unit the highest coefficient wins, then the first name; rows
that repeat an id share their results; rows with a null id match nothing; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from . import storage
from .license_templates import FULL_TEXTS, TEMPLATES


def normalize(text: str) -> list[str]:
    """Normalised words of a template: as :func:`normalized` makes them of a column."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def normalized(text: Column) -> Column:
    """Normalised text; line breaks stay."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(lowered, r"[^a-z0-9\n]+", " ")


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def least_shared(size: int, threshold: float) -> int:
    """Fewest bigrams of a template of ``size`` bigrams that any match shares."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def anchors(templates, threshold: float) -> list[str]:
    """Words of which every match of any template holds at least one."""
    chosen: list[str] = []
    for _, text in templates:
        left = bigrams(normalize(text))
        most_left = least_shared(len(left), threshold) - 1
        left = {b for b in left if not set(b.split()) & set(chosen)}
        while len(left) > most_left:
            words = Counter(w for b in left for w in set(b.split()))
            best = max(words, key=lambda w: (len(w) > 4, words[w], w))
            chosen.append(best)
            left = {b for b in left if best not in b.split()}
    return sorted(set(chosen))


def scan(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, position, license, dice)`` of every matching unit; position -1 is the whole text."""
    return _matching_units(docs, threshold, templates, id_column, text_column).drop("key")


def _matching_units(docs: DataFrame, threshold: float, templates, id_column: str, text_column: str) -> DataFrame:
    """As :func:`scan`, with the ``key`` of each unit's bigrams."""
    spark = docs.sparkSession
    sets = [(name, bigrams(normalize(text))) for name, text in templates]
    table = spark.createDataFrame([(n, len(s), b) for n, s in sets for b in sorted(s)], "license string, size int, bigram string")
    low = min(math.ceil(len(s) * threshold / (2 - threshold) - 1e-9) for _, s in sets)
    high = max(math.floor(len(s) * (2 - threshold) / threshold + 1e-9) for _, s in sets)
    words = "|".join(anchors(templates, threshold))

    # the raw text is searched once, A-Z and a-z alike; only texts with an anchor are normalised
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("raw")).filter(F.col("raw").rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"))
    body = texts.select("id", normalized(F.col("raw")).alias("body"))
    lines = F.transform(F.split("body", "\n"), lambda line, at: F.struct(at.alias("position"), line.alias("unit")))
    whole = F.when(F.instr("body", "\n") > 0, F.array(F.struct(F.lit(-1).alias("position"), F.translate("body", "\n", " ").alias("unit"))))
    units = body.select("id", F.explode(F.concat(lines, F.coalesce(whole, F.array().cast("array<struct<position:int,unit:string>>")))).alias("u"))
    units = units.select("id", "u.position", "u.unit").filter(F.col("unit").rlike(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])"))
    # a unit of more distinct bigrams than any match may have has at least as many words
    units = units.select("id", "position", F.split(F.trim(F.regexp_replace("unit", " +", " ")), " ").alias("words"))
    units = units.filter(F.size("words") > low)
    pairs = F.zip_with(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"), lambda a, b: F.concat_ws(" ", a, b))
    units = units.select("id", "position", F.array_distinct(pairs).alias("have")).withColumn("n", F.size("have")).filter(F.col("n").between(low, high))
    # rows may repeat an id: the unit's content is part of its key
    units = units.withColumn("key", F.xxhash64("have"))
    found = units.select("id", "position", "key", "n", F.explode("have").alias("bigram")).join(F.broadcast(table), "bigram")
    t = F.lit(threshold)
    found = found.filter((F.col("n") >= F.col("size") * t / (2 - t) - 1e-9) & (F.col("n") <= F.col("size") * (2 - t) / t + 1e-9))
    shared = found.groupBy("id", "position", "key", "n", "license", "size").agg(F.count_distinct("bigram").alias("shared"))
    dice = F.round(F.lit(2.0) * F.col("shared") / (F.col("n") + F.col("size")), 9)
    shared = shared.withColumn("dice", dice).filter(F.col("dice") >= t)
    best = shared.groupBy("id", "position", "key").agg(F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"), F.max("dice").alias("dice"))
    return best.select(F.col("id").alias(id_column), "position", "license", "dice", "key")


def _bigrams(words: Column) -> Column:
    """Bigrams of an array of words, in order; none of fewer than two."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def anchored(docs: DataFrame, threshold: float, templates, text_column: str) -> DataFrame:
    """Rows whose text holds an anchor word of any template."""
    by_letter: dict[str, list[str]] = {}
    for word in anchors(templates, threshold):
        by_letter.setdefault(word[0], []).append(word[1:])
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items())
    return docs.filter(F.col(text_column).rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"))


def scan_runs(docs: DataFrame, units: DataFrame, threshold: float = 0.8, templates=TEMPLATES + FULL_TEXTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, first, last, license, dice)`` of every matching run outside ``units``, by the numbers of its words.

    ``units`` are the matching units with their keys.
    """
    table = []
    for name, text in templates:
        words = normalize(text)
        own = bigrams(words)
        longest = math.floor((len(words) - 1) * (2 - threshold) / threshold + 1e-9)
        table += [(name, len(own), longest, least_shared(len(own), threshold), b) for b in sorted(own)]
    table = docs.sparkSession.createDataFrame(table, "license string, size int, longest int, least int, bigram string")
    body = normalized(F.col(text_column))
    texts = docs.select(F.col(id_column).alias("id"), body.alias("body"), F.xxhash64(body).alias("text_key"))

    def laid_out(rows: DataFrame) -> DataFrame:
        """``body`` as the words of its lines and the bigrams of all."""
        rows = rows.withColumn("lines", F.transform(F.split("body", "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != ""))).drop("body")
        return rows.withColumn("pairs", _bigrams(F.flatten("lines")))

    hits = laid_out(texts).select("id", "text_key", F.posexplode("pairs").alias("at", "bigram")).join(F.broadcast(table), "bigram")
    # rows may repeat an id and a text: sets, not lists
    hits = hits.groupBy("id", "text_key", "license", "size", "longest", "least").agg(F.array_sort(F.collect_set("at")).alias("at"), F.size(F.collect_set("bigram")).alias("shared"))
    hits = hits.filter(F.col("shared") >= F.col("least")).drop("shared")
    # stretches of adjacent hits; a run goes from the first of one to the last of one
    at = F.col("at")
    edge = lambda other: F.filter(F.transform(at, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: F.coalesce(F.get(at, x["k"] + other) != x["p"] + other, F.lit(True)))
    hits = hits.withColumn("starts", edge(-1)).withColumn("ends", edge(1))
    ends = lambda s: F.filter("ends", lambda e: (e["k"] - s["k"] + 1 >= F.col("least")) & (e["p"] - s["p"] < F.col("longest")))
    hits = hits.withColumn("runs", F.flatten(F.transform("starts", lambda s: F.transform(ends(s), lambda e: F.struct(s["p"].alias("a"), e["p"].alias("z"))))))
    hits = hits.filter(F.size("runs") > 0).drop("starts", "ends")

    # what is known of a text meets it before its words are laid out, once for all licences: only bodies with a run are shuffled
    taken = units.groupBy(F.col(id_column).alias("id")).agg(F.collect_set(F.struct("position", "key")).alias("taken"))
    hits = hits.groupBy("id", "text_key").agg(F.collect_list(F.struct("license", "size", "at", "runs")).alias("hits"))
    hits = storage.materialize(hits.join(taken, "id", "left"), "licence-hits")
    bodies = texts.join(storage.sized(hits.select("id", "text_key")), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    found = laid_out(hits.join(bodies, ["id", "text_key"]))
    own = lambda r: F.size(F.array_distinct(F.slice("pairs", r["a"] + 1, r["z"] - r["a"] + 1)))
    shared = lambda h, r: F.size(F.array_distinct(F.transform(F.filter(h["at"], lambda p: p.between(r["a"], r["z"])), lambda p: F.get("pairs", p))))
    dice = lambda h, r: F.round(F.lit(2.0) * shared(h, r) / (own(r) + h["size"]), 9)
    scored = lambda h: F.transform(h["runs"], lambda r: F.struct((-dice(h, r)).alias("minus_dice"), (r["a"] - r["z"]).alias("minus_words"), h["license"].alias("license"), r["a"].alias("first"), (r["z"] + 1).alias("last")))
    scored = F.flatten(F.transform("hits", scored))
    found = found.withColumn("runs", F.filter(scored, lambda r: r["minus_dice"] <= -F.lit(threshold))).filter(F.size("runs") > 0)

    found = found.withColumn("line_of", F.flatten(F.transform("lines", lambda words, k: F.array_repeat(k, F.size(words)))))
    key = lambda pairs: F.xxhash64(F.array_distinct(pairs))
    whole = lambda u: (u["position"] == -1) & (u["key"] == key(F.col("pairs")))
    line = lambda u, r: u["position"].between(F.get("line_of", r["first"]), F.get("line_of", r["last"])) & (u["key"] == key(_bigrams(F.get("lines", u["position"]))))
    free = lambda r: F.coalesce(~F.exists("taken", lambda u: whole(u) | line(u, r)), F.lit(True))

    # runs that overlap: the best first, the longest of equal ones
    found = found.select("id", F.array_sort(F.filter("runs", free)).alias("runs"))
    none = F.slice("runs", 1, 0)
    apart = lambda kept, r: F.forall(kept, lambda k: (k["last"] < r["first"]) | (r["last"] < k["first"]))
    kept = F.aggregate("runs", none, lambda kept, r: F.when(apart(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    found = found.select("id", F.explode(kept).alias("r")).select(F.col("id").alias(id_column), "r.first", "r.last", "r.license", (-F.col("r.minus_dice")).alias("dice"))
    return found


def summarize(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_matches, license, dice)`` of every row: its matching units and runs and the best one (null without any)."""
    every = tuple(templates) + FULL_TEXTS
    texts = storage.materialize(anchored(docs.select(id_column, text_column), threshold, every, text_column), "licence-texts")
    units = _matching_units(texts, threshold, templates, id_column, text_column)
    runs = scan_runs(texts, units, threshold, every, id_column, text_column)
    units = units.select(id_column, "license", "dice").unionByName(runs.select(id_column, "license", "dice"))
    order = F.struct(-F.col("dice"), "license")
    best = units.groupBy(id_column).agg(F.count(F.lit(1)).alias("n_matches"), F.min_by("license", order).alias("license"), F.max("dice").alias("dice"))
    joined = docs.select(F.col(id_column)).join(best, id_column, "left")
    return joined.select(id_column, F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), "license", "dice")


def summary_sql(threshold: float = 0.8, templates=TEMPLATES) -> str:
    """DuckDB SQL of :func:`summarize` over ``documents``, without any pruning.

    It knows lines and whole texts: where a run outside them matches, :func:`summarize` counts more.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(' '.join(normalize(t)))})" for n, t in templates)
    return f"""
        WITH templates AS (
            SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
            FROM (SELECT name, string_split(body, ' ') AS w FROM (VALUES {values}) AS v(name, body))
        ), texts AS (
            SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9\\n]+', ' ', 'g') AS body
            FROM documents
        ), lines AS (
            SELECT doc_id, string_split(body, chr(10)) AS parts FROM texts
        ), units AS (
            SELECT doc_id, unnest(range(len(parts))) AS position, unnest(parts) AS unit FROM lines
            UNION ALL
            SELECT doc_id, -1, replace(body, chr(10), ' ') FROM texts WHERE contains(body, chr(10))
        ), words AS (
            SELECT doc_id, position, string_split(trim(regexp_replace(unit, ' +', ' ', 'g')), ' ') AS w FROM units
        ), sets AS (
            SELECT doc_id, position, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
            FROM words WHERE len(w) >= 2
        ), scored AS (
            SELECT doc_id, position, name, round(2.0 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)), 9) AS dice
            FROM sets s, templates t
            WHERE len(s.b) BETWEEN {threshold} / (2 - {threshold}) * len(t.b) - 1e-9 AND (2 - {threshold}) / {threshold} * len(t.b) + 1e-9
        ), matched AS (
            SELECT doc_id, position, arg_min(name, (-dice, name)) AS license, max(dice) AS dice
            FROM scored WHERE dice >= {threshold} GROUP BY doc_id, position
        ), best AS (
            SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
            FROM matched GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(b.n_matches, 0) AS n_matches, b.license, b.dice
        FROM documents d LEFT JOIN best b USING (doc_id)
    """
