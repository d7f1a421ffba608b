"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is a stream of words in a seeded order of its documents, cut into blocks of
equal token counts.  Seats (blocks) go to sources, and within a source to its shards, by
the highest quotients ``weight / (2 * seats + 1)``.  The quotients are not enumerated:
rounding ``weight / divisor`` gives a state that the sequence of highest quotients passes
through, and only the few seats by which the rounded sum misses the total are awarded or
withdrawn one by one.  Each shard then takes its quota: its whole stream as often as that
asks, and for the rest the blocks that a seeded permutation of the shard's blocks puts
first (``(a * block + c) mod blocks``, ``a`` a prime that does not divide their number).

Only DataFrame operations are used.  Sources are dealt into shards by a hash of the id,
so a source with any share of all rows is spread over many tasks; the number of shards
is bounded by ``max_shards`` plus the number of sources, whatever the input.

Defined results: a null text has size 0; the null source is a source of its own, last in
order; rows of a shard are ordered by hash, id, size and text hash, so reruns agree; rows
that repeat an id or have none are rows of their own; an empty table gives an empty table;
a corpus without words takes nothing; a very long text may hold blocks of several quotas'
worth, and each is taken or left; other columns are ignored, whatever their names.

Sources meet in one task (about 60 bytes each); rows and shards of a source do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import storage

_SPACE = r"[\x20\x09-\x0D]"
#: Fixed primes, of which a shard's permutation takes one.
_PRIMES = (374_761_393, 668_265_263, 2_246_822_519, 2_654_435_761, 3_266_489_917)


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null: 0."""
    pieces = F.size(F.split(text, _SPACE + "+"))
    outer = text.rlike("^" + _SPACE).cast("int") + text.rlike(_SPACE + r"\z").cast("int")
    return F.coalesce(F.when(text == "", F.lit(0)).otherwise(pieces - outer), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target``: shares of the total by ``weight``, none above ``cap`` times ``source_size``.

    Sources in order of ``cap * size / weight`` fill up first; ``level`` is what a unit of
    weight would get if exactly the sources before this one were full.
    """
    everything = Window.partitionBy("all")
    order = everything.orderBy("ratio", "sn", "sv")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    limit = F.col("source_size") * F.lit(cap)
    out = sources.withColumn("ratio", limit / F.col("weight"))
    spare = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    out = out.withColumn("level", spare / F.sum("weight").over(onwards))
    out = out.withColumn("unit", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    full = F.col("ratio") <= F.col("level")
    return out.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * F.col("unit")).cast("double")).drop("ratio", "level", "unit")


def apportion(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the Sainte-Laguë share of each party (``key``) in its group's ``seats``."""
    own = Window.partitionBy(*group)
    w = F.col(weight).cast("double")
    share = F.coalesce(F.try_divide(w, F.sum(w).over(own)), F.lit(0.0))
    base = parties.withColumn("_share", share).withColumn("_base", F.floor(F.col("_share") * F.col(seats) + 0.5))
    base = base.withColumn("_miss", F.when(F.sum("_share").over(own) > 0, F.col(seats) - F.sum("_base").over(own)).otherwise(F.lit(0)))
    # enough of each party's next (or last) quotients to settle the missing seats
    depth = F.ceil(F.col("_share") * F.abs("_miss") * 2) + 1
    steps = F.explode(F.sequence(F.lit(0).cast("long"), depth.cast("long")))
    need = base.filter("_miss <> 0").select(*group, *[k for k in key if k not in group], "_base", "_miss", w.alias("_w"), steps.alias("_j"))
    up = F.col("_miss") > 0
    divisor = F.when(up, 2 * (F.col("_base") + F.col("_j")) + 1).otherwise(2 * (F.col("_base") - F.col("_j")) - 1)
    need = need.withColumn("_q", F.try_divide(F.col("_w"), divisor)).filter((F.col("_w") > 0) & (up | (F.col("_j") < F.col("_base"))))
    turn = Window.partitionBy(*group).orderBy(F.when(F.col("_miss") > 0, -F.col("_q")).otherwise(F.col("_q")), *key, "_j")
    won = need.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= F.abs("_miss"))
    both = list(dict.fromkeys([*group, *key]))
    won = won.groupBy(*both).agg(F.sum(F.signum("_miss")).cast("long").alias("_more"))
    joined = base.join(won, both, "left")
    return joined.withColumn(out, (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("long")).drop("_share", "_base", "_miss", "_more")


def _plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cycle: int = 3,
    cap: int = 3,
    block_words: int = 4,
    shard_words: int = 32_768,
    max_shards: int = 65_536,
    seed: int = 17,
) -> DataFrame:
    """``(id, sn, sv, hash, size, source_size, target, taken)`` of every row: its source (null flag, name) and text hash."""
    text, source = F.col(f"`{text_column}`"), F.col(f"`{source_column}`")
    sized = docs.select(F.col(f"`{id_column}`").alias("id"), *_source(source), F.xxhash64(text).alias("hash"), word_count(text).alias("size"))
    sized = storage.materialize(sized, "sizes")
    sources = sized.groupBy("sn", "sv").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0))
    place = F.row_number().over(Window.partitionBy("all").orderBy("sn", "sv"))
    sources = water_fill(sources.withColumn("weight", (place - 1) % cycle + 1), cap)
    total = F.sum("source_size").over(Window.partitionBy("all"))
    sources = sources.withColumn("seats", F.round(total / block_words).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(shard_words), total / max_shards))).cast("long"))
    sources = storage.materialize(apportion(sources, ["all"], ["sn", "sv"], "target", "seats", "quota").select("sn", "sv", "source_size", "target", "shards", "quota"), "sources")

    dealt = sized.join(sources.select("sn", "sv", "shards"), ["sn", "sv"]).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards")))
    shards = dealt.groupBy("sn", "sv", "shard").agg(F.sum("size").alias("shard_size")).join(sources, ["sn", "sv"])
    shards = apportion(shards, ["sn", "sv"], ["shard"], "shard_size", "quota", "blocks")
    words = F.col("blocks") * block_words
    passes = F.coalesce(F.floor(F.try_divide(words, F.col("shard_size"))), F.lit(0))
    rest = words - passes * F.col("shard_size")
    whole_blocks = F.floor(F.col("shard_size") / block_words)
    drawn = F.xxhash64("sv", "shard", F.lit(seed))
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in _PRIMES]), (F.pmod(drawn, F.lit(len(_PRIMES))) + 1).cast("int"))
    shards = shards.select(
        "sn", "sv", "shard", "shard_size", "source_size", "target", passes.alias("passes"), whole_blocks.alias("whole"),
        F.floor(rest / block_words).alias("picked"), (rest % block_words).alias("more"),
        prime.alias("a"), F.pmod(F.xxhash64(drawn), F.greatest(F.lit(1), whole_blocks)).alias("c"),
    )
    shards = storage.materialize(shards, "shards")

    stream = Window.partitionBy("sn", "sv", "shard").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size", "hash")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, ["sn", "sv", "shard"])
    begin, end = F.col("end") - F.col("size"), F.col("end")

    def words_of(block: Column) -> Column:
        """Words of the row in a block: whole blocks that come first in the permutation, and some words of the next (the short last block comes last)."""
        turn = F.when(block < F.col("whole"), F.pmod(F.col("a") * block + F.col("c"), F.greatest(F.lit(1), F.col("whole")))).otherwise(block)
        take = F.when(turn < F.col("picked"), F.lit(block_words)).when(turn == F.col("picked"), F.col("more")).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(end, block * block_words + take) - F.greatest(begin, block * block_words))

    blocks = F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))
    part = F.when((F.col("size") > 0) & (F.col("picked") + F.col("more") > 0), F.aggregate(blocks, F.lit(0).cast("long"), lambda total, block: total + words_of(block))).otherwise(F.lit(0))
    taken = F.least(F.col("size") * cap, F.col("passes") * F.col("size") + part)
    return placed.select("id", "sn", "sv", "hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _source(source: Column) -> tuple[Column, Column]:
    return source.isNull().alias("sn"), F.coalesce(source.cast("string"), F.lit("")).alias("sv")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row; options: those of the plan."""
    plan = _plan(docs, id_column, text_column, source_column, **options)
    return plan.select(F.col("id").alias(id_column), "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row as often as its taken words make whole copies, rounded.

    Rows without words weigh nothing and stay once.  Rows that repeat id, source and text
    get equal numbers of copies; all columns stay, whatever their names.
    """
    key = ["sn", "sv", "hash"]
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.try_divide(F.col("taken"), F.col("size"))).cast("int"))
    plan = _plan(docs, id_column, text_column, source_column, **options).select(F.col("id").alias("mixed_id"), *[F.col(c).alias(f"mixed_{c}") for c in key], copies.alias("copies"))
    plan = plan.groupBy("mixed_id", *[f"mixed_{c}" for c in key]).agg(F.max("copies").alias("copies")).filter("copies > 0")
    sn, sv = _source(F.col(f"`{source_column}`"))
    whole = storage.carried(docs, id=F.col(f"`{id_column}`"), sn=sn, sv=sv, hash=F.xxhash64(F.col(f"`{text_column}`")))
    same = F.col("id").eqNullSafe(F.col("mixed_id"))
    for c in key:
        same &= F.col(c) == F.col(f"mixed_{c}")
    return whole.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
