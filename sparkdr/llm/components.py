"""Connected components of a link table, without gathering it anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step links the
neighbours of a node to the smallest of them, and the links become stars round the
smallest node of each component in about log-many steps.  Before the first step each
partition replaces its links by a spanning forest, so that dense groups shrink at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import storage


def _forest(links: DataFrame) -> DataFrame:
    """Per partition, links to the smallest node of each local component instead of all links."""
    import pyarrow as pa

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        def flush():
            pairs = [(x, root(x)) for x in parent]
            pairs = [(a, b) for a, b in pairs if a != b]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # bounds memory: a forest of what came so far goes out
                yield flush()
        yield flush()

    return links.mapInArrow(run, "u long, v long")


def _least_neighbours(links: DataFrame) -> DataFrame:
    """``(k, least)`` of the smaller of each node and its neighbours; ``k`` is the node's join key."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    # ~u as the key asks for an exchange of its own, so that hot nodes of the other side can be split
    return least.select(F.bitwise_not("u").alias("k"), F.least("u", "least").alias("least"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links u > v; the result has links u > v again."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbours(both)
        out = both.filter("v > u").withColumn("k", F.bitwise_not("u")).join(least, "k").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        least = _least_neighbours(links)
        joined = links.withColumn("k", F.bitwise_not("u")).join(least, "k")
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.bitwise_not("k").alias("u"), F.col("least").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the links ``(u long, v long)``; component: its smallest node.

    Nodes that are their component's smallest are left out.  Self links count for nothing.
    """
    spark = links.sparkSession
    # a node's links meet in one partition, so that a group of many links shrinks to its nodes
    links = _forest(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").repartition("u"))
    links = storage.materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_steps):
        now = links.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        step = storage.materialize(_star(_star(links, large=True), large=False), "links")
        storage.discard(links)
        links = step
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return spark.createDataFrame([], "node long, component long") if now[0] == 0 else links.select(F.col("u").alias("node"), F.col("v").alias("component"))
