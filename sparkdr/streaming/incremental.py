"""Structured Streaming: windowed aggregates with late data, incremental indexing, stateful de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """``(start, event_type, n, total)`` of each window; works on batch and streaming frames alike."""
    rows = events.withWatermark("ts", late) if late else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    own = rows.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drop_repeats(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark; state of older keys is let go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events with no longer pause than ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    own = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def index_stream(passages: DataFrame, path: str, checkpoint: str, transform=None, once: bool = True) -> StreamingQuery:
    """Append transformed passages to a Parquet index as they arrive; a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        out = batch if transform is None else transform(batch)
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    writer = passages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
