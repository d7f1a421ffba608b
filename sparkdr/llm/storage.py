"""Shared storage that cuts lineage: tables under the cluster's checkpoint folder.

Executors may be lost at any time, so intermediate results are Parquet tables in the
folder named by ``spark.checkpoint.dir`` (readable by all executors), never in local
caches.  Where the setting is absent a temporary folder is used in local mode only; a
cluster without the setting is an error.  The tables of an application stay, as results are
lazy and read them, until :func:`clear` deletes them all.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: from the session, else (in local mode) one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            folder = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="sparkdr-")
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared table and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the shared table behind a frame returned by :func:`materialize`."""
    if path := getattr(df, "_shared_path", None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every shared table of this application: call it when all results are written."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """``(row, columns...)``: whole rows as one struct, so that no name of theirs can clash; ``select("row.*")`` unpacks them."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


#: Most keys (of about 100 bytes) that are broadcast.
BROADCAST_KEYS = 200_000


def sized(keys: DataFrame) -> DataFrame:
    """Keys to join to whole rows: counted first, and broadcast only up to ``BROADCAST_KEYS``; else both sides are shuffled."""
    return keys.hint("broadcast" if keys.count() <= BROADCAST_KEYS else "merge")


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold at most ``rows`` rows: whole texts are large, and workers hold a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
