"""Tables kept by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cache_key(spec: dict) -> str:
    """Digest of a whole read specification: paths, limits, filters, tiling and versions of files."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:24]


def file_versions(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, length and change time of every matching file, so that changed inputs change the key."""
    out = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found or []]
    return sorted(out)


def cached(spark: SparkSession, folder: str, spec: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a specification: read where a complete one exists, else built and written."""
    path = f"{folder.rstrip('/')}/{cache_key(spec)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
