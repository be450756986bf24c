"""Tables written to the shared folder, so that lineage stays short and lost executors cost nothing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """The session, with this package importable in its Python workers."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, in order, whose sizes add up to most at most; a row of its own if it is larger."""
    total, lo = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def tidy(run):
    """The function for mapInArrow, which then gives free memory back: workers live on, beside those of later stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def workspace(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def persist(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes the frame as a fresh Parquet table and reads it again."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
