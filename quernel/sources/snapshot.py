"""Snapshots: docs and postings as Parquet under one folder, and a manifest that names them, without which nothing is read.

Each save writes tables of its own beside those of the one before, then the manifest under another name, and renames it.
Until then the old snapshot stays whole, so an engine may save to where it was loaded from, and a save that breaks off changes
nothing. Tables of older saves go afterwards, but for those that the saved frames read. Postings keep all positions, so
loading gives back what was saved. Caches, fuzzy vocabulary and rankers aren't part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quernel.operators.index import by_term

FORMAT, VERSION = "quernel-index", 2
MANIFEST = "format string, version int, tables string, next_id long, documents long, terms long"


class SnapshotError(ValueError):
    pass


@dataclass(frozen=True)
class Snapshot:
    docs: DataFrame
    postings: DataFrame
    next_id: int
    documents: int
    terms: int


def save(path: str, docs: DataFrame, postings: DataFrame | Callable[[DataFrame], DataFrame], next_id: int = 1) -> None:
    """Writes a snapshot, in place of an older one. postings may be a function that makes them of the docs table, which then reads the written one."""
    spark = docs.sparkSession
    fs, p = _fs(spark, path)
    name = f"tables-{uuid.uuid4().hex}"
    inputs = [*docs.inputFiles(), *([] if callable(postings) else postings.inputFiles())]
    docs.write.parquet(f"{path}/{name}/docs")
    if callable(postings):
        postings = postings(spark.read.schema(docs.schema).parquet(f"{path}/{name}/docs"))
    by_term(postings).write.parquet(f"{path}/{name}/postings")
    back = spark.read.parquet(f"{path}/{name}/postings")
    row = (FORMAT, VERSION, name, next_id, spark.read.parquet(f"{path}/{name}/docs").count(), back.select("term").distinct().count())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{path}/{name}/manifest")
    fs.delete(p(f"{path}/manifest"), True)
    if not fs.rename(p(f"{path}/{name}/manifest"), p(f"{path}/manifest")):
        raise SnapshotError(f"the manifest can't be put at {path}")
    for old in fs.listStatus(p(path)):
        table = old.getPath().getName()
        if table.startswith("tables-") and table != name and not any(f"/{table}/" in x for x in inputs):
            fs.delete(old.getPath(), True)


def load(spark: SparkSession, path: str) -> Snapshot:
    fs, p = _fs(spark, path)
    if not fs.exists(p(f"{path}/manifest/_SUCCESS")):
        raise SnapshotError(f"no snapshot at {path}")
    m = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if m is None or m.format != FORMAT or m.version != VERSION:
        raise SnapshotError(f"not a snapshot of version {VERSION}: {path}")
    return Snapshot(spark.read.parquet(f"{path}/{m.tables}/docs"), spark.read.parquet(f"{path}/{m.tables}/postings"), m.next_id, m.documents, m.terms)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p
