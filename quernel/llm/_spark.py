"""Session helpers shared by the operators: worker imports, shared scratch tables, components."""

from __future__ import annotations

import contextlib
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import _text

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bits of a hash that have a place in the table of marks().
MARKS = 27
#: Rows that are sent to all tasks at most.
FEW = 1_000_000


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package importable in its Python workers."""
    spark = df.sparkSession
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; a local folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside are removed when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes the frame to the shared folder and reads it again: cuts lineage, outlives lost executors, and frees the frame's shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that cut() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def matching(df: DataFrame, ids: DataFrame, key: str, most: int = FEW) -> DataFrame:
    """Inner join with ids, whose rows are sent to all tasks if there are no more than most of them, so that df stays where it is."""
    rows = ids.limit(most + 1).collect()
    if len(rows) > most:
        return df.join(ids, key)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, ids.schema)), key)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't in ids, a written table of one column; rows with a null key stay. No more than FEW ids are
    sent to all tasks, so that df stays where it is; more are joined by shuffling."""
    gone = fresh(df, "gone")
    rows = ids.limit(FEW + 1).count()
    ids = ids.toDF(gone)
    return df.join(F.broadcast(ids) if rows <= FEW else ids, df[key] == F.col(gone), "left_anti")


def mark_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place in the table of marks() of pairs of numbers."""
    return _text.mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) >> np.uint64(64 - MARKS)


def marks(pairs: DataFrame, parts: int) -> np.ndarray:
    """A bit for each place of mark_slots(), set where some row of pairs (two longs) is: 16 MB at any size. A set bit may be another pair's."""

    def place(batches):
        for b in batches:
            slot = np.unique(mark_slots(b.column(0).to_numpy(), b.column(1).to_numpy())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(((slot * parts) >> MARKS).astype(np.int32)), pa.array(slot)], ["part", "slot"])

    def gather(batches):
        slots = [b.column(1).to_numpy() for b in batches]
        slots = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int64)
        if len(slots):
            low = int(slots[0]) >> 3
            bits = np.zeros((int(slots[-1]) >> 3) - low + 1, np.uint8)
            np.bitwise_or.at(bits, (slots >> 3) - low, np.uint8(1) << (slots & 7).astype(np.uint8))
            blob = pa.compress(bits.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([len(bits)]), pa.array([blob], pa.binary())], ["low", "size", "bits"])

    with freed(pairs.sparkSession):
        placed = pairs.mapInArrow(_text.tidy(place), "part int, slot long").repartitionById(parts, F.col("part"))
        found = placed.mapInArrow(_text.tidy(gather), "low long, size long, bits binary").toArrow()
    table = np.zeros(1 << (MARKS - 3), np.uint8)
    for low, size, blob in zip(found["low"].to_pylist(), found["size"].to_pylist(), found["bits"].to_pylist()):
        table[low : low + size] |= np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return table


def marked(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair's bit is set in a table of marks()."""
    slot = mark_slots(a, b)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made of it that no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with keyed, which has one row a key and, in the column count, the number of rows that have it.

    Rows of the keys that over a thousandth of all rows have stay where they are: there are at most 1,000 of these, so
    they are sent to all tasks. The rest is joined by shuffling.
    """
    most = max(10_000, rows.count() // 1000)
    hot = F.broadcast(keyed.where(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def triangles(member: DataFrame, cell: str, id: str, most: int) -> DataFrame:
    """(id, cells: array of (cell, sub, bucket)) of distinct rows (cell, id): a cell of over most ids is cut into buckets, and each
    two of its buckets make a sub-cell, so any two ids of a cell meet and no sub-cell is much larger than two buckets."""
    many = member.groupBy(cell).agg(F.ceil(F.count("*") / most).alias("many"))
    bucket = F.pmod(F.xxhash64(id), F.col("many"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("other")
    member = member.join(many, cell).select(F.col(cell).alias("cell"), id, bucket.alias("bucket"), other)
    sub = F.least("bucket", "other") * F.lit(1 << 24) + F.greatest("bucket", "other")
    return member.groupBy(id).agg(F.collect_set(F.struct("cell", sub.alias("sub"), "bucket")).alias("cells"))


class Meeting:
    """Which pairs of a sub-cell of triangles() count in it: of all the cells that both are in the smallest is this one, and
    pairs of one bucket belong to the sub-cell of that bucket alone."""

    def __init__(self, key: tuple[int, int], bucket: np.ndarray, cells: list[list[int]]):
        low, high = key[1] >> 24, key[1] & (1 << 24) - 1
        self.bucket = bucket if low != high else None
        names: dict[int, list[int]] = {}
        for k, x in enumerate(cells):
            for c in x:
                if c < key[0]:
                    names.setdefault(c, []).append(k)
        names = {c: x for c, x in names.items() if len(x) > 1}
        # a bit for each smaller cell, as their number rises with that of all cells and each pair reads a row
        before = np.zeros((len(cells), -(-len(names) // 64) * 8), np.uint8)
        for k, x in enumerate(names.values()):
            before[x, k >> 3] |= np.uint8(1 << (k & 7))
        self.before = before.view(np.uint64)

    def first(self, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs of i (a number, or as many as j) with each of j count here."""
        ok = np.ones(len(j), bool)
        if self.bucket is not None:
            ok &= self.bucket[i] != self.bucket[j]
        if not self.before.shape[1]:
            return ok
        if np.ndim(i) == 0:
            some = np.flatnonzero(self.before[i])
            return ok & ~(self.before[np.ix_(j, some)] & self.before[i, some]).any(axis=1)
        for at in range(0, len(j), 1 << 14):
            part = slice(at, at + (1 << 14))
            ok[part] &= ~(self.before[i[part]] & self.before[j[part]]).any(axis=1)
        return ok


def connect(label: np.ndarray, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after i (a number, or as many as j) is connected to each of j: those that met get the smallest of them."""
    if np.ndim(i) == 0:
        seen = np.unique(np.append(label[j], label[i]))
        return label if len(seen) == 1 else np.where(np.isin(label, seen), seen[0], label)
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        at = np.arange(len(label))  # where each label goes
        np.minimum.at(at, np.maximum(a, b), np.minimum(a, b))
        while (at != at[at]).any():
            at = at[at]
        label = at[label]


def classes(known: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """(id, class_id, links) of the rows that are linked to others, each id once.

    known: distinct (id, sid); rows of one sid are copies of each other. found: (sid, id, links, root), the id being the sid's smallest,
    root an id that it is connected to; links of one sid add up. The copies of a row count among its links. A hot sid is
    joined where its rows are.
    """
    first = known.groupBy("sid").agg(F.min(id).alias(id), F.count("*").alias("copies"))
    # an id with several sids connects them
    several = known.groupBy(id).agg(F.count("*").alias("k")).where("k > 1").select(id)
    several = known.join(several, id).join(first.select("sid", F.col(id).alias("root")), "sid").select(id, "root")
    edges = found.select(id, "root").unionByName(several)
    comp, comp_path = components(edges.select(F.col(id).alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    sets = first.join(links, "sid", "left").join(comp.withColumnRenamed("node", id), id, "left")
    sets = sets.select("sid", "copies", F.coalesce("comp", id).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    sets, path = cut(sets, "classes")
    out = spread_join(known.select(id, "sid"), sets, "sid", "copies")
    out, _ = cut(out.groupBy(id).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")), "linked")
    drop(known.sparkSession, comp_path)
    drop(known.sparkSession, path)
    return out


def some_of_each(labels: DataFrame, per_class: int) -> DataFrame:
    """At most per_class ids of each label of (doc_id, label), those of the least hashes; of several labels of one id the least
    counts, nulls don't. Each label is ranked in as many parts as there are shuffle partitions, then what is left of these, so
    that no task sorts all of a label."""
    from pyspark.sql import Window

    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = ids.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    for by in (["label", "part"], ["label"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= per_class)
    return ids.select("doc_id", "label")


def fit_in_task(rows: DataFrame, fit: Callable[[list], object]) -> object:
    """What fit makes of the rows (doc_id, text, label), by doc_id and the first of each id: in one task, so the driver holds the model alone.

    The rows must be a bounded sample.
    """

    def run(batches):
        table = pa.Table.from_batches(list(batches)).to_pydict() if (batches := [b for b in batches if b.num_rows]) else {"doc_id": [], "text": [], "label": []}
        order = sorted(range(len(table["doc_id"])), key=lambda i: (table["doc_id"][i], table["text"][i]))
        order = [i for k, i in enumerate(order) if not k or table["doc_id"][i] != table["doc_id"][order[k - 1]]]
        model = fit([SimpleNamespace(doc_id=table["doc_id"][i], text=table["text"][i], label=table["label"][i]) for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(_text.tidy(run), "model binary").first()
    return pickle.loads(made.model) if made else fit([])


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of (src LONG, dst LONG) as (node, comp), comp being the smallest id, and the scratch table that this needs.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay the same; each round
    is one written table, so the lineage stays short. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    now, path = cut(now.distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        new, new_path = cut(small.where("u <> v").distinct(), "edges")
        new_mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        now, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots), path
