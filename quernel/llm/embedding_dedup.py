"""Embedding near-dedup: vectors of cosine similarity >= threshold, by a forest of random-projection trees.

1. Equal vectors count as one: the smallest vec_id stands for them in the trees.
2. Every tree splits its vectors near the median of their projection on a random direction, again and again, where they
   are sparsest. Vectors within the SPILL share of either side of the cut go to both sides, so close vectors are seldom
   parted. The cuts of a node are those of a bounded sample of its vectors (PER_LEAF for each leaf to be, SAMPLE at most); all
   vectors are then sent down by their projections. The vectors of every leaf are counted; one that is still too large is
   split again in the next round, until each has at most 2 LEAF, or its projections are equal, or over DENSE of its pairs
   are similar: splitting it would part them, and comparing it costs no more than a few times its links.
3. All vectors of a leaf are compared exactly, block by block. A leaf of over CELL vectors is cut into
   buckets that meet two by two, so no task takes all of it. A pair that meets in several leaves counts in one.
4. Leaves give each vector's number of links and spanning links, no pairs, so what is shuffled is in proportion to the
   input, however large a group of near copies is. The spanning links are united to classes.

Result of dedup(): vec_id, class_id, links; a row for each vector that is similar to any other. class_id is the smallest
vec_id of the vectors that are connected by similarity, links the number of vectors that it is similar to, copies included.
pairs() lists them: vec_a < vec_b, similarity (rounded to 6 places), each once; the smallest vec_id of equal vectors stands
for all and is paired with each copy.

Vectors are compared by direction; vectors of zeros, with nulls, NaNs or infinities, or without elements match nothing,
null vectors and null ids neither. Vectors of different length never match. Vectors are equal if 64-bit hashes of their
directions are. Rows of one vec_id and one vector count once; of a vec_id with several vectors the links of all are added
up, and their classes are one. A similarity equal to the threshold is in. Extra columns are ignored; an empty table gives
an empty result. Near copies are missed with a small probability (see README).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

THRESHOLD, TREES, LEAF, SPILL = 0.9, 6, 1024, 0.05
#: Sampled vectors for each leaf to be, and at most for a node; vectors that are compared as a whole.
PER_LEAF, SAMPLE, CELL = 128, 32_768, 4096
#: Bytes of subtrees that are sent to all tasks at most; more are joined to the vectors.
SENT = 1 << 25
#: The share of similar pairs from which a node isn't split, and where cuts lie.
DENSE, MIDDLE = 0.25, 0.4
NODES = "sid long, tree int, node long, dim int, stuck boolean"


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of an array of numbers by length: their places and their elements as a matrix; null rows and rows with nulls are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = column.offsets.to_numpy()
    values = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    size = np.where(np.asarray(column.is_valid()), np.diff(offs), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        first = offs[rows]
        whole = first[-1] - first[0] == d * (len(rows) - 1)
        yield rows, (values[first[0] : first[-1] + d].reshape(-1, d) if whole else values[first[:, None] + np.arange(d)])


def lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.reshape(-1)))


def directions(seed: int, tree: int, depth: int, levels: int, dim: int) -> np.ndarray:
    """Random directions of a tree's levels from depth on, a column each."""
    return np.stack([np.random.default_rng([seed, tree, depth + k]).standard_normal(dim) for k in range(levels)], axis=1)


def grow(x: np.ndarray, seed: int, tree: int, node: int, leaves: float, spill: float, threshold: float) -> bytes:
    """A subtree for about so many leaves from sampled vectors of a node: its levels, the inner nodes in ascending order (the root is 1,
    those below k are 2 k and 2 k + 1) and their cuts. Of the cuts from MIDDLE to 1 - MIDDLE of the vectors that with the widest margin is taken."""
    depth = node.bit_length() - 1
    levels = min(int(np.ceil(np.log(max(2.0, leaves)) / -np.log(1 - MIDDLE + spill))), 62 - depth)
    shares = np.linspace(MIDDLE, 1 - MIDDLE, 9)
    p = x @ directions(seed, tree, depth, levels, x.shape[1])
    cuts = {}
    now = {1: np.arange(len(x))}
    for level in range(levels):
        after = {}
        for k, rows in now.items():
            if len(rows) < 16 or leaves * len(rows) <= len(x):
                continue
            few = x[rows[:: max(1, len(rows) // 256)]]
            if (few @ few.T >= threshold).mean() > DENSE:
                continue
            lows, highs = np.quantile(p[rows, level], [shares - spill, shares + spill])
            widest = int(np.argmax(highs - lows))
            low, high = lows[widest], highs[widest]
            left, right = rows[p[rows, level] <= high], rows[p[rows, level] >= low]
            if max(len(left), len(right)) < len(rows):
                cuts[k] = low, high
                after[2 * k], after[2 * k + 1] = left, right
        now = after
    inner = sorted(cuts)
    return struct.pack("<qq", levels, len(inner)) + np.array(inner, np.int64).tobytes() + np.array([cuts[k] for k in inner], np.float64).tobytes()


def send(x: np.ndarray, seed: int, tree: int, node: int, subtree: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """The leaves of vectors of a node: places, leaves, and whether the node is one itself."""
    levels, n = struct.unpack("<qq", subtree[:16])
    cuts = dict(zip(np.frombuffer(subtree, np.int64, n, 16).tolist(), np.frombuffer(subtree, np.float64, 2 * n, 16 + 8 * n).reshape(-1, 2).tolist()))
    p = x @ directions(seed, tree, node.bit_length() - 1, levels, x.shape[1])
    places, leaves, todo = [], [], [(1, 0, np.arange(len(x)))]
    while todo:
        k, level, rows = todo.pop()
        if not len(rows):
            continue
        if k not in cuts:
            places.append(rows)
            leaves.append(np.full(len(rows), (node << level) | (k - (1 << level)), np.int64))
            continue
        low, high = cuts[k]
        todo += [(2 * k, level + 1, rows[p[rows, level] <= high]), (2 * k + 1, level + 1, rows[p[rows, level] >= low])]
    return np.concatenate(places), np.concatenate(leaves), 1 not in cuts


def _unique(vectors: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (vec_id, sid), unique vectors (sid, vec_id, copies, dim, x) with x of length 1, and the scratch tables."""

    def run(batches):
        for b in batches:
            for rows, x in matrices(b.column(1)):
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                x = x[ok] / top[ok, None]
                x /= np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
                x += 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[ok])), lists(x)], ["vec_id", "x"])

    _spark.session(vectors)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_text.tidy(run), "vec_id long, x array<double>")
    v, path = _spark.cut(v.withColumn("sid", F.xxhash64("x")), "vectors")
    rows, rows_path = _spark.cut(v.select("vec_id", "sid").distinct(), "vector-ids")
    first = rows.groupBy("sid").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    unique = v.join(first, ["vec_id", "sid"]).groupBy("vec_id", "sid").agg(F.first("copies").alias("copies"), F.first("x").alias("x"))
    unique, unique_path = _spark.cut(unique.withColumn("dim", F.size("x")), "unique-vectors")
    _spark.drop(v.sparkSession, path)
    return rows, unique, [rows_path, unique_path]


def _forest(unique: DataFrame, threshold: float, trees: int, leaf: int, spill: float, seed: int) -> tuple[DataFrame, list[str]]:
    """Rows NODES: the leaves of each vector in all trees, and the scratch tables."""
    spark = unique.sparkSession
    key = ["tree", "node", "dim"]

    def fit(table: pa.Table) -> pa.Table:
        tree, node, dim = (table.column(k)[0].as_py() for k in key)
        ((_, x),) = matrices(table.column("x"))
        leaves = table.column("count")[0].as_py() / leaf
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], "dim": pa.array([dim], pa.int32()), "subtree": pa.array([grow(x, seed, tree, node, leaves, spill, threshold)], pa.binary())})

    def assign(batches):  # known: what is broadcast in this round
        for b in batches:
            sid, tree, node, dim = (b.column(k).to_numpy() for k in range(4))
            order = np.lexsort((dim, node, tree))
            edge = np.flatnonzero(np.append(True, (np.diff(tree[order]) != 0) | (np.diff(node[order]) != 0) | (np.diff(dim[order]) != 0)))
            for lo, hi in zip(edge, [*edge[1:], len(order)]) if len(order) else ():
                part = order[lo:hi]
                k = int(part[0])
                ((_, x),) = matrices(b.column(4).take(pa.array(part)))
                of = known.value[int(tree[k]), int(node[k]), int(dim[k])] if known is not None else b.column(5)[k].as_py()
                at, leaves, stuck = send(x, seed, int(tree[k]), int(node[k]), of)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(sid[part[at]]), pa.array(np.full(n, tree[k], np.int32)), pa.array(leaves), pa.array(np.full(n, dim[k], np.int32)), pa.array(np.full(n, stuck))], ["sid", "tree", "node", "dim", "stuck"])

    nodes = unique.select("sid", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), F.lit(1).cast("long").alias("node"), "dim", F.lit(False).alias("stuck"))
    done, paths = None, []
    while True:
        counts = nodes.groupBy(*key).agg(F.count("*").alias("count"), F.max("stuck").alias("stuck"))
        big = counts.where(F.col("count") > 2 * leaf).where("NOT stuck AND node < 1L << 60").select(*key, "count")
        big, path = _spark.cut(big, "large-nodes")
        paths.append(path)
        few = big.count()
        rest = nodes.join(F.broadcast(big) if few <= 10_000 else big, key, "left_anti") if few else nodes
        done = rest if done is None else done.unionByName(rest)
        if not few:
            return done.select("sid", "tree", "node", "dim"), paths
        x = unique.select("sid", "x")
        now = nodes.select("sid", *key).join(F.broadcast(big) if few <= 10_000 else big, key).join(x, "sid")
        share = F.least(F.lit(float(SAMPLE)), F.ceil(F.col("count") / leaf) * PER_LEAF) / F.col("count")
        some = F.pmod(F.xxhash64(F.lit(seed), "sid", "tree"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share
        subtrees = now.where(some).select(*key, "count", "x").groupBy(*key).applyInArrow(fit, "tree int, node long, dim int, subtree binary")
        subtrees, path = _spark.cut(subtrees, "subtrees")
        paths.append(path)
        # a subtree has 24 bytes for each leaf, so all of them have less than a byte for each vector; no row carries its own
        known, now = None, now.select("sid", *key, "x")
        if (subtrees.agg(F.sum(F.length("subtree") + 64)).first()[0] or 0) <= SENT:
            known = spark.sparkContext.broadcast({(r.tree, r.node, r.dim): bytes(r.subtree) for r in subtrees.collect()})
        else:
            now = now.join(subtrees, key).select("sid", *key, "x", "subtree")
        nodes, path = _spark.cut(now.mapInArrow(_text.tidy(assign), NODES), "nodes")
        paths.append(path)
        if known is not None:
            known.unpersist()


def _search(rows: DataFrame, threshold: float, as_pairs: bool) -> DataFrame:
    """All pairs of every cell: listed, or for each vector its links and a smaller one that it is connected to."""

    def compare(key, parts):
        t = pa.concat_tables(parts)
        cells = t.column("cells").to_pylist()
        bucket, sid, ids, copies = (t.column(k).to_numpy() for k in ("bucket", "sid", "vec_id", "copies"))
        for at, x in matrices(t.column("x")):
            if len(at) < 2:
                continue
            here = _spark.Meeting(key, bucket[at], [cells[k] for k in at])
            vec, n = ids[at], copies[at]
            links, label = np.zeros(len(at), np.int64), np.argsort(np.argsort(vec))
            for lo in range(0, len(at), 512):
                s = x[lo : lo + 512] @ x[lo:].T
                i, j = np.nonzero(np.triu(s >= threshold - 1e-9, 1))
                if not len(i):
                    continue
                s = s[i, j]
                i, j = i + lo, j + lo
                label = _spark.connect(label, i, j)
                ok = here.first(i, j)
                i, j = i[ok], j[ok]
                if as_pairs:
                    a, b = np.minimum(vec[i], vec[j]), np.maximum(vec[i], vec[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.round(np.minimum(s[ok], 1.0), 6))], ["vec_a", "vec_b", "similarity"])
                links += np.bincount(i, n[j], len(at)).astype(np.int64) + np.bincount(j, n[i], len(at)).astype(np.int64)
            root = np.sort(vec)[label]
            use = np.flatnonzero((links > 0) | (root != vec))
            if not as_pairs and len(use):
                yield pa.RecordBatch.from_arrays([pa.array(sid[at[use]]), pa.array(vec[use]), pa.array(links[use]), pa.array(root[use])], ["sid", "vec_id", "links", "root"])

    def run(batches):
        key, parts = None, []
        for b in batches:
            cell, sub = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(sub) != 0))) if len(cell) else ()
            for lo, hi in zip(edge, [*edge[1:], len(cell)]):
                here = int(cell[lo]), int(sub[lo])
                if here != key:
                    if parts:
                        yield from compare(key, parts)
                    key, parts = here, []
                parts.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        if parts:
            yield from compare(key, parts)

    return rows.mapInArrow(_text.tidy(run), "vec_a long, vec_b long, similarity double" if as_pairs else "sid long, vec_id long, links long, root long")


def _cells(vectors: DataFrame, threshold: float, trees: int, leaf: int, spill: float, seed: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (vec_id, sid); the vectors of all leaves, by cell and sub in one partition; and the scratch tables."""
    known, unique, paths = _unique(vectors)
    nodes, more = _forest(unique, threshold, trees, leaf, spill, seed)
    cells = _spark.triangles(nodes.select(F.xxhash64("tree", "node", "dim").alias("cell"), "sid").distinct(), "cell", "sid", CELL)
    rows = unique.join(cells, "sid").select(F.explode("cells").alias("c"), F.array_distinct(F.transform("cells", lambda c: c["cell"])).alias("cells"), "sid", "vec_id", "copies", "x")
    rows = rows.select("c.cell", "c.sub", "c.bucket", "cells", "sid", "vec_id", "copies", "x")
    return known, rows.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "sid"), [*paths, *more]


def pairs(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int | None = None, spill: float = SPILL, seed: int = 17) -> DataFrame:
    """Near pairs of vectors (vec_id, embedding); see the module for the result."""
    known, rows, _ = _cells(vectors, threshold, trees, leaf or LEAF, spill, seed)
    first = known.groupBy("sid").agg(F.min("vec_id").alias("vec_a"))
    copies = known.join(first, "sid").where("vec_id > vec_a").select("vec_a", F.col("vec_id").alias("vec_b"), F.lit(1.0).alias("similarity"))
    return _search(rows, threshold, True).where("vec_a <> vec_b").unionByName(copies)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int | None = None, spill: float = SPILL, seed: int = 17) -> DataFrame:
    """Class and number of links of each of the vectors (vec_id, embedding) that has any; see the module for the result."""
    known, rows, paths = _cells(vectors, threshold, trees, leaf or LEAF, spill, seed)
    found, path = _spark.cut(_search(rows, threshold, False), "near")
    out = _spark.classes(known, found, "vec_id")
    for p in (*paths, path):
        _spark.drop(vectors.sparkSession, p)
    return out


#: By all pairs; up to 2 LEAF vectors the forest compares all of them, too.
SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
b AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT DISTINCT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
g AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT x AS vec_id, class_id, count(*) AS links FROM b JOIN g USING (x) GROUP BY ALL
"""
