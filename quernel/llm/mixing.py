"""Mixing sources to target weights by Pfair scheduling: a proportionate order of blocks of the sources.

Every source's documents are put in a random order and cut into blocks of block_chars characters. Weights are rounded to
units of 1/resolution (largest remainders, at least one unit). With k units of R, block j of a source is released at
slot floor((j-1)R/k) and due before slot ceil(jR/k); the slots go to the released block whose deadline is earliest. On one
processor that meets every deadline, so after any number of slots each source's number of blocks differs from its share by
less than one block. Windows repeat after R slots, so one period of fixed size is scheduled and shared, whatever the
amount of data: block j is in period (j-1) div k, in the slot of that period's ((j-1) mod k)-th block.

In the slot in which some source has no block left, a phase ends: from there on the weights can't be held. A next phase
schedules what is left of the others by the units they have, from which their shares follow, and so on until all blocks
have a slot. So no document is lost, there are no more phases than sources, and within each phase a source's number of
blocks differs from its share of the phase by less than one. That holds for slots; a document is part of the block in which it
starts, so in characters a source is ahead or behind by up to two blocks and the length of its longest document. With whole=False the mixture is the first phase alone, which
holds the weights and leaves out what other sources have left; that is the default for weights that are given, while
default weights make a whole mixture.

Default weights are volumes to the power of temperature, so that small sources count for more than their volume.

Result of schedule(): all columns of docs, block (1, 2, ...), slot (0, 1, ...; null if left out) and char_start, the place
in the source's order; (slot, char_start) is the mixture's order. mix() returns the mixture's rows in that order, in parts
of successive slots, with the columns of docs.

A null source is a source of its own. Null or empty texts take no room, so they are in the block of what precedes them.
Null ids are kept. Repeated rows and ties are ordered by doc_id and a hash of the text, so results don't depend on how
the input is partitioned. Sources without or with non-positive weight are left out; weights of absent sources are ignored.
A source without any characters has one block. An empty table gives an empty result. Columns of docs that are named
like one of the result's are replaced in it; mix() keeps them.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import _spark

BLOCK_CHARS, RESOLUTION, TEMPERATURE = 1 << 14, 1024, 0.7
#: Characters whose order one task settles, and that a part of the mixture has.
BUCKET_CHARS, PART_CHARS = 16 << 20, 32 << 20


def units(weights: list[float], resolution: int = RESOLUTION) -> list[int]:
    """Weights as whole units that add up to resolution, at least one each, by largest remainders."""
    if not weights:
        return []
    if len(weights) > resolution:
        raise ValueError("more sources than units")
    total = math.fsum(weights)
    exact = [Fraction(w) / Fraction(total) * resolution for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    while sum(out) != resolution:
        step = 1 if sum(out) < resolution else -1
        can = [i for i in range(len(out)) if out[i] + step >= 1]
        i = max(can, key=lambda i: (step * (exact[i] - out[i]), -i))
        out[i] += step
    return out


def period(k: list[int]) -> list[tuple[int, int]]:
    """For each slot of a period the source and which of its blocks (from 0), earliest deadline first."""
    size = sum(k)
    out, ready = [], []
    coming = sorted(((j * size) // n, -(-(j + 1) * size // n), i, j) for i, n in enumerate(k) for j in range(n))
    at = 0
    for slot in range(size):
        while at < len(coming) and coming[at][0] <= slot:
            _, due, i, j = coming[at]
            heapq.heappush(ready, (due, i, j))
            at += 1
        due, i, j = heapq.heappop(ready)
        assert slot < due
        out.append((i, j))
    return out


def _slot(j: int, k: int, size: int, slots: list[int]) -> int:
    """Slot of block j (from 1)."""
    return (j - 1) // k * size + slots[(j - 1) % k]


def phases(k: list[int], blocks: list[int], whole: bool = True) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], int]:
    """Rows (phase, source, before, upto, first, units, size): a source's blocks before < j <= upto are in the phase, whose
    first slot and period are given; rows (phase, source, nth, in_period); and the number of slots. Only the first phase if not whole."""
    left, first = dict(enumerate(blocks)), 0
    ranges, table = [], []
    for phase in range(len(k)):
        index = sorted(left)
        size = sum(k[i] for i in index)
        slots: dict[int, list[int]] = {i: [] for i in index}
        for slot, (i, _) in enumerate(period([k[i] for i in index])):
            slots[index[i]].append(slot)
        end = min(_slot(left[i] + 1, k[i], size, slots[i]) for i in index)
        for i in index:
            done = end // size * k[i] + bisect.bisect_left(slots[i], end % size)
            if done:
                ranges.append((phase, i, blocks[i] - left[i], blocks[i] - left[i] + done, first, k[i], size))
                table += [(phase, i, n, s) for n, s in enumerate(slots[i][:done])]
            left[i] -= done
        first += end
        left = {i: n for i, n in left.items() if n}
        if not left or not whole:
            break
    return ranges, table, first


def _plan(docs: DataFrame, weights: dict | None, block_chars: int, resolution: int, temperature: float, whole: bool | None):
    """Rows (source, index, blocks, buckets) of the sources, and phases()."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars")).collect()
    sizes = sorted(sizes, key=lambda r: (r.source is not None, r.source or ""))
    whole = weights is None if whole is None else whole
    if weights is None:
        weights = {r.source: max(1, r.chars) ** temperature for r in sizes}
    sizes = [r for r in sizes if (weights.get(r.source) or 0) > 0]
    k = units([weights[r.source] for r in sizes], max(resolution, 8 * len(sizes)))
    blocks = [max(1, -(-r.chars // block_chars)) for r in sizes]
    sources = [(r.source, i, blocks[i], max(1, -(-r.chars // BUCKET_CHARS))) for i, r in enumerate(sizes)]
    return sources, *phases(k, blocks, whole)


def _keyed(docs: DataFrame, sources: list[tuple], seed: int) -> DataFrame:
    """The columns of docs as c0, c1, ..., so that no name clashes with one of those made here; _h, _hash and the id are the order
    within a source, _bucket rises with _h. The sources are sent to all tasks: a join by source would shuffle all texts."""
    spark = _spark.session(docs)
    src = F.broadcast(spark.createDataFrame(sources, "_name string, _index long, _blocks long, _buckets long"))
    id, text, source = (f"c{_place(docs, name)}" for name in ("doc_id", "text", "source"))
    x = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    x = x.withColumn("_hash", F.xxhash64(F.lit(seed), id, text)).withColumn("_chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    x = x.withColumn("_h", F.shiftrightunsigned("_hash", 11)).withColumn("_at", F.monotonically_increasing_id())
    x = x.join(src, F.col(source).cast("string").eqNullSafe(F.col("_name")), "left")
    return x.withColumn("_bucket", F.floor(F.col("_h") / F.lit(float(1 << 53)) * F.coalesce("_buckets", F.lit(1))))


def _slotted(x: DataFrame, block_chars: int, ranges: list[tuple], table: list[tuple]) -> DataFrame:
    """Adds _block and _slot of rows with _start."""
    # as large as the sources are many, whatever their size
    ranges = F.broadcast(x.sparkSession.createDataFrame(ranges, "_phase long, _in long, _before long, _upto long, _first long, _units long, _size long"))
    slots = F.broadcast(x.sparkSession.createDataFrame(table, "_phase long, _index long, _nth long, _in_period long"))
    # empty texts behind a last block that is full have no block of their own
    x = x.withColumn("_block", F.least(F.floor(F.col("_start") / block_chars) + 1, "_blocks"))
    x = x.join(ranges, (F.col("_index") == F.col("_in")) & (F.col("_block") > F.col("_before")) & (F.col("_block") <= F.col("_upto")), "left")
    done = F.col("_block") - 1 - F.col("_before")
    x = x.withColumn("_nth", done % F.col("_units")).join(slots, ["_phase", "_index", "_nth"], "left")
    return x.withColumn("_slot", F.col("_first") + F.floor(done / F.col("_units")) * F.col("_size") + F.col("_in_period"))


def _scheduled(docs: DataFrame, sources, ranges, table, block_chars: int, seed: int) -> DataFrame:
    """_keyed() rows with _block, _slot and _start."""
    id, source = (f"c{_place(docs, name)}" for name in ("doc_id", "source"))
    x = _keyed(docs, sources, seed)
    # the order of a source is that of its buckets, so no task sees all of a source
    before = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(source, "_bucket").agg(F.sum("_chars").alias("_sum"))
    base = base.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(F.col(source).alias("_source"), F.col("_bucket").alias("_of"), "_base")
    within = Window.partitionBy(source, "_bucket").orderBy("_h", "_hash", id, "_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_sum", F.sum("_chars").over(within) - F.col("_chars"))
    x = x.join(F.broadcast(base), F.col(source).eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    return _slotted(x.withColumn("_start", F.col("_base") + F.col("_sum")), block_chars, ranges, table)


def _place(docs: DataFrame, name: str) -> int:
    return docs.columns.index(name)


def schedule(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, temperature: float = TEMPERATURE, seed: int = 13, whole: bool | None = None) -> DataFrame:
    """Block, slot and place of every row of docs (doc_id, text, source, ...); see the module for the result."""
    sources, ranges, table, _ = _plan(docs, weights, block_chars, resolution, temperature, whole)
    x = _scheduled(docs, sources, ranges, table, block_chars, seed)
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in ("block", "slot", "char_start")]
    return x.select(*own, F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_start").alias("char_start"))


def mix(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, temperature: float = TEMPERATURE, seed: int = 13, whole: bool | None = None) -> DataFrame:
    """The mixture's rows in its order, with the columns of docs.

    A part is a range of slots, so of each source it has a range of its order. Where these begin is found from ids, hashes and
    lengths alone; by that every row goes to its part, in the only shuffle of texts, and there gets its slot. Rows of one id and text
    may be on both sides of such an edge, so all of them go to both parts, which keep those whose slots are theirs.
    """
    sources, ranges, table, end = _plan(docs, weights, block_chars, resolution, temperature, whole)
    parts = max(1, -(-end * block_chars // PART_CHARS))
    per = max(1, -(-end // parts))
    x = _scheduled(docs.select("doc_id", "text", "source"), sources, ranges, table, block_chars, seed).where("_index IS NOT NULL")
    x = x.withColumn("_tie", F.min("_start").over(Window.partitionBy("c2", "_bucket", "_h", "_hash", "c0")))
    # what has no slot is behind the rest of its source
    part = F.coalesce(F.floor(F.col("_slot") / per), F.lit(parts)).cast("int").alias("_part")
    x = x.select("_index", part, "_buckets", F.struct(F.struct("_h", "_hash", F.col("c0").alias("_id")).alias("_low"), "_tie", F.col("_bucket").alias("_from")).alias("_edge"))
    x = x.groupBy(F.col("_index").alias("_in_source"), "_part").agg(F.min("_edge").alias("_edge"), F.max("_buckets").alias("_of"))
    after = Window.partitionBy("_in_source").orderBy("_part")
    x = x.select("_in_source", "_part", "_edge.*", F.lead("_edge._low").over(after).alias("_high"), F.coalesce(F.lead("_edge._from").over(after), F.col("_of") - 1).alias("_to"))
    edges, _ = _spark.cut(x.where(F.col("_part") < parts).withColumn("_of", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to"), "edges-of-parts")
    if edges.limit(_spark.FEW + 1).count() <= _spark.FEW:
        edges = F.broadcast(edges)

    id = f"c{_place(docs, 'doc_id')}"
    x = _keyed(docs, sources, seed).withColumn("_key", F.struct("_h", "_hash", F.col(id).alias("_id")))
    here = (F.col("_index") == F.col("_in_source")) & (F.col("_bucket") == F.col("_of"))
    x = x.join(edges, here & (F.col("_key") >= F.col("_low")) & (F.col("_high").isNull() | (F.col("_key") <= F.col("_high")))).drop("_key", "_low", "_high")
    x = x.repartitionById(parts, F.col("_part"))
    upto = Window.partitionBy("_part", "_index").orderBy("_h", "_hash", id, "_at").rowsBetween(Window.unboundedPreceding, 0)
    x = _slotted(x.withColumn("_start", F.col("_tie") + F.sum("_chars").over(upto) - F.col("_chars")), block_chars, ranges, table)
    x = x.where(F.floor(F.col("_slot") / per) == F.col("_part")).sortWithinPartitions("_slot", "_start", id)
    return x.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
