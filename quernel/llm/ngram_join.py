"""N-gram Jaccard join: documents whose sets of word n-grams have Jaccard similarity >= threshold, all of them.

A T-occurrence search in which every document is a query. DivideSkip leaves a query's T - 1 longest inverted lists
out of the merge (T: the overlap that the threshold requires), so a partner must occur in a short list:

1. Divide: the length of every list is counted over the whole corpus. Classes of length of all lists of 8 or more are kept
   in a table of fixed size that only sets an order, so neither its size nor hash collisions change the result. It has no
   least length that rises with the corpus: lists that it left out would be taken for short ones and make crowds.
2. Every document posts its |x| - T + SHORT shortest lists, front-coded in sorted blobs. Documents with equal sets post
   as one. A merge task takes a range of n-grams. In a list of up to CROWD documents it counts each pair that differs little
   enough in size. What a pair shares apart from these lists is at most what either has in longer ones; if that can't fill
   up the count to the overlap that sizes and threshold require, the pair is left out. A list of more documents isn't
   multiplied out: each of its documents is linked to the list's smallest one, so what is shuffled stays in
   proportion to the postings, however large a group of near copies is.
3. Such pairs and links are routed to cells: a document goes to the cell of its partner's smallest partner, so those that
   share a list or a counted pair meet in one place. In each cell divide_skip() merges the short lists of each query,
   probes the long ones by binary search for what may still reach T, and retains the documents that reach the required
   overlap. A cell of over CELL documents is a triangle of sub-cells. A pair that meets in several cells counts in one.

Result of linked(): doc_id, class_id, links; a row for each document that is similar to any other. class_id is the smallest
doc_id of the documents that are connected by similarity, links the number of documents that it is similar to, copies
included. Cells give counts and spanning links, no pairs, so the result has at most as many rows as the input.
pairs() lists them: doc_a < doc_b, overlap, jaccard. Documents with equal sets have equal partners, so the smallest
doc_id of equal sets stands for all: it is paired with every copy (jaccard 1) and with the representatives of others.

Words are lower-cased runs of letters and digits; a document of 1 to n-1 words has all of them as its only n-gram.
N-grams are compared by 40 bits of a hash: two documents share one by chance with a probability of |x||y| / 2^40, so for a
pair of 1,000 n-grams each one of a million has its overlap one too high. Sets are equal if their 64-bit hashes are.

Null or empty texts and texts without words match nothing, and neither do rows whose doc_id is null. Rows with one
doc_id and one text count once; of a doc_id with several texts the links of all are added up, and their classes are one. Ties
(a similarity equal to the threshold) are in. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

N, THRESHOLD = 3, 0.5
#: Bits of an n-gram's hash, grams that are sorted at once, documents of a cell, bits of a hash that have a list length.
BITS, FLUSH, CELL, SLOTS = 40, 2 << 20, 4000, 25
SHORT = 3
#: Documents of a list whose pairs are counted.
CROWD = 32
#: Characters of the corpus for each merge task.
PART_CHARS = 32 << 20
_MASK = np.uint64((1 << BITS) - 1)
_U = np.uint64


def gram_sets(w: _text.Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all rows as sorted row << 40 | hash, and each row's first one (with the end at last)."""
    h, rows = w.hashes(), w.hi - w.lo
    count = np.diff(w.first)
    at = np.repeat(np.arange(rows, dtype=np.uint64), count)
    if len(h) >= n:
        g = _text.shingles(h, n)
        whole = at[: len(g)] == at[n - 1 :]
        key = (at[: len(g)] << _U(BITS)) | (g >> _U(64 - BITS))
        key = key[whole]
    else:
        key = np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        tail = [_text.shingles(h[w.first[r] : w.first[r + 1]], count[r])[0] for r in short]
        key = np.append(key, (short.astype(np.uint64) << _U(BITS)) | (np.array(tail, np.uint64) >> _U(64 - BITS)))
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key, np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << _U(BITS))


def set_ids(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set; 0 for empty ones."""
    out = np.zeros(len(first) - 1, np.uint64)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if len(full):
        x = _text.mix((key & _MASK) + _U(0x1234567))
        out[full] = _text.mix(np.add.reduceat(x, first[full]) * _U(0x9E3779B97F4A7C15) + size[full].astype(np.uint64))
    return out


def prefix_sizes(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many shortest lists each query merges: |x| - T + SHORT (at most all), with T the least overlap that any partner needs."""
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    return np.where(size > 0, size - least + np.minimum(SHORT, least), 0)


def add_up(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their times."""
    x, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[at], np.add.reduceat(n, at) if len(at) else n


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, which compress well when high bytes are small."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(body: bytes, n: int, extra: int = 0) -> bytes:
    return struct.pack("<qqq", n, extra, len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[int, int, bytes]:
    n, extra, size = struct.unpack("<qqq", blob[:24])
    return n, extra, pa.decompress(blob[24:], decompressed_size=size, codec="zstd", asbytes=True)


def cuts(sorted_keys: np.ndarray, parts: int, bits: int) -> list[int]:
    edges = [(p << bits) // parts for p in range(1, parts)]
    return [0, *np.searchsorted(sorted_keys, np.array(edges, np.uint64)).tolist(), len(sorted_keys)]


def length_class(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The class of length of each n-gram's list in a table of list_lengths()."""
    slot = grams >> _U(BITS - SLOTS)
    return (table[slot >> _U(1)].astype(np.uint64) >> ((slot & _U(1)) << _U(2))) & _U(15)


def list_lengths(docs: DataFrame, n: int, parts: int) -> np.ndarray:
    """Class of length of the longest list in each of 2**SLOTS ranges of hashes, two to a byte; counted over all documents. The class
    is 0 under 8 documents, then one more for each doubling, 15 at most."""

    def count(batches):
        pending, size = [], 0

        def flush():
            x = np.concatenate(pending)
            x.sort()
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            times = np.minimum(np.diff(np.append(at, len(x))), 65535)
            x = x[at]
            edges = cuts(x, parts, 32)
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            blobs = [pack(planes(np.diff(x[a:b], prepend=_U(0)), 4) + planes(times[a:b], 2), b - a) for _, a, b in rows]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for b in batches:
            for w in _text.words(b.column(0)):
                key, _ = gram_sets(w, n)
                pending.append((key & _MASK) >> _U(BITS - 32))
                size += len(key)
                if size > FLUSH:
                    yield flush()
                    pending, size = [], 0
        if size:
            yield flush()

    def top(batches):
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, _, body = unpack(blob)
                by.setdefault(part, []).append((np.cumsum(unplanes(body, k, 4, 0)) << _U(24)) | unplanes(body, k, 2, 4 * k))
        for x in by.values():
            x = np.concatenate(x)
            x.sort()
            g = x >> _U(24)
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            times = np.add.reduceat((x & _U(0xFFFFFF)).astype(np.int64), at)
            long = np.flatnonzero(times >= 8)
            slot = (g[at[long]] >> _U(32 - SLOTS)).astype(np.int64)
            low = int(slot[0]) if len(slot) else 0
            table = np.zeros(int(slot[-1]) - low + 1 if len(slot) else 0, np.uint8)
            np.maximum.at(table, slot - low, np.minimum(np.log2(times[long]) - 2, 15).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([pack(table.tobytes(), len(table))], pa.binary())], ["low", "classes"])

    with _spark.freed(docs.sparkSession):
        blobs = docs.select("text").mapInArrow(_text.tidy(count), "part int, blob binary").repartitionById(parts, F.col("part"))
        found = blobs.mapInArrow(_text.tidy(top), "low long, classes binary").toArrow()
    table = np.zeros(1 << SLOTS, np.uint8)
    for low, blob in zip(found["low"].to_pylist(), found["classes"]):
        x = np.frombuffer(unpack(blob.as_py())[2], np.uint8)
        np.maximum(table[low : low + len(x)], x, out=table[low : low + len(x)])  # parts may share a slot at their edges
    return table[::2] | table[1::2] << 4


def divide_skip(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of some sorted sets (i) those behind it (j > i) whose Jaccard similarity reaches the threshold, and the overlaps: a T-occurrence search."""
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        o = _overlap(*sets)
        if o >= threshold * (size.sum() - o) - 1e-9:
            yield 0, np.array([1]), np.array([o])
        return
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")  # owners ascend within each list
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    length = np.diff(np.append(start, len(values)))
    lists = np.empty(len(values), np.int64)  # the list of each posting, where the set has it
    lists[order] = np.repeat(np.arange(len(start)), length)
    ends = np.cumsum(size)
    for i in range(len(sets)):
        mine = lists[ends[i] - size[i] : ends[i]]
        mine = mine[length[mine] > 1]
        least = math.ceil(threshold * size[i] - 1e-9)
        if len(mine) < least:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        # Divide: this many of the longest lists are probed, the rest is merged
        skip = min(least - 1, int(least / (0.0085 * math.log2(max(2, length[mine[-1]])) + 1)), len(mine))
        short, long = mine[: len(mine) - skip], mine[len(mine) - skip :]
        n = length[short]
        at = np.repeat(start[short] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        times = np.bincount(owner[at], minlength=len(sets))
        need = np.ceil(threshold / (1 + threshold) * (size + size[i]) - 1e-9).astype(np.int64)
        cand = np.flatnonzero((times >= np.maximum(need - skip, 1)))
        cand = cand[cand > i]
        for k, g in enumerate(long):
            if not len(cand):
                break
            list_ = owner[start[g] : start[g] + length[g]]
            p = np.searchsorted(list_, cand)
            times[cand] += list_[np.minimum(p, len(list_) - 1)] == cand
            if k % 16 == 15:
                cand = cand[times[cand] + (skip - k - 1) >= need[cand]]
        cand = cand[times[cand] >= need[cand]]
        if len(cand):
            yield i, cand, times[cand]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    p = np.searchsorted(b, a)
    return int((b[np.minimum(p, len(b) - 1)] == a).sum()) if len(b) else 0


def _cells(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (doc_id, sid, size) of all documents with n-grams; the sets that may have partners, as rows (cell, sub, bucket, cells,
    doc_id, sid, copies, grams) by cell and sub in one partition; and the scratch tables that these need."""
    if n < 1 or not 0 < threshold <= 1:
        raise ValueError("n must be at least 1 and threshold in (0, 1]")
    spark = _spark.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = max(4, -(-(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // PART_CHARS))
    classes = spark.sparkContext.broadcast(list_lengths(docs, n, parts))

    def identify(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in _text.words(b.column(1)):
                key, first = gram_sets(w, n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + full]), pa.array(set_ids(key, first)[full].view(np.int64)), pa.array(size[full])], ["doc_id", "sid", "size"])

    def post(batches):
        keys, sids, sizes, held, count = [], [], [], 0, 0

        def flush():
            x, table, length = np.concatenate(keys), np.concatenate(sids), np.concatenate(sizes)
            x.sort()
            edges = cuts(x >> _U(24), parts, BITS)
            at_parts, blobs = [], []
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:  # a blob has the documents of its own postings
                    who, at = np.unique(x[a:b] & _U(0xFFFFFF), return_inverse=True)
                    body = planes(np.diff(x[a:b] >> _U(24), prepend=_U(0)), 5) + planes(at.astype(np.uint64), 3)
                    who = who.astype(np.int64)
                    at_parts.append(p)
                    blobs.append(pack(body + planes(table[who], 8) + planes(length[who], 4), b - a, len(who)))
            return pa.RecordBatch.from_arrays([pa.array(at_parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for b in batches:
            for w in _text.words(b.column(0)):
                key, first = gram_sets(w, n)
                size, sid = np.diff(first), set_ids(key, first)
                row, g = key >> _U(BITS), key & _MASK
                _, once = np.unique(sid, return_index=True)  # equal sets of one piece post once
                take = np.zeros(len(size), np.int64)
                take[once] = prefix_sizes(size, threshold)[once]
                # among lists of one class the order is one of hashes, other than that which merge tasks go by
                other = (g * _U(0x9E3779B97F4A7C15)) & _MASK
                order = np.argsort((row << _U(BITS + 8)) | (length_class(classes.value, g) << _U(BITS)) | other)
                rank = np.arange(len(key)) - first[row.astype(np.int64)]
                chosen = order[rank < take[row.astype(np.int64)]]
                keys.append((g[chosen] << _U(24)) | (row[chosen] + _U(held)))
                sids.append(sid)
                sizes.append(size)
                held += len(size)
                count += len(chosen)
                if count > FLUSH or held > 1 << 20:
                    yield flush()
                    keys, sids, sizes, held, count = [], [], [], 0, 0
        if count:
            yield flush()

    def links(a, b, times, need):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none if times is None else pa.array(times), none if need is None else pa.array(need)], ["a", "b", "times", "need"])

    def meet(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(part, []).append(blob)
        while by:
            _, blobs = by.popitem()
            grams, who, sids, sizes, base = [], [], [], [], 0
            while blobs:
                k, d, body = unpack(blobs.pop())
                grams.append(np.cumsum(unplanes(body, k, 5, 0)))
                who.append(unplanes(body, k, 3, 5 * k) + _U(base))
                sids.append(unplanes(body, d, 8, 8 * k))
                sizes.append(unplanes(body, d, 4, 8 * k + 8 * d))
                base += d
            sids, at, inverse = np.unique(np.concatenate(sids).view(np.int64), return_index=True, return_inverse=True)
            sizes = np.concatenate(sizes)[at].astype(np.int64)
            g, who = np.concatenate(grams), inverse[np.concatenate(who).astype(np.int64)]
            order = np.argsort(g, kind="stable")
            g, who = g[order], who[order]
            same = g[1:] == g[:-1]
            hit = np.append(same, False) | np.append(False, same)
            g, who = g[hit], who[hit]
            order = np.lexsort((who, sizes[who], g))
            g, who = g[order], who[order]
            once = np.append(True, (g[1:] != g[:-1]) | (who[1:] != who[:-1]))[: len(g)]
            g, who = g[once], who[once]
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
            length = np.diff(np.append(start, len(g)))
            crowd = np.repeat(length > CROWD, length)
            if crowd.any():  # sids ascend, so the smallest number is that of the smallest sid
                big = length > CROWD
                first = np.repeat(np.minimum.reduceat(who, start)[big], length[big])
                x = np.unique((first.astype(np.uint64) << _U(32)) | who[crowd].astype(np.uint64))
                yield links(sids[(x >> _U(32)).astype(np.int64)], sids[(x & _U(0xFFFFFFFF)).astype(np.int64)], None, None)
                g, who = g[~crowd], who[~crowd]
            size = sizes[who]
            found, times, live, step, pending = [], [], np.arange(len(g)), 1, 0
            while len(live):
                live = live[live + step < len(g)]
                live = live[(g[live + step] == g[live]) & (size[live] >= threshold * size[live + step] - 1e-9)]
                x, y = who[live], who[live + step]
                found.append((np.minimum(x, y).astype(np.uint64) << _U(32)) | np.maximum(x, y).astype(np.uint64))
                times.append(np.ones(len(live), np.int32))
                pending += len(live)
                if pending > FLUSH:
                    x, n = add_up(found, times)
                    found, times, pending = [x], [n], 0
                step += 1
            if not found:
                continue
            x, n = add_up(found, times)
            i, j = (x >> _U(32)).astype(np.int64), (x & _U(0xFFFFFFFF)).astype(np.int64)
            most = np.maximum(sizes - prefix_sizes(sizes, threshold), 0)  # in longer lists
            need = np.ceil(threshold / (1 + threshold) * (sizes[i] + sizes[j]) - 1e-9).astype(np.int64) - np.maximum(most[i], most[j])
            a, b = sids[i], sids[j]
            yield links(np.minimum(a, b), np.maximum(a, b), n.astype(np.int64), need)

    def carry(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in _text.words(b.column(1)):
                key, first = gram_sets(w, n)
                sid = set_ids(key, first)
                own = np.flatnonzero((sid != 0) & _spark.marked(wanted_bits.value, ids[w.lo : w.hi], sid))
                if len(own):
                    blob = [planes(key[first[r] : first[r + 1]] & _MASK, 5) for r in own]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + own]), pa.array(sid[own].view(np.int64)), pa.array(blob, pa.binary())], ["doc_id", "sid", "grams"])

    # the postings are the bulk of what is written, so they go from task to task without a table of their own
    posted = docs.select("text").mapInArrow(_text.tidy(post), "part int, blob binary").repartitionById(parts, F.col("part"))
    met = posted.mapInArrow(_text.tidy(meet), "a long, b long, times long, need long")
    met = met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need"), F.max(F.col("need").isNull()).alias("crowd"))
    met, met_path = _spark.cut(met.where("a <> b AND (crowd OR times >= need)").select("a", "b"), "met")
    known, known_path = _spark.cut(docs.mapInArrow(_text.tidy(identify), "doc_id long, sid long, size long").distinct(), "sets")
    first = known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))

    lowest = met.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "a")
    cell = met.join(lowest, "a", "left").select(F.coalesce("low", "a").alias("cell"), "a", "b")
    member = cell.select("cell", F.explode(F.array("a", "b")).alias("sid")).distinct()
    cells = _spark.triangles(member, "cell", "sid", CELL)
    wanted, wanted_path = _spark.cut(first.join(cells, "sid").select("doc_id", "sid", "copies", "cells"), "wanted")
    _spark.drop(spark, met_path)
    # n-grams of the wanted documents alone are shuffled, no texts
    wanted_bits = spark.sparkContext.broadcast(_spark.marks(wanted.select("doc_id", "sid"), parts))
    sets = docs.mapInArrow(_text.tidy(carry), "doc_id long, sid long, grams binary").join(wanted, ["doc_id", "sid"])
    # the cells of a row go with each copy of it, as the place of a pair is the least that both have
    every = F.array_sort(F.array_distinct("cells.cell")).alias("every")
    sets = sets.select(F.explode("cells").alias("c"), every, "doc_id", "sid", "copies", "grams")
    sets = sets.select("c.cell", "c.sub", "c.bucket", F.col("every").alias("cells"), "doc_id", "sid", "copies", "grams")
    return known, sets.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "sid"), [wanted_path, known_path]


def _search(sets: DataFrame, threshold: float, as_pairs: bool) -> DataFrame:
    """divide_skip() in every cell: pairs of doc_ids, or for each document its links and a smaller one that it is connected to."""

    def run(batches):
        now, rows, sets = None, [], []

        def done():
            if len(sets) < 2:
                return
            bucket, cells, ids, own, copies = (list(x) for x in zip(*rows))
            ids, own, copies = np.array(ids), np.array(own), np.array(copies)
            here = _spark.Meeting(now, np.array(bucket), cells)
            size = np.array([len(x) for x in sets])
            if as_pairs:
                for i, j, o in divide_skip(sets, threshold):
                    ok = here.first(i, j)
                    j, o = j[ok], o[ok]
                    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(o), pa.array(o / (size[i] + size[j] - o))], ["doc_a", "doc_b", "overlap", "jaccard"])
                return
            links, label = np.zeros(len(ids), np.int64), np.argsort(np.argsort(ids))  # the smallest doc_id has the smallest label
            for i, j, _ in divide_skip(sets, threshold):
                label = _spark.connect(label, i, j)
                j = j[here.first(i, j)]
                links[i] += copies[j].sum()
                links[j] += copies[i]
            root = np.sort(ids)[label]
            use = np.flatnonzero((links > 0) | (root != ids))
            yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(ids[use]), pa.array(links[use]), pa.array(root[use])], ["sid", "doc_id", "links", "root"])

        for b in batches:
            for cell, sub, bucket, cells, doc, sid, copies, blob in zip(*(b.column(k).to_pylist() for k in range(8))):
                if (cell, sub) != now:
                    yield from done()
                    now, rows, sets, last = (cell, sub), [], [], None
                if sid != last:
                    last = sid
                    rows.append((bucket, cells, doc, sid, copies))
                    sets.append(unplanes(blob, len(blob) // 5, 5, 0))
        yield from done()

    return sets.mapInArrow(_text.tidy(run), "doc_a long, doc_b long, overlap long, jaccard double" if as_pairs else "sid long, doc_id long, links long, root long")


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Class and number of links of each document of docs (doc_id, text) that has any; see the module for the result."""
    spark = docs.sparkSession
    known, sets, paths = _cells(docs, n, threshold)
    found, path = _spark.cut(_search(sets, threshold, False), "links")
    _spark.drop(spark, paths[0])
    out = _spark.classes(known, found, "doc_id")
    for p in (paths[1], path):
        _spark.drop(spark, p)
    return out


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of docs (doc_id, text) at or over the threshold; see the module for the result."""
    known, sets, _ = _cells(docs, n, threshold)
    first = known.groupBy("sid").agg(F.min("doc_id").alias("doc_a"))
    equal = known.join(first, "sid").where("doc_id > doc_a")
    copies = equal.select("doc_a", F.col("doc_id").alias("doc_b"), F.col("size").alias("overlap"), F.lit(1.0).alias("jaccard"))
    return _search(sets, threshold, True).where("doc_a <> doc_b").unionByName(copies)


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs but for those whose doc_id is in a class and not its smallest; rows with a null doc_id stay, and so do all columns, whatever their names."""
    return _spark.without(docs, linked(docs, n, threshold).where("doc_id <> class_id").select("doc_id"), "doc_id")


SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"

SQL = rf"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {SQL_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END)) AS g FROM w WHERE len(ws) > 0),
r AS (SELECT min(doc_id) AS doc_id, g, len(g) AS n FROM s GROUP BY g),
p AS (SELECT doc_id, n, unnest(g) AS x FROM r),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS overlap
  FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 2 * a.n >= b.n AND 2 * b.n >= a.n GROUP BY ALL),
k AS (SELECT g, count(*) AS copies FROM s GROUP BY g),
c AS (SELECT r.doc_id, copies, r.g FROM r JOIN k ON r.g = k.g),
l AS (SELECT doc_a, doc_b FROM o WHERE 2 * overlap >= na + nb - overlap),
b AS (SELECT doc_a AS x, doc_b AS y FROM l UNION ALL SELECT doc_b, doc_a FROM l),
d AS (SELECT c.doc_id, c.g, c.copies - 1 + coalesce(sum(p.copies), 0) AS links FROM c LEFT JOIN b ON b.x = c.doc_id LEFT JOIN c p ON p.doc_id = b.y GROUP BY c.doc_id, c.g, c.copies),
t AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT t.x, b.y FROM t JOIN b ON t.y = b.x),
m AS (SELECT x, min(y) AS class_id FROM t GROUP BY x)
SELECT s.doc_id, class_id, links::BIGINT AS links FROM s JOIN d ON s.g = d.g JOIN m ON m.x = d.doc_id WHERE links > 0
"""
