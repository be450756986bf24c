"""Suffix-array dedup: finds every run of min_words words that occurs more than once in the corpus.

A sparse suffix array over minimiser anchors, built by a common-prefix-aware distributed merge sort:

1. Each window of min_words words names its smallest k-gram as anchor. Equal windows name the same anchor at the
   same offset, so comparing windows of one anchor with windows of equal anchors misses no repeat.
2. Anchors whose k-gram occurs once in the whole corpus cannot lie in a repeat and are left out before the sort.
3. Each map task sorts its anchors' suffixes into runs, collapses identical ones, front-codes them (length of the
   prefix shared with the predecessor, then the rest) and sends each run's ranges to their merge task.
4. A merge task combines the runs by a loser tree that keeps common prefix lengths: strings are compared only
   behind the prefix both are known to share. The merged order comes with its LCP array.
5. Within an anchor's interval of the array, right LCP and common left context tell which windows are repeated.

Result: doc_id, start_word, end_word (exclusive), n_words: the merged spans of each document that are covered by
repeated windows; every occurrence is reported, the first as well. Words are lower-cased runs of letters and
digits, so case, punctuation and white space make no difference.

Null or empty texts and documents under min_words words give no rows, and neither do rows whose doc_id is null.
Repeated rows are repeats of each other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

K = 8
#: Sorted suffixes of one run, and about how many a merge task gets.
RUN_BYTES = 24 << 20
PART_RECORDS = 60_000


def anchors(w: _text.Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: its k-gram's hash, its word, the first and the last of the windows that name it."""
    h = w.hashes()
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return np.zeros(0, np.uint64), none, none, none
    g = _text.shingles(h, K)
    span = min_words - K + 1
    x = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    m, size = x, 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of each window
    ok = np.zeros(len(at) + 1, bool)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        if hi - lo >= min_words:
            ok[lo : hi - min_words + 1] = True
    new = np.empty(len(at), bool)
    new[:1] = True
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-2]
    firsts = np.flatnonzero(new & ok[:-1])
    if not len(firsts):
        return np.zeros(0, np.uint64), none, none, none
    ends = np.flatnonzero(ok[:-1] & (np.append(new[1:], True) | ~ok[1:]))
    a = at[firsts]
    # anchors are small hashes; mixed again they are spread evenly over the merge tasks
    return _text.mix(g[a]), a, firsts, ends


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of which known bytes are known to be equal."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8


def encode(run: list[tuple[bytes, bytes, int, int, int, int, int]]) -> bytes:
    """A sorted run, front-coded. An entry: key, reversed left context, doc, anchor's word, window offsets from and to, 1 if known as a repeat."""
    head = np.zeros((len(run), 7), np.int64)
    tails, last = [], b""
    for i, (key, left, doc, word, a0, a1, dup) in enumerate(run):
        p = lcp(last, key)
        head[i] = (p, len(key) - p, len(left), doc, word, a0 | a1 << 16, dup)
        tails += (key[p:], left)
        last = key
    body = b"".join(tails)
    return struct.pack("<q", len(run)) + pa.compress(head.T.tobytes() + body, codec="zstd", asbytes=True) + struct.pack("<q", head.nbytes + len(body))


def decode(blob: bytes) -> Iterator[tuple]:
    """Entries of a run with the prefix length that each shares with its predecessor."""
    (n,), (size,) = struct.unpack("<q", blob[:8]), struct.unpack("<q", blob[-8:])
    data = pa.decompress(blob[8:-8], decompressed_size=size, codec="zstd", asbytes=True)
    at, last = n * 56, b""
    for p, rest, nl, doc, word, a, dup in np.frombuffer(data, np.int64, n * 7).reshape(7, n).T.tolist():
        key = last[:p] + data[at : at + rest]
        at += rest
        yield key, p, data[at : at + nl], doc, word, a & 0xFFFF, a >> 16, dup
        at += nl
        last = key


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs by a loser tree; yields entries whose second field is the prefix shared with the entry before."""
    k = 1
    while k < len(runs):
        k *= 2
    nexts = [r.__next__ for r in runs]
    head: list[tuple | None] = [None] * k
    known = [0] * k  # prefix that each head shares with the last string that came out at or above its node

    def pull(i: int) -> None:
        try:
            head[i] = nexts[i]()
            known[i] = head[i][1]
        except (StopIteration, IndexError):
            head[i], known[i] = None, -1

    def beats(i: int, j: int) -> bool:
        """Whether i comes out before j; the loser's known prefix is then that with the winner."""
        a, b = head[i], head[j]
        if a is None:
            return False
        if b is None:
            return True
        if known[i] != known[j]:
            return known[i] > known[j]
        x, y, h = a[0], b[0], known[i]
        p = lcp(x, y, h)
        if p == len(x) or (p < len(y) and x[p] < y[p]):
            known[j] = p
            return True
        known[i] = p
        return False

    for i in range(k):
        pull(i)
        known[i] = 0 if head[i] is not None else -1
    tree = [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        i, j = build(2 * node), build(2 * node + 1)
        if beats(i, j):
            tree[node] = j
            return i
        tree[node] = i
        return j

    win = build(1) if k > 1 else 0
    while head[win] is not None:
        e = head[win]
        yield (e[0], known[win], *e[2:])
        pull(win)
        node = (win + k) >> 1
        while node:
            j = tree[node]
            # the usual case, without a call: prefixes of different length decide
            if known[win] < known[j] or (known[win] == known[j] and not beats(win, j)):
                tree[node], win = win, j
            node >>= 1


def spans_of(group: list[tuple], lcps: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """Repeated spans among the sorted entries of one anchor; lcps[i]: words shared to the right by entries i-1 and i."""
    n = len(group)
    if n <= 12:
        for i in range(n - 1):
            right = 1 << 30
            for j in range(i + 1, n):
                right = min(right, lcps[j])
                x, y = group[i], group[j]
                if x[7] and y[7]:
                    continue
                left = x[2].count(b" ", 0, lcp(x[2], y[2]))
                lo, hi = max(x[5], y[5], min_words - right), min(x[6], y[6], left)
                if lo <= hi:
                    for e in (x, y):
                        if not e[7]:
                            yield e[3], e[4] - hi, e[4] - lo + min_words
        return
    width = max(e[6] for e in group) + 1
    ctx = np.zeros((n, width), np.uint64)  # hash of the a words on the left
    for i, e in enumerate(group):
        ws = e[2].split(b" ")[: e[6]]
        ctx[i, 1 : len(ws) + 1] = [hash(x) & 0xFFFFFFFFFFFFFFFF for x in ws]
    for a in range(1, width):
        ctx[:, a] = _text.mix(ctx[:, a] + ctx[:, a - 1] * np.uint64(0x100000001B3) + np.uint64(a))
    order = np.argsort(ctx, axis=0, kind="stable")
    levels = [np.array([1 << 30, *lcps[1:]], np.int64)]
    while (1 << len(levels)) <= n:
        prev, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(prev, np.append(prev[step:], np.full(step, 1 << 30))))
    table = np.stack(levels)
    lo_a, hi_a = np.array([e[5] for e in group]), np.array([e[6] for e in group])
    hit = np.zeros((n, width), bool)
    cols = np.arange(width)
    ok = (cols >= lo_a[:, None]) & (cols <= hi_a[:, None])
    for a in range(width):
        o = order[:, a]
        o = o[ok[o, a]]
        if len(o) < 2:
            continue
        p, q = o[:-1], o[1:]
        same = ctx[p, a] == ctx[q, a]  # then p < q
        p, q = p[same], q[same]
        lv = np.frompyfunc(int.bit_length, 1, 1)(q - p).astype(np.int64) - 1
        right = np.minimum(table[lv, p + 1], table[lv, q - (1 << lv) + 1])
        same = right + a >= min_words
        hit[p[same], a] = True
        hit[q[same], a] = True
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        e = group[i]
        if not e[7]:
            at = np.flatnonzero(hit[i])
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                yield e[3], e[4] - int(part[-1]), e[4] - int(part[0]) + min_words


def find_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Spans of at least min_words words that occur again, in any document; see the module for the result."""
    if min_words < K + 1:
        raise ValueError(f"min_words must be over {K}")
    spark = _spark.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def scan(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in _text.words(b.column(1)):
                h, a, _, _ = anchors(w, min_words)
                if len(h):
                    row = np.searchsorted(w.first, a, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + row]), pa.array(h.view(np.int64))], ["doc_id", "h"])

    def make_runs(batches):
        pending, size = [], 0
        schema = ["part", "run", "doc_id", "start_word", "end_word"]

        def flush():
            pending.sort()
            out, spans, i = {}, [], 0
            while i < len(pending):
                j = i + 1
                while j < len(pending) and pending[j][0] == pending[i][0] and pending[j][1] == pending[i][1]:
                    j += 1
                e = pending[i]
                if j > i + 1:
                    spans += [(x[2], x[3] - x[5], x[3] - x[4] + min_words) for x in pending[i:j]]
                part = int.from_bytes(e[0][:4], "big") * parts >> 32
                out.setdefault(part, []).append((*e[:6], int(j > i + 1)))
                i = j
            for part, run in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([encode(run)], pa.binary()), *[pa.array([None], pa.int64())] * 3], schema)
            if spans:
                s = np.array(spans, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.nulls(s.shape[1], pa.int32()), pa.nulls(s.shape[1], pa.binary()), *map(pa.array, s)], schema)

        for b in batches:
            ids, keep = b.column(0).to_pylist(), b.column(2)
            for w in _text.words(b.column(1)):
                h, a, s0, s1 = anchors(w, min_words)
                if not len(h):
                    continue
                row = np.searchsorted(w.first, a, "right") - 1
                values = keep.slice(w.lo, w.hi - w.lo)
                known = values.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(w.hi - w.lo), np.diff(_offsets(values)))
                # a survivor has its (row, hash) among the repeated ones of that row
                mine = np.flatnonzero(np.isin(_text.mix(h + row.astype(np.uint64)), _text.mix(known + owner.astype(np.uint64))))
                text = w.buf.tobytes()
                first, starts, ends = w.first.tolist(), w.starts.tolist(), w.ends.tolist()
                for x, p, lo, hi, r in zip(h[mine].tolist(), a[mine].tolist(), s0[mine].tolist(), s1[mine].tolist(), row[mine].tolist()):
                    key = x.to_bytes(8, "big") + text[starts[p] : ends[hi + min_words - 1] + 1]
                    left = text[starts[lo] : starts[p]].split()
                    left = b" ".join(left[::-1]) + b" " if left else b""
                    pending.append((key, left, ids[w.lo + r], p - first[r], p - hi, p - lo))
                    size += len(key) + len(left) + 200
                if size > RUN_BYTES:
                    yield from flush()
                    pending, size = [], 0
        yield from flush()

    def merge_runs(batches):
        runs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs.setdefault(part, []).append(blob)
        names = ["doc_id", "start_word", "end_word"]
        for part in sorted(runs):
            out, group, lcps = [], [], []
            for e in merge([decode(x) for x in runs.pop(part)]):
                if group and e[1] < 8:
                    if len(group) > 1:
                        out += spans_of(group, lcps, min_words)
                    group, lcps = [], []
                group.append(e)
                lcps.append(e[0].count(b" ", 8, e[1]) if len(group) > 1 else 0)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, np.array(out, np.int64).T)], names)
                    out = []
            if len(group) > 1:
                out += spans_of(group, lcps, min_words)
            if out:
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.array(out, np.int64).T)], names)

    found, found_path = _spark.cut(docs.mapInArrow(_text.tidy(scan), "doc_id long, h long"), "anchors")
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    per_doc, doc_path = _spark.cut(
        found.join(again, "h").distinct().groupBy("doc_id").agg(F.collect_list("h").alias("hs")), "repeated-anchors"
    )
    _spark.drop(spark, found_path)
    total = per_doc.agg(F.sum(F.size("hs"))).first()[0] or 0
    parts = max(1, -(-total // PART_RECORDS))
    runs, runs_path = _spark.cut(
        docs.join(per_doc, "doc_id").mapInArrow(_text.tidy(make_runs), "part int, run binary, doc_id long, start_word long, end_word long"), "runs"
    )
    _spark.drop(spark, doc_path)
    merged = (
        runs.where("part IS NOT NULL")
        .select("part", "run")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(_text.tidy(merge_runs), "doc_id long, start_word long, end_word long")
    )
    return islands(merged.union(runs.where("part IS NULL").select("doc_id", "start_word", "end_word")))


def _offsets(values: pa.ListArray) -> np.ndarray:
    return np.asarray(values.offsets)


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one."""
    by_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.when(F.col("start_word") <= before, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(by_doc))
    return (
        marked.groupBy("doc_id", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    )


SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"

SQL = rf"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
x AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) AS h FROM p),
d AS (SELECT doc_id, s FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
m AS (SELECT doc_id, s, CASE WHEN s <= 50 + lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM d),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m)
SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word, max(s) + 50 - min(s) AS n_words FROM i GROUP BY doc_id, island
"""
