"""Benchmark decontamination: finds documents that hold a benchmark item, word for word or with some words edited.

A document leaks an item of n words if the edit distance (words inserted, deleted, replaced) between the item and some
run of the document's words is at most floor(rate * n).

1. CGK embedding: a random walk copies a window's words to a longer string; at every step bits drawn for the step
   and the word decide whether the walk goes on to the next word. Edit distance becomes Hamming distance.
2. Bit sampling: each table compares the embeddings of item and window at a few sampled steps. For each class of item
   sizes, walks and tables are added until edited copies of the items, made at the highest rate, are found at the
   target recall. Windows start at every word, and reach over the size of the class's items.
3. k edits change at most 2k pairs of neighbouring words. Windows of which too few pairs occur in the benchmark for any
   item of the class are skipped, and so are candidates of which too few occur in the item: necessary conditions both,
   so nothing is missed by them.
4. The rest is verified by the exact edit distance (bit-parallel, over words); the distance that is reported for a
   leak is the least over the whole document.

Items of so few words that no edit is allowed (6 at a rate of 0.15) are found by equal hashes of runs of as many words, each
compared with the item, so exactly.

Words are lower-cased runs of letters and digits, so case, punctuation and white space make no difference. All items with
at least min_words words count (1 by default: items of one word, too, are found wherever that stands); null ones and those
without words are ignored. If the target recall can't be reached with WALKS walks, an error is raised. The index of up to SLICE items is shared at a
time; larger benchmarks take several scans.

Result of find_leaks(): doc_id, item_id, distance, end_word (exclusive, of the first best run). Null or empty texts leak
nothing. Rows whose doc_id is null are checked all the same. Repeated rows and repeated items give a row each. Extra
columns are ignored; an empty table gives an empty result. clean() returns the rows of docs that leak nothing, unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

RATE, MIN_WORDS, SLICE, WALKS = 0.15, 1, 100_000, 400
_U = np.uint64
_C = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def coins(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """64 random bits of each word for the steps from 64 * step on; none for the end mark 0."""
    x = _text.mix((h ^ _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + _U(step))
    x[h == 0] = 0
    return x


def walk(h: np.ndarray, at: np.ndarray, seed: int, steps: int, bits: list[np.ndarray] | None = None) -> np.ndarray:
    """CGK embedding (a row for each step) of the windows of h that start at the places at; a 0 in h ends a text."""
    at = at.copy()
    out = np.empty((steps, len(at)), np.uint64)
    for j in range(steps):
        np.take(h, at, out=out[j])
        b = bits[j >> 6][at] if bits else coins(out[j], seed, j >> 6)
        at += (b >> _U(j & 63) & _U(1)).astype(np.int64)
    return out


def marked(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end mark behind each row, and each row's first place (with the end at last)."""
    rows = len(first) - 1
    out = np.zeros(len(hashes) + rows, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(first))] = np.maximum(hashes, _U(1))
    return out, first + np.arange(rows + 1)


def pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one (0 behind the last)."""
    x = h * _C[0]
    x[:-1] += h[1:]
    x *= _C[1]
    return x ^ (x >> _U(31))


def distance(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of a pattern of n words (bit masks by word) to any run of the text, and the first best end."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for i, x in enumerate(text):
        eq = masks.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += ((ph & top) > 0) - ((mh & top) > 0)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Class:
    """Items of n_lo..n_hi words and their tables."""

    def __init__(self, items: list[np.ndarray], ids: list[int], rate: float, recall: float, seed: int, per_walk: int = 48, sampled: int = 3, walks: int | None = None):
        self.n_lo, self.n_hi = min(map(len, items)), max(map(len, items))
        most = int(rate * self.n_hi)
        self.steps = max(sampled, int(1.6 * self.n_lo))
        self.reach, self.least = max(1, self.n_lo - most - 1), self.n_lo - 1 - 3 * most  # of so many pairs, so many must be known
        rng = np.random.default_rng(seed + self.n_lo)
        h, first = marked(np.concatenate(items), np.cumsum([0, *map(len, items)]))
        tries = []
        for i in rng.permutation(len(items))[:200]:
            for _ in range(1 + 200 // min(200, len(items))):
                x = items[i].tolist()
                for _ in range(int(rate * len(x))):
                    kind, p = rng.integers(3), int(rng.integers(len(x)))
                    if kind == 2:
                        del x[p]
                    else:
                        x[p : p + int(kind)] = [int(rng.integers(1, 1 << 62))]
                tries.append((i, np.array(x, np.uint64)))
        eh, efirst = marked(np.concatenate([x for _, x in tries]), np.cumsum([0, *(len(x) for _, x in tries)]))
        source, hit = np.array([i for i, _ in tries]), np.zeros(len(tries), bool)
        self.walks: list[tuple[int, list]] = []
        self.recall = 0.0
        while self.recall < recall:
            if len(self.walks) >= (WALKS if walks is None else walks):
                raise ValueError(f"items of {self.n_lo} to {self.n_hi} words are found at a recall of {self.recall:.3f} only")
            s = int(rng.integers(1, 1 << 60))
            own, edited = walk(h, first[:-1], s, self.steps), walk(eh, efirst[:-1], s, self.steps)
            same = own[:, source] == edited
            tables = []
            for _ in range(per_walk):
                steps = np.sort(rng.choice(self.steps, sampled, replace=False))
                hit |= same[steps].all(axis=0)
                key = self.key(own, steps)
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[key >> _U(48)] = True
                tables.append((steps, key[order], np.array(ids)[order], seen))
            self.walks.append((s, tables))
            self.recall = float(hit.mean())

    @staticmethod
    def key(rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
        x = rows[steps[0]] * _C[0]
        for k, j in enumerate(steps[1:], 1):
            x = (x ^ (x >> _U(32))) * _C[k % 3] + rows[j] * _C[(k + 1) % 3]
        x ^= x >> _U(29)
        return x * _C[0]

    def candidates(self, h: np.ndarray, starts: np.ndarray, bits: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places and items that agree in some table."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, tables in self.walks:
            bits.setdefault(s, [])
            if len(starts) * 64 > len(h):  # cheaper for all words at once
                bits[s] += [coins(h, s, k) for k in range(len(bits[s]), -(-self.steps // 64))]
            for lo in range(0, len(starts), 4096):
                part = starts[lo : lo + 4096]
                rows = walk(h, part, s, self.steps, bits[s] if len(bits[s]) * 64 >= self.steps else None)
                for steps, keys, ids, seen in tables:
                    x = self.key(rows, steps)
                    at = np.flatnonzero(seen[x >> _U(48)])
                    if not len(at):
                        continue
                    x = x[at]
                    a, b = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
                    n = b - a
                    if n.any():
                        places.append(np.repeat(part[at], n))
                        items.append(ids[np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())])
        return np.concatenate(places), np.concatenate(items)


class Index:
    """A benchmark's items, ready to scan documents for."""

    def __init__(self, rows: list, rate: float = RATE, recall: float = 0.95, min_words: int = MIN_WORDS, seed: int = 5):
        self.rate, self.ids, self.words = rate, [], []
        for w in _text.words(pa.array([r.text for r in rows], pa.string())):
            h = np.maximum(w.hashes(), _U(1))
            for i in range(w.hi - w.lo):
                if w.first[i + 1] - w.first[i] >= max(1, min_words):
                    self.ids.append(rows[w.lo + i].item_id)
                    self.words.append(h[w.first[i] : w.first[i + 1]])
        self.masks: list[dict[int, int]] = []
        for x in self.words:
            m: dict[int, int] = {}
            for k, v in enumerate(x.tolist()):
                m[v] = m.get(v, 0) | 1 << k
            self.masks.append(m)
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.classes, self.exact = [], []
        if not self.words:
            return
        n = 1
        while int(rate * n) == 0 and n <= self.size.max():
            i = np.flatnonzero(self.size == n)
            if len(i):
                key = np.array([_text.shingles(self.words[k], n)[0] for k in i], np.uint64)
                order = np.argsort(key, kind="stable")
                self.exact.append((n, key[order], i[order]))
            n += 1
        bits: dict[int, int] = {}
        for i, x in enumerate(self.words):
            for v in pairs(x)[:-1].tolist():
                bits[v] = bits.get(v, 0) | 1 << (i & 63)
        bits = bits or {0: 0}  # items of one word have no pair
        self.vocab = np.array(sorted(bits), np.uint64)
        self.signs = np.array([bits[v] for v in self.vocab.tolist()], np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocab >> _U(44)] = True
        while n <= self.size.max():
            top = max(n, int(n * 1.2))
            i = np.flatnonzero((self.size >= n) & (self.size <= top)).tolist()
            if i:
                self.classes.append(Class([self.words[k] for k in i], i, rate, recall, seed))
            n = top + 1

    def leaks(self, w: _text.Words) -> list[tuple[int, int, int, int]]:
        """Row, item, distance and end of the leaks in some rows."""
        if not self.classes and not self.exact:
            return []
        h, first = marked(w.hashes(), w.first)
        two = pairs(h)
        sign = np.zeros(len(h), np.uint64)  # of the pair of words here and next, which items (modulo 64) have it
        at = np.flatnonzero(self.maybe[two >> _U(44)])
        p = np.minimum(np.searchsorted(self.vocab, two[at]), len(self.vocab) - 1)
        sign[at] = np.where(self.vocab[p] == two[at], self.signs[p], 0)
        known = np.zeros(len(h) + 1, np.int32)
        np.cumsum(sign != 0, out=known[1:])
        found, bits = [], {}
        for c in self.classes:
            if len(h) < c.reach:
                continue
            starts = np.flatnonzero(known[c.reach :] - known[: -c.reach] >= c.least)
            starts = starts[h[starts] != 0]
            if not len(starts):
                continue
            place, item = c.candidates(h, starts, bits)
            both = np.unique((place.astype(np.uint64) << _U(24)) | item.astype(np.uint64))
            place, item = (both >> _U(24)).astype(np.int64), (both & _U(0xFFFFFF)).astype(np.int64)
            n = self.size[item]
            most = (self.rate * n).astype(np.int64)
            reach, shift, have = n - most - 1, (item & 63).astype(np.uint64), np.zeros(len(place), np.int64)
            for k in range(int(reach.max(initial=0))):
                q = np.minimum(place + k, len(h) - 1)
                have += ((sign[q] >> shift & _U(1)) > 0) & (k < reach)
            ok = have >= n - 1 - 3 * most
            row = np.searchsorted(first, place[ok], "right") - 1
            found += zip(row.tolist(), item[ok].tolist(), place[ok].tolist())
        out, done, failed = [], set(), {}
        for n, keys, items in self.exact:
            if len(h) < n:
                continue
            x = _text.shingles(h, n)
            a, b = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
            for place in np.flatnonzero(b > a).tolist():
                row = int(np.searchsorted(first, place, "right")) - 1
                for item in items[a[place] : b[place]].tolist():
                    if (row, item) not in done and (h[place : place + n] == self.words[item]).all():
                        done.add((row, item))
                        out.append((row, item, 0, place + n - int(first[row])))
        for row, item, place in sorted(found):
            if (row, item) in done or place <= failed.get((row, item), -1):
                continue
            n = len(self.words[item])
            most = int(self.rate * n)
            lo, hi = int(first[row]), int(first[row + 1]) - 1
            text = h[max(lo, place - most) : min(hi, place + n + 2 * most)].tolist()
            if distance(self.masks[item], n, text)[0] <= most:
                done.add((row, item))
                out.append((row, item, *distance(self.masks[item], n, h[lo:hi].tolist())))
            else:
                failed[row, item] = place + most  # what starts up to there was within this text
        return out


def _indexes(spark, benchmark: DataFrame, rate: float, recall: float, min_words: int) -> list:
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    out, rows = [], []
    for r in items.toLocalIterator():
        rows.append(Row(item_id=r.item_id, text=r.text))
        if len(rows) == SLICE:
            out.append(spark.sparkContext.broadcast(Index(rows, rate, recall, min_words)))
            rows = []
    return [*out, spark.sparkContext.broadcast(Index(rows, rate, recall, min_words))] if rows or not out else out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = 0.95, min_words: int = MIN_WORDS) -> DataFrame:
    """Leaks of benchmark (item_id, text) in docs (doc_id, text); see the module for the result."""
    indexes = _indexes(_spark.session(docs), benchmark, rate, recall, min_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(index):
        def run(batches):
            for b in batches:
                ids, out = b.column(0).to_pylist(), []
                for w in _text.words(b.column(1)):
                    out += [(ids[w.lo + r], index.value.ids[i], d, e) for r, i, d, e in index.value.leaks(w)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "item_id", "distance", "end_word"])

        return run

    found = [docs.mapInArrow(_text.tidy(scan(x)), "doc_id long, item_id long, distance long, end_word long") for x in indexes]
    for x in found[1:]:
        found[0] = found[0].union(x)
    return found[0]


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = 0.95, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that leak no item."""
    place = docs.columns.index("text")

    def keep(index):
        def run(batches):
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for w in _text.words(b.column(place)):
                    for r, *_ in index.value.leaks(w):
                        ok[w.lo + r] = False
                yield b.filter(pa.array(ok))

        return run

    for x in _indexes(_spark.session(docs), benchmark, rate, recall, min_words):
        docs = docs.mapInArrow(_text.tidy(keep(x)), docs.schema)
    return docs
