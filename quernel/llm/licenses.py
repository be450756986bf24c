"""License scans: finds licence texts and notices in documents by a generalised suffix automaton of their tokens.

1. One automaton holds every run of tokens of all templates. A document streams through it, which gives for each token
   the longest run ending there that some template has (matching statistics). Only runs of tokens that occur in the
   templates can match, so the rest of the text is stepped over by a table.
2. Matches of at least MIN_MATCH tokens that can't be longer are placed in the templates and, for each template,
   chained: in the order of both texts, with at most GAP tokens between, so that they cover as much as possible.
3. A chain that covers at least coverage of its template is a span. Of spans that overlap by half of the shorter one
   that which matches most is kept, then the better covered, then the first by name.

Result of scan(): doc_id, license, start_word, end_word (exclusive), matched, coverage, n_tokens (of the template).
Tokens are lower-cased runs of letters and digits, so case, punctuation, comment signs and line breaks make no
difference. Null or empty texts have no spans. Rows with a null doc_id are scanned and keep it; repeated rows give
their spans each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _text
from quernel.llm._license_texts import TEMPLATES

MIN_MATCH, GAP, COVERAGE = 3, 12, 0.8


class Automaton:
    """Generalised suffix automaton of token sequences, with the places at which each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[last].append((k, i + 1))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # a run's suffix ends wherever the run does
            if self.link[s] > 0:
                ends[self.link[s]] += ends[s]
        self.ends = [sorted(set(x)) for x in ends]

    def _state(self, length: int, link: int, nexts: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nexts)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the runs that are no longer than those of p and c."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each token the length of the longest run of the templates that ends there, and its state."""
        out, s, n = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for c in tokens:
            while s and c not in nexts[s]:
                s = link[s]
                n = length[s]
            t = nexts[s].get(c)
            if t is None:
                s, n = 0, 0
            else:
                s, n = t, n + 1
            out.append((n, s))
        return out


class Scanner:
    """Templates, ready to scan documents for."""

    def __init__(self, templates: dict[str, str], min_match: int = MIN_MATCH, gap: int = GAP, coverage: float = COVERAGE):
        self.min_match, self.gap, self.coverage = min_match, gap, coverage
        self.names = sorted(n for n in templates if templates[n] and any(len(w.starts) for w in _text.words(pa.array([templates[n]]))))
        ids: dict[int, int] = {}
        self.sequences = []
        for name in self.names:
            h = np.concatenate([w.hashes() for w in _text.words(pa.array([templates[name]]))])
            self.sequences.append([ids.setdefault(x, len(ids)) for x in h.tolist()])
        self.known = np.array(sorted(ids), np.uint64)
        self.ids = np.array([ids[x] for x in self.known.tolist()], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known >> np.uint64(48)] = True
        self.automaton = Automaton(self.sequences)

    def spans(self, w: _text.Words) -> list[tuple[int, int, int, int, int]]:
        """Row, template, start, end and matched tokens of the spans in some rows."""
        h = w.hashes()
        if not len(self.known) or not len(h):
            return []
        at = np.flatnonzero(self.maybe[h >> np.uint64(48)])
        p = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[p] == h[at]
        at, tok = at[ok], self.ids[p[ok]]
        row = np.searchsorted(w.first, at, "right") - 1
        new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0))[: len(at)])
        size = np.diff(np.append(new, len(at)))
        shortest = min(self.min_match, min(map(len, self.sequences)))
        by_row: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for k in np.flatnonzero(size >= shortest).tolist():
            i, n = int(new[k]), int(size[k])
            r, base = int(row[i]), int(at[i] - w.first[row[i]])
            stats = self.automaton.statistics(tok[i : i + n].tolist())
            for j, (m, s) in enumerate(stats):
                if m >= shortest and (j + 1 == n or stats[j + 1][0] <= m):
                    for t, end in self.automaton.ends[s]:
                        if m >= min(self.min_match, len(self.sequences[t])):
                            by_row.setdefault(r, {}).setdefault(t, []).append((base + j + 1 - m, end - m, m))
        out = []
        for r in sorted(by_row):
            found = []
            for t, matches in by_row[r].items():
                found += [(t, a, b, m) for a, b, m in self.chains(matches, len(self.sequences[t]))]
            found.sort(key=lambda x: (-x[3], -x[3] / len(self.sequences[x[0]]), x[0], x[1]))
            kept: list[tuple[int, int, int, int]] = []
            for x in found:
                if all(2 * (min(x[2], y[2]) - max(x[1], y[1])) < min(x[2] - x[1], y[2] - y[1]) for y in kept):
                    kept.append(x)
            out += [(r, *x) for x in sorted(kept, key=lambda x: (x[1], x[0]))]
        return out

    def chains(self, matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
        """Start, end and matched tokens of the chains of (place in the text, place in the template, length) that cover enough."""
        out = []
        matches = sorted(set(matches))
        lo = 0
        while lo < len(matches):  # what is further apart than a gap is never in one chain
            hi, reach = lo + 1, matches[lo][0] + matches[lo][2]
            while hi < len(matches) and matches[hi][0] <= reach + self.gap:
                reach = max(reach, matches[hi][0] + matches[hi][2])
                hi += 1
            left = matches[lo:hi]
            while left:
                chain = self._best(left)
                covered = sum(m for _, _, m in chain)
                if covered < self.coverage * size:
                    break
                a, b = chain[0][0], chain[-1][0] + chain[-1][2]
                out.append((a, b, covered))
                left = [x for x in left if x[0] + x[2] <= a or x[0] >= b]
            lo = hi
        return out

    def _best(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The chain that covers most; overlapping matches are cut at their beginning."""
        best: list[tuple[int, int, tuple[int, int, int]]] = []
        top = 0
        near: list[int] = []
        for i, (a, t, m) in enumerate(matches):
            score, back, piece = m, -1, (a, t, m)
            near = [j for j in near if matches[j][0] + matches[j][2] >= a - self.gap]  # later matches start no earlier
            for j in reversed(near):
                c, u, k = matches[j]
                cut = max(0, c + k - a, u + k - t)
                if c < a and u < t and cut < m and a + cut - c - k <= self.gap and t + cut - u - k <= self.gap and best[j][0] + m - cut > score:
                    score, back, piece = best[j][0] + m - cut, j, (a + cut, t + cut, m - cut)
            best.append((score, back, piece))
            near.append(i)
            if score > best[top][0]:
                top = i
        out = []
        while top >= 0:
            out.append(best[top][2])
            top = best[top][1]
        return out[::-1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_match: int = MIN_MATCH, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """Spans of the templates (name to text; those of _license_texts if None) in docs (doc_id, text)."""
    scanner = Scanner(TEMPLATES if templates is None else templates, min_match, gap, coverage)
    shared = _spark.session(docs).sparkContext.broadcast(scanner)  # as large as the templates

    def run(batches):
        scanner = shared.value
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for w in _text.words(b.column(1)):
                for r, t, a, e, m in scanner.spans(w):
                    n = len(scanner.sequences[t])
                    out.append((ids[w.lo + r], scanner.names[t], a, e, m, m / n, n))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "license", "start_word", "end_word", "matched", "coverage", "n_tokens"])

    schema = "doc_id long, license string, start_word long, end_word long, matched long, coverage double, n_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_text.tidy(run), schema)
