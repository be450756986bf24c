"""Toxicity: subword-bag embeddings averaged into a linear softmax, so that unseen misspellings share n-gram vectors.

A text is as toxic as its worst window of WINDOW words, wherever that stands. Only documents are labelled, so
training alternates: start from how much more often each n-gram occurs in toxic documents than in clean ones, then let
each toxic document contribute its worst windows and each clean one its worst and some random windows, and train anew. Fitted on at most per_class documents of each label
(a documented bound); a third is held out to set the threshold: the middle of the widest gap with the fewest errors.

Result of score(): doc_id, toxicity (0..1), worst_word (first word of the worst window, -1 if none), is_toxic.

Null or empty texts and texts without words score 0 and are not toxic. Rows with a null doc_id keep it. Ties between
windows go to the first. Repeated rows get the same answer each. Labels that are null or of unknown documents are not
trained on; a document with both labels is toxic; unless both labels occur, nothing is toxic. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _subword, _text, langid

WINDOW = 5
BITS = 18


def window_sums(w: _text.Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the values at each byte over the windows that start at each word, the rows of these, and where they end."""
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    rows = w.rows()
    last = np.minimum(np.arange(len(w.starts)) + WINDOW, w.first[1:][rows]) - 1
    return c[w.ends[last]] - c[w.starts], rows, last


class Scorer:
    """A fitted model: each n-gram's score for toxic over clean, the bias, and the threshold on windows."""

    def __init__(self, table: np.ndarray, bias: float, threshold: float):
        self.table, self.bias, self.threshold = table, bias, threshold

    def windows(self, w: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, count = np.zeros(len(w.buf), np.float32), np.zeros(len(w.buf), np.int32)
        for ids in _subword.gram_ids(w.buf, BITS):
            value += self.table[ids]
            count += ids < 1 << BITS
        s, rows, last = window_sums(w, value)
        n = window_sums(w, count)[0]
        return s / np.maximum(n, 1) + self.bias, rows, last

    def worst(self, w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        """Per row its worst window's score and first word; -inf and -1 for rows without words."""
        n = w.hi - w.lo
        top, at = np.full(n, -np.inf), np.full(n, -1)
        full = np.flatnonzero(np.diff(w.first))
        if len(full):
            s, rows, _ = self.windows(w)
            top[full] = np.maximum.reduceat(s, w.first[full])
            hits = np.flatnonzero(s == top[rows])
            r, i = np.unique(rows[hits], return_index=True)
            at[r] = hits[i] - w.first[r]
        return top, at


def _scorer(model: _subword.Model) -> Scorer:
    t = model.table()
    return Scorer(t[:, 1] - t[:, 0], float(model.bias[1] - model.bias[0]), 0.0)


def _odds(chunks: list[_text.Words], y: np.ndarray, held: np.ndarray, least_docs: int) -> Scorer:
    """Scores each n-gram by the log odds of the documents not held out that have it, toxic over clean; 0 if fewer than least_docs have it."""
    n = np.full((2, (1 << BITS) + 1), 0.5)
    for w in chunks:
        ids = _subword.gram_ids(w.buf, BITS)
        for i in range(w.hi - w.lo):
            if not held[w.lo + i]:
                n[y[w.lo + i], np.unique(np.concatenate([v[w.offs[i] : w.offs[i + 1]] for v in ids]))] += 1
    share = n / (np.array([[(~held & (y == k)).sum() for k in (0, 1)]]).T + 1)
    table = np.log(share[1] / share[0])
    table[n.sum(axis=0) < 1 + least_docs] = 0
    table[-1] = 0
    return Scorer(table.astype(np.float32), 0.0, 0.0)


def fit(rows: list, dim: int = 16, rounds: int = 3, epochs: int = 8, rate: float = 0.5, least_docs: int = 2, per_toxic: int = 3, per_clean: int = 4, seed: int = 11) -> Scorer | None:
    """Fits on rows (text, label 0 or 1). Parameters of the training: documents that an n-gram must be in to count at
    the start, and windows that a toxic document (its worst that share no word with the very worst) and a clean one (its worst, others at random) contribute."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if r.text and r.label in (0, 1)]
    y = np.array([r.label for r in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    held = rng.permutation(len(rows)) < len(rows) // 3
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    chunks = list(_text.words(pa.array([r.text for r in rows]), 1 << 18))
    scorer = _odds(chunks, y, held, least_docs)
    for step in range(rounds):
        bags, labels = [], []
        for w in chunks:
            ids = _subword.gram_ids(w.buf, BITS)
            s, _, last = scorer.windows(w)
            for i in range(w.hi - w.lo):
                lo, hi = w.first[i], w.first[i + 1]
                if held[w.lo + i] or lo == hi:
                    continue
                label = y[w.lo + i]
                order = lo + np.argsort(-s[lo:hi], kind="stable")
                chosen = [int(order[0])] if label else [int(order[0]), *rng.integers(lo, hi, per_clean - 1).tolist()]
                if label:
                    apart = order[(np.abs(order - order[0]) >= WINDOW) & (s[order] > 0)]
                    chosen += apart[: per_toxic - 1].tolist()
                for k in chosen:
                    bags.append(_subword.bag(ids, w.starts[k], w.ends[last[k]], BITS))
                    labels.append(label)
        model = _subword.Model(2, BITS, dim, seed)
        model.train(bags, np.array(labels), epochs, rate, seed + step)
        scorer = _scorer(model)
    top = np.concatenate([scorer.worst(w)[0] for w in chunks])
    use = (held if held.any() else np.ones(len(y), bool)) & np.isfinite(top)
    order = np.argsort(top[use], kind="stable")
    s, t = top[use][order], y[use][order]
    wrong = np.cumsum(np.append(0, t)) + np.append(np.cumsum((1 - t)[::-1])[::-1], 0)  # errors when the first k count as clean
    gaps = np.diff(np.concatenate([[s[0] - 1], s, [s[-1] + 1]]))
    k = max(range(len(wrong)), key=lambda i: (-wrong[i], gaps[i]))
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    scorer.threshold = float((edge[k] + edge[k + 1]) / 2)
    return scorer


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Scorer | None:
    """Fits on at most per_class documents of each label."""
    # the least label counts, so toxic is 0 and clean 1 here
    ids = _spark.some_of_each(labels.where("toxic IN (0, 1)").select("doc_id", (1 - F.col("toxic")).alias("label")), per_class)
    ids = ids.select("doc_id", (1 - F.col("label")).alias("label"))
    _spark.session(docs)
    return _spark.fit_in_task(_spark.matching(docs.where("text IS NOT NULL").select("doc_id", "text"), ids, "doc_id"), fit)


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Toxicity of every row of docs (doc_id, text)."""
    shared = _spark.session(docs).sparkContext.broadcast(scorer)

    def run(batches):
        scorer = shared.value
        for b in batches:
            n = b.num_rows
            p, at, bad = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
            if scorer is not None:
                for w in _text.words(b.column(1)):
                    top, at[w.lo : w.hi] = scorer.worst(w)
                    p[w.lo : w.hi] = 1 / (1 + np.exp(-np.clip(top - scorer.threshold, -50, 50)))
                    p[w.lo : w.hi][~np.isfinite(top)] = 0
                    bad[w.lo : w.hi] = top > scorer.threshold
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(at), pa.array(bad)], ["doc_id", "toxicity", "worst_word", "is_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_text.tidy(run), "doc_id long, toxicity double, worst_word long, is_toxic boolean")


def clean(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The rows of docs that are not toxic, with all columns."""
    shared = _spark.session(docs).sparkContext.broadcast(scorer)
    place = docs.columns.index("text")

    def run(batches):
        scorer = shared.value
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            if scorer is not None:
                for w in _text.words(b.column(place)):
                    ok[w.lo : w.hi] = scorer.worst(w)[0] <= scorer.threshold
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(_text.tidy(run), docs.schema)
