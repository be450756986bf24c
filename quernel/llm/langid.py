"""Language ID: averaged hashed subword embeddings with a linear softmax, with calibrated rejection.

The model is fitted on at most per_class labelled rows of each language (a documented bound), on their whole texts.
A fifth of them is held out: it sets the softmax temperature (least log loss), the confidence under which a text
is rejected (the least at which precision target is met) and the share of known n-grams that a text needs.

Result of identify(): doc_id, lang_pred ('und' if rejected), confidence, accepted; one row per input row.

Null or empty texts and texts without letters are 'und' with confidence 0. Rows with a null doc_id keep it.
Repeated rows get the same answer each. Null labels are not trained on; of several labels of one doc_id the least counts; without labels every text is 'und'.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _subword, _text

UNKNOWN = "und"


class Identifier:
    """A fitted model: class names, n-gram scores with a last column of known n-grams, temperature and thresholds."""

    def __init__(self, names, table, bias, bits, temperature, least, known):
        self.names, self.table, self.bias, self.bits = names, table, bias, bits
        self.temperature, self.least, self.known = temperature, least, known

    def sums(self, w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        """Per row the sum of its n-grams' scores, known ones counted last, and their number."""
        n = w.hi - w.lo
        total, count = np.zeros((n, self.table.shape[1])), np.zeros(n)
        full = np.flatnonzero(np.diff(w.offs))
        if len(full):
            for ids in _subword.gram_ids(w.buf, self.bits):
                total[full] += np.add.reduceat(self.table[ids], w.offs[full], axis=0, dtype=np.float64)
                count[full] += np.add.reduceat(ids < 1 << self.bits, w.offs[full], dtype=np.int64)
        return total, count

    def predict(self, w: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total, count = self.sums(w)
        mean = total / np.maximum(count, 1)[:, None]
        z = (mean[:, :-1] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best, conf = p.argmax(axis=1), p.max(axis=1)
        conf[count == 0] = 0
        return best, conf, (count > 0) & (conf >= self.least) & (mean[:, -1] >= self.known)


def sample(docs: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class rows (doc_id, text, label) of each label, by a hash of doc_id; only ids are ranked, not texts."""
    ids = _spark.some_of_each(docs.select("doc_id", F.col(label).alias("label")), per_class)
    return _spark.matching(docs.where("text IS NOT NULL").select("doc_id", "text"), ids, "doc_id")


def fit(rows: list, bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, precision: float = 0.999, seed: int = 7) -> Identifier | None:
    """Fits on the whole texts of rows (text, label)."""
    names = sorted({r.label for r in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    bags = []
    for r in rows:
        for w in _text.words(pa.array([r.text])):
            bags.append(_subword.bag(_subword.gram_ids(w.buf, bits), 0, len(w.buf), bits))
    labels = np.array([names.index(r.label) for r in rows])
    held = rng.permutation(len(rows)) < len(rows) // 5
    model = _subword.Model(len(names), bits, dim, seed)
    model.train([b for b, h in zip(bags, held) if not h], labels[~held], epochs, rate, seed)
    held &= np.array([len(b[0]) > 0 for b in bags])
    temperature, least, known = 1.0, 0.0, 0.0
    if held.any():
        z, y = model.logits([b for b, h in zip(bags, held) if h]), labels[held]

        def at(t: float) -> np.ndarray:
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return p / p.sum(axis=1, keepdims=True)

        temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(at(t)[np.arange(len(y)), y] + 1e-12).mean())
        p = at(temperature)
        order = np.argsort(-p.max(axis=1))
        right = np.cumsum(p.argmax(axis=1)[order] == y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
        if len(good) == len(y):  # all may stay: reject only what is less certain than any held-out text by half its lead over chance
            least = 1 / len(names) + (least - 1 / len(names)) / 2
        known = 0.5 * float(np.quantile([share[model.seen[ids]].sum() for (ids, share), h in zip(bags, held) if h], 0.01))
    table = np.hstack([model.table(), np.append(model.seen, False)[:, None].astype(np.float32)])
    return Identifier(names, table, model.bias, bits, float(temperature), least, known)


def identify(docs: DataFrame, labelled: DataFrame | None = None, label: str = "lang", per_class: int = 800) -> DataFrame:
    """Language of every row of docs (doc_id, text), fitted on labelled (doc_id, text and label; docs itself if None)."""
    spark = _spark.session(docs)
    model = _spark.fit_in_task(sample(docs if labelled is None else labelled, label, per_class), fit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            names, conf, ok = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            if model is not None:
                every = np.array([*model.names], object)
                for w in _text.words(b.column(1)):
                    best, conf[w.lo : w.hi], ok[w.lo : w.hi] = model.predict(w)
                    names[w.lo : w.hi] = np.where(ok[w.lo : w.hi], every[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(conf), pa.array(ok)], ["doc_id", "lang_pred", "confidence", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_text.tidy(run), "doc_id long, lang_pred string, confidence double, accepted boolean")
