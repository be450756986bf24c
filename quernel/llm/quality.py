"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A passage is PASSAGE tokens (runs of other than ASCII white space) in a row. It is encoded by the mean of the hashed embeddings
of its tokens, of their endings and of how they repeat earlier ones, through a tanh layer. Gated attention,
softmax over passages of w . (tanh(V h) * sigmoid(U h)), weighs the encodings; a logistic layer scores the
weighted mean. All of it, embeddings included, is trained in numpy by gradient descent from document labels alone, on
at most per_class documents of each label (a documented bound). A fifth is held out to set the threshold.

Result of score(): doc_id, quality (0..1), is_good, n_passages, top_passage (from 0) and top_weight, the passage with most
attention. All passages of a document count, however long it is.

Null or empty texts and texts of white space have no passage: quality 0, not good, top_passage -1. Rows with a null doc_id
keep it. Ties between passages go to the first. Repeated rows get the same answer each. Labels that are null, other than
0 and 1 or of unknown documents are not trained on; unless both labels occur, every text with a passage is good, with
quality 1. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import _spark, _text

PASSAGE, BITS, DIM, HIDDEN = 64, 15, 16, 16
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Bags:
    """Feature ids of the tokens of consecutive rows: three per token, tokens grouped to passages, passages to rows."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi = lo, hi
        sp = _SPACE[data]
        start = np.flatnonzero(~sp & np.append(True, sp[:-1]))
        end = np.flatnonzero(sp & np.append(False, ~sp[:-1]))  # a space is behind each row
        first = np.searchsorted(start, offs)
        p, inv = _text.powers(len(data) + 1)
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * p[: len(data)], out=s[1:])
        h = _text.mix((s[end] - s[start]) * inv[start])
        back = np.concatenate([np.full(8, 32, np.uint8), data])
        tail = (back[end + 5].astype(np.uint64) << _U(16)) | (back[end + 6].astype(np.uint64) << _U(8)) | back[end + 7]
        short = end - start < 3
        tail[short] += (end - start)[short].astype(np.uint64) << _U(32)
        tail = _text.mix(tail * _U(0x9E3779B97F4A7C15) + _U(7))
        # repeats: whether the token is one of the last three, and its length
        rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        again = np.zeros(len(h), np.uint64)
        for k in (1, 2, 3):
            same = np.zeros(len(h), bool)
            same[k:] = (h[k:] == h[:-k]) & (rows[k:] == rows[:-k])
            again = again * _U(2) + same.astype(np.uint64)
        form = _text.mix((again << _U(8)) + np.minimum(end - start, 24).astype(np.uint64) + _U(0xABCDEF))
        shift = _U(64 - BITS)
        self.ids = np.stack([h >> shift, tail >> shift, form >> shift], axis=1).reshape(-1).astype(np.int32)
        self.first = first
        count = np.diff(first)
        n = -(-count // PASSAGE)
        self.passages = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(self.passages[-1]) - np.repeat(self.passages[:-1], n)
        self.starts = np.repeat(first[:-1], n) + at * PASSAGE  # token of each passage
        self.sizes = np.minimum(PASSAGE, np.repeat(first[1:], n) - self.starts)


def bags(arr: pa.Array, size: int = _text.CHUNK):
    for base in range(0, len(arr), _text.ROWS):
        data, offs = _text.spaced(arr.slice(base, _text.ROWS), False)
        for lo, hi, part, ends in _text.pieces(data, offs, size):
            yield Bags(base + lo, base + hi, part, ends)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    NAMES = ("w1", "b1", "v", "u", "a", "c", "d")

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * s[0] ** -0.5).astype(np.float32)
        self.emb = (rng.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
        self.w1, self.b1 = f(DIM, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.v, self.u, self.a = f(HIDDEN, HIDDEN), f(HIDDEN, HIDDEN), f(HIDDEN)
        self.c, self.d = f(HIDDEN), np.zeros(1, np.float32)
        self.threshold = 0.0

    def encode(self, b: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Mean embedding and encoding of each passage."""
        if not len(b.starts):
            return np.zeros((0, DIM), np.float32), np.zeros((0, HIDDEN), np.float32)
        e = np.add.reduceat(self.emb[b.ids], b.starts * 3, axis=0) / (3 * b.sizes[:, None])
        return e, np.tanh(e @ self.w1 + self.b1)

    def attend(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        return t, g, (t * g) @ self.a

    def score(self, b: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the score (-inf without passages), the passage with most attention and its weight."""
        n = b.hi - b.lo
        out, top, weight = np.full(n, -np.inf), np.full(n, -1), np.zeros(n)
        full = np.flatnonzero(np.diff(b.passages))
        if len(full):
            _, h = self.encode(b)
            s = self.attend(h)[2]
            at = b.passages[full]
            size = np.diff(b.passages)[full]
            most = np.maximum.reduceat(s, at)
            w = np.exp(s - np.repeat(most, size))
            w /= np.repeat(np.add.reduceat(w, at), size)
            z = np.add.reduceat(w[:, None] * h, at, axis=0)
            out[full] = z @ self.c + self.d[0]
            hit = np.flatnonzero(s == np.repeat(most, size))
            r, i = np.unique(np.repeat(full, size)[hit], return_index=True)
            top[r], weight[r] = hit[i] - b.passages[r], w[hit[i]]
        return out, top, weight

    def step(self, e: np.ndarray, h: np.ndarray, label: int) -> tuple[np.ndarray, dict]:
        """Gradients of the log loss of one document: of its passages' mean embeddings, and of the parameters."""
        t, g, s = self.attend(h)
        w = np.exp(s - s.max())
        w /= w.sum()
        z = w @ h
        p = _sigmoid(z @ self.c + self.d[0])
        err = p - label
        dz = err * self.c
        dw = h @ dz
        ds = w * (dw - w @ dw)
        dt, dg = np.outer(ds, self.a) * g * (1 - t * t), np.outer(ds, self.a) * t * g * (1 - g)
        dh = np.outer(w, dz) + dt @ self.v.T + dg @ self.u.T
        dx = dh * (1 - h * h)
        grads = {"w1": e.T @ dx, "b1": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": err * z, "d": np.array([err])}
        return dx @ self.w1.T, grads


def fit(rows: list, epochs: int = 6, rate: float = 0.02, emb_rate: float = 1.0, batch: int = 8, seed: int = 23) -> Model | None:
    """Fits on rows (text, label 0 or 1)."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if r.label in (0, 1) and r.text and r.text.strip()]
    y = np.array([r.label for r in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    held = rng.permutation(len(rows)) < len(rows) // 5
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    docs = [b for r in rows for b in bags(pa.array([r.text]), 1 << 40)]
    ok = np.array([len(b.starts) > 0 for b in docs])
    model = Model(seed)
    train = np.flatnonzero(~held & ok)
    share = np.bincount(y[train], minlength=2) / max(1, len(train))
    balance = 0.5 / np.maximum(share, 1e-9)
    first = {n: np.zeros_like(getattr(model, n)) for n in Model.NAMES}
    second = {n: np.zeros_like(getattr(model, n)) for n in Model.NAMES}
    steps, total = 0, epochs * -(-len(train) // batch)
    for _ in range(epochs):
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            steps += 1
            decay = 1 - steps / (total + 1)
            sums: dict[str, np.ndarray] = {}
            for i in order[lo : lo + batch]:
                b = docs[i]
                e, h = model.encode(b)
                de, grads = model.step(e, h, y[i])
                for n, x in grads.items():
                    sums[n] = sums.get(n, 0) + x * balance[y[i]] / batch
                per = np.repeat(de / (3 * b.sizes[:, None]), 3 * b.sizes, axis=0) * np.float32(-emb_rate * decay * balance[y[i]])
                order_ = np.argsort(b.ids, kind="stable")
                ids = b.ids[order_]
                at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                model.emb[ids[at]] += np.add.reduceat(per[order_], at, axis=0)
            for n, x in sums.items():
                first[n] = 0.9 * first[n] + 0.1 * x
                second[n] = 0.99 * second[n] + 0.01 * x * x
                m, v = first[n] / (1 - 0.9**steps), second[n] / (1 - 0.99**steps)
                setattr(model, n, (getattr(model, n) - rate * decay * m / (np.sqrt(v) + 1e-6)).astype(np.float32))
    use = np.flatnonzero((held if held.any() else np.ones(len(y), bool)) & ok)
    s = np.array([model.score(docs[i])[0][0] for i in use])
    t = y[use]
    order = np.argsort(s, kind="stable")
    s, t = s[order], t[order]
    # balanced errors when the first k count as bad
    good, bad = max(1, t.sum()), max(1, (1 - t).sum())
    wrong = np.cumsum(np.append(0, t / good)) + np.append(np.cumsum(((1 - t) / bad)[::-1])[::-1], 0)
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    k = max(range(len(wrong)), key=lambda i: (-round(wrong[i], 9), edge[i + 1] - edge[i]))
    model.threshold = float((edge[k] + edge[k + 1]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model | None:
    """Fits on at most per_class documents of each label."""
    ids = _spark.some_of_each(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label")), per_class)
    _spark.session(docs)
    return _spark.fit_in_task(_spark.matching(docs.where("text IS NOT NULL").select("doc_id", "text"), ids, "doc_id"), fit)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Quality of every row of docs (doc_id, text)."""
    shared = _spark.session(docs).sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            p, good, count, top, weight = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
            for x in bags(b.column(1)):
                at = slice(x.lo, x.hi)
                count[at] = np.diff(x.passages)
                if model is None:
                    p[at] = good[at] = count[at] > 0
                    continue
                s, top[at], weight[at] = model.score(x)
                p[at] = np.where(np.isfinite(s), _sigmoid(s - model.threshold), 0)
                good[at] = s > model.threshold
            names = ["doc_id", "quality", "is_good", "n_passages", "top_passage", "top_weight"]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (p, good, count, top, weight))], names)

    schema = "doc_id long, quality double, is_good boolean, n_passages long, top_passage long, top_weight double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_text.tidy(run), schema)
