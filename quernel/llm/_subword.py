"""Subword-bag classifier: hashed character n-gram embeddings, averaged, under a linear softmax; trained jointly by SGD.

As the averaged embedding goes through a linear layer, applying the model needs only each n-gram's class scores:
the embedding table times the weights, a table of fixed size.
"""

from __future__ import annotations

import numpy as np

from quernel.llm import _text

SIZES = (3, 4, 5)
_C = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(buf: np.ndarray, bits: int) -> list[np.ndarray]:
    """Per n-gram size the bucket of the n-gram around each byte (it starts one byte before); 2**bits where a word ends inside."""
    ext = np.empty(len(buf) + 1, np.uint8)
    ext[0] = _text.SPACE
    ext[1:] = buf
    x = _text.eights(ext)[: len(buf)]
    space = np.zeros(len(buf) + 8, bool)
    space[: len(buf)] = buf == _text.SPACE  # at i: whether the second byte of the n-gram there is one
    out, bad = [], space[: len(buf)].copy()
    for n in range(3, max(SIZES) + 1):
        if n > 3:
            bad |= space[n - 3 : n - 3 + len(buf)]
        if n in SIZES:
            h = ((x & np.uint64((1 << 8 * n) - 1)) + np.uint64(n)) * _C
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            ids = (h >> np.uint64(64 - bits)).astype(np.int32)
            tail = len(buf) - (n - 2)  # no room for a whole n-gram behind
            ids[bad] = 1 << bits
            ids[max(0, tail) :] = 1 << bits
            out.append(ids)
    return out


def bag(ids: list[np.ndarray], lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of all n-grams of the bytes lo..hi and their share."""
    x = np.concatenate([v[lo:hi] for v in ids])
    x = x[x < 1 << bits]
    u, n = np.unique(x, return_counts=True)
    return u, (n / max(1, len(x))).astype(np.float32)


class Model:
    """Embeddings of 2**bits buckets, averaged, with a softmax over classes."""

    def __init__(self, classes: int, bits: int, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.weights = np.zeros((dim, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.weights += rng.normal(0, 0.1, self.weights.shape).astype(np.float32)
        self.seen = np.zeros(1 << bits, bool)

    def train(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                ids, share = bags[i]
                lr = rate * (1 - done / steps)
                done += 1
                if not len(ids):
                    continue
                rows = self.emb[ids]
                v = share @ rows
                z = v @ self.weights + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.weights @ p
                self.weights -= lr * np.outer(v, p)
                self.bias -= np.float32(0.1 * lr) * p
                self.emb[ids] = rows - lr * len(ids) ** 0.5 * share[:, None] * back
        for ids, _ in bags:
            self.seen[ids] = True

    def table(self) -> np.ndarray:
        """Class scores of each bucket, and zeros for the bucket that stands for no n-gram."""
        return np.vstack([self.emb @ self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])

    def logits(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        t = self.table()
        return np.array([share @ t[ids] for ids, share in bags]).reshape(len(bags), -1) + self.bias
