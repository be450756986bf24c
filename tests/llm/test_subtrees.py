"""Subtrees of the forest of op 9: their size, and the two ways they reach the vectors."""

import numpy as np

from quernel.llm import embedding_dedup


def unit(n, seed, dim=16):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_subtree_has_its_cuts_alone():
    x = unit(20_000, 1)
    few, many = (len(embedding_dedup.grow(x, 3, 1, 1, leaves, 0.05, 0.9)) for leaves in (20, 160))
    assert few < 24 * 3 * 20 and many < 24 * 4 * 160 and many < 20 * few  # a full table of levels had 65,520 bytes for 160
    at, leaves, stuck = embedding_dedup.send(x, 3, 1, 1, embedding_dedup.grow(x, 3, 1, 1, 20, 0.05, 0.9))
    assert not stuck and set(at) == set(range(len(x))) and np.unique(leaves).size >= 20


def test_sent_or_joined(spark, monkeypatch):
    x = unit(600, 2)
    x = np.concatenate([x, x[:50] + 0.01])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def run():
        return sorted(map(tuple, embedding_dedup.dedup(rows, leaf=64, trees=2).collect()))

    sent = run()
    monkeypatch.setattr(embedding_dedup, "SENT", 0)
    assert run() == sent and len(sent) >= 100
