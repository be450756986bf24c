"""What a batch takes in a Python worker, and odd texts on their way through files."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quernel import storage
from quernel.functions import analysis
from quernel.functions.analysis import AnalyzerConfig


def test_offsets_of_batch_is_analyze():
    rng = random.Random(5)
    parts = [*"abzAZ09' ,.é😀\n\x00ß", "the ", "Running ", "cats"]
    for config in (AnalyzerConfig(), AnalyzerConfig(lowercase=False), AnalyzerConfig(remove_stop_words=False), AnalyzerConfig(stemmer="simple")):
        for size in (0, 1, 7, 50):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.choice([0, 1, 5, 30]))) for _ in range(size)]
            got = analysis.offsets_of_batch(pa.array(["x", *texts], pa.string()).slice(1), config)
            assert [[tuple(x.values()) for x in row] for row in got.to_pylist()] == [analysis.analyze(t, config) for t in texts]


def test_offsets_take_no_object_per_token(spark):
    texts = pa.array(["word " * 200_000])
    tracemalloc.start()
    assert len(analysis.offsets_of_batch(texts).values) == 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # a dict for each took over 60 MB
    rows = spark.createDataFrame([(1, "The quick brown"), (2, None), (3, "é fox")], "doc_id int, t string")
    assert [tuple(r) for r in analysis.explode_offsets(rows, "doc_id", "t").orderBy("doc_id", "pos").collect()] == [(1, 0, "quick", 4, 9), (1, 1, "brown", 10, 15), (3, 0, "fox", 2, 5)]


def test_slices():
    assert list(storage.slices(np.array([3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(storage.slices(np.array([0, 0]), 6)) == [(0, 2)] and not list(storage.slices(np.zeros(0), 6))


def test_csv_keeps_white_space(spark, tmp_path):
    from quernel.plans import catalog

    texts = ["\nx\n", "  x ", "\tx\t", "\x01x", " ", '"', 'a"b,\\', ""]
    spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.title: r.content for r in catalog.QUERIES["load_csv"](spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": t.replace("\n", " ") for i, t in enumerate(texts)}


def test_postings_of_slices(spark, monkeypatch):
    from quernel.operators import index

    sizes = []
    of_batch = index.postings_of_batch
    monkeypatch.setattr(index, "TOKENS", 10)
    monkeypatch.setattr(index, "postings_of_batch", lambda ids, tokens: sizes.append(len(tokens.flatten())) or of_batch(ids, tokens))
    monkeypatch.setattr(index.storage, "ship", lambda spark: spark)

    class Docs:  # takes what would be sent to workers
        sparkSession = None

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    tokens = [["a", "b", "a"]] * 7 + [["c"] * 30, None, ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(tokens)], ["doc_id", "tokens"])
    rows = [tuple(r.values()) for b in index.build_postings(Docs())(iter([batch])) for r in b.to_pylist()]
    assert sizes == [9, 9, 3, 30, 1] and len(rows) == 16 and ("a", 3, 2, [0, 2]) in rows and ("c", 7, 30, list(range(30))) in rows
