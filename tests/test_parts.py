"""Queries that need no index write none."""

import os

import pytest

from quernel import storage
from quernel.operators import index
from quernel.plans import catalog
from quernel.sources import snapshot


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f"thing number {i}" + " nicht" * (i % 3), f"src{i % 2}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, most", [("query_stats", []), ("top_k", []), ("update_document", []), ("paginate_offset", ["asked"]), ("osa_distance", ["terms"])])
def test_what_is_written(spark, folder, monkeypatch, name, most):
    wrote, persist = [], storage.persist
    monkeypatch.setattr(storage, "persist", lambda df, name, *x: wrote.append(name) or persist(df, name, *x))
    few = catalog.QUERIES[name](spark, folder).collect()
    assert wrote == most
    catalog.indexed(spark, folder)
    assert sorted(map(str, catalog.QUERIES[name](spark, folder).collect())) == sorted(map(str, few))


def test_snapshot_makes_postings_of_what_it_wrote(spark, folder):
    seen, path = [], f"{folder}/snapshot"
    snapshot.save(path, catalog.analyzed(spark, folder), lambda d: seen.append(d.inputFiles()) or index.build_postings(d), next_id=3)
    assert seen[0] and all("/tables-" in x and "/docs/" in x for x in seen[0])
    back = snapshot.load(spark, path)
    assert back.documents == 40 and back.postings.count() == index.build_postings(back.docs).count() and os.path.isdir(path)
