import math

import pytest
from pyspark.sql import functions as F

from quernel.cache import QueryCache
from quernel.engine import SearchEngine
from quernel.operators import fuzzy, index, ranking
from quernel.operators.search import SearchOptions
from quernel.sources import loaders

E2E = ["artificial intelligence and machine learning", "deep learning neural networks", "natural language processing", "computer vision image recognition", "machine learning algorithms"]


def engine_of(spark, texts, **fields):
    e = SearchEngine(spark)
    e.index_documents(spark.createDataFrame([(i, {"content": t}) for i, t in enumerate(texts, 1)], "doc_id long, fields map<string,string>"))
    return e


@pytest.fixture(scope="module")
def e2e(spark):
    return engine_of(spark, E2E)


def scores(results):
    return {r.doc_id: round(r.score, 6) for r in results}


def test_goldens(e2e):
    assert scores(e2e.search("machine learning")) == {5: 1.529152, 1: 1.347110, 2: 0.513330}
    assert scores(e2e.search("neural networks", SearchOptions(ranker="TF-IDF"))) == {2: 2.231155}
    assert scores(e2e.search("computer", SearchOptions(ranker="ML-Ranker"))) == {4: 1.006783}
    assert scores(e2e.search("machine learning", SearchOptions(algorithm="tf_idf"))) == {1: 0.989202, 5: 0.989202, 2: 0.354077}
    assert e2e.search("machine NOT learning") == e2e.search("machine learning")
    assert scores(e2e.search('machine "machine learning"')) == {5: 3.632838, 1: 3.200358}
    assert scores(e2e.search('machine "machine learning"', SearchOptions(ranker="TF-IDF"))) == {1: math.inf, 5: math.inf}
    assert e2e.search('"machine learning"') == [] and e2e.search("!!!") == []
    assert e2e.search("learning", SearchOptions(max_results=0)) == []


def test_explain_and_paths(e2e):
    heap = e2e.search("machine learning", SearchOptions(explain=True))
    full = e2e.search("machine learning", SearchOptions(use_top_k=False))
    assert scores(heap) == scores(full)
    assert heap[0].explanation == "Ranker: BM25, Score: 1.529152, Method: Top-K Heap (O(N log K))"


def test_pages(spark):
    e = engine_of(spark, [f"common search term document {i}" for i in range(20)])
    p = e.search_page("common", SearchOptions(max_results=5))
    assert (p.total_hits, p.page_size, p.has_next_page) == (20, 5, True)
    seen = []
    for offset in (0, 5, 10, 15):
        p = e.search_page("common", SearchOptions(max_results=5, offset=offset))
        seen += [r.doc_id for r in p.results]
    assert seen == list(range(1, 21)) and not p.has_next_page
    last = p.results[1]
    after = e.search_page("common", SearchOptions(max_results=5, after_score=last.score, after_id=last.doc_id))
    assert [r.doc_id for r in after.results] == [18, 19, 20] and after.offset == 17
    assert e.search_page("common", SearchOptions(offset=100)).results == []


def test_changes(spark):
    e = SearchEngine(spark)
    a, b = e.index_document({"content": "red apple"}), e.index_document({"content": "green pear"})
    assert (a, b) == (1, 2)
    assert e.update_document(a, {"content": "blue plum"}) and not e.update_document(99, {})
    assert e.search("apple") == [] and [r.doc_id for r in e.search("plum")] == [1]
    assert e.delete_document(b) and not e.delete_document(b)
    assert e.search("pear") == [] and not e.has_term("pear")
    assert e.statistics() == {"n": 1, "avgdl": 2.0, "n_terms": 2}
    e.index_documents(spark.createDataFrame([(None, {"content": "new one"}), (7, {"content": "seven"})], "doc_id long, fields map<string,string>"))
    assert sorted(d["doc_id"] for d in e.documents()) == [1, 7, 8]


def test_snapshot(e2e, spark, tmp_path):
    e2e.save(f"file://{tmp_path}/snap")
    other = SearchEngine(spark)
    assert other.load(f"file://{tmp_path}/snap")
    assert scores(other.search("machine learning")) == scores(e2e.search("machine learning"))
    assert other.postings.count() == e2e.postings.count() and other.has_term("artificial")  # the first token too
    assert not other.load(f"file://{tmp_path}/none")
    assert other.index_document({"content": "x"}) == 6


def test_fuzzy(e2e):
    (best, *_) = e2e.search("machne", SearchOptions(fuzzy=True))
    assert best.expanded_terms == {"machne": "machine"}
    plain = e2e.search("machine")[0]
    assert best.score == pytest.approx(plain.score * 0.9)
    assert e2e.search("learn", SearchOptions(fuzzy=True))[0].expanded_terms == {"learn": "learning"}
    assert e2e.search("machine", SearchOptions(fuzzy=True))[0].expanded_terms == {}
    assert [r.term for r in fuzzy.find_matches(e2e.grams(), "lerning").collect()] == ["learning"]
    assert fuzzy.find_matches(e2e.grams(), "").count() == 0
    assert [fuzzy.penalty(n) for n in (0, 1, 5, 9)] == [1.0, 0.9, 0.5, 0.5]


def test_snippets(e2e):
    r = e2e.search("vision", SearchOptions(snippets=True))[0]
    assert r.snippets == ("computer <mark>vision</mark> image recognition",)


def test_structured(e2e):
    ids = lambda q: sorted(r.doc_id for r in e2e.search_structured(q).collect())
    assert ids("machine AND learning") == [1, 5] and ids("vision OR language") == [3, 4]
    assert ids("learning NOT machine") == [2] and ids('"neural networks"') == [2] and ids('"learning machine"') == []
    assert ids('"deep networks"~1') == [] and ids('"deep networks"~2') == [2] and ids('"deep neural networks"~1') == [2]
    assert ids("content:vision") == [4] and ids("title:vision") == []


def test_batch(e2e):
    got = e2e.search_batch(["machine learning", "computer", "zzz"], 2).collect()
    assert {(r.qid, r.rank): r.doc_id for r in got} == {(0, 1): 5, (0, 2): 1, (1, 1): 4}
    assert {r.doc_id: round(r.score, 6) for r in got if r.qid == 0} == {5: 1.529152, 1: 1.347110}


def test_rankers(e2e):
    r = ranking.Registry()
    assert r.names() == ["BM25", "ML-Ranker", "TF-IDF"] and r.default == "BM25"
    assert not r.set_default("none") and r.set_default("TF-IDF") and r.resolve("none") == "TF-IDF"
    with pytest.raises(ValueError):
        r.register("x", None)
    e2e.register_ranker("length", lambda c: c.length)
    assert {x.score for x in e2e.search("vision", SearchOptions(ranker="length"))} == {4.0}


def test_skips(spark):
    p = spark.range(1, 101).select(F.lit("popular").alias("term"), F.col("id").alias("doc_id"))
    skips = index.skip_pointers(p)
    assert skips.count() == 10
    assert index.find_skip_target(skips, 55).first().position == 50 and index.find_skip_target(skips, 1).first().position == 0
    assert index.skip_pointers(p, 25).count() == 4
    s = index.skip_statistics(p).first()
    assert (s.postings_count, s.skip_count, s.interval) == (100, 10, 10)
    q = p.union(spark.range(50, 151, 10).select(F.lit("other"), "id"))
    assert sorted(r.doc_id for r in index.intersect(q, "popular", "other").collect()) == [50, 60, 70, 80, 90, 100]


def test_empty(spark):
    e = SearchEngine(spark)
    assert e.search("x") == [] and e.statistics() == {"n": 0, "avgdl": 0.0, "n_terms": 0} and e.documents() == []
    assert e.skip_statistics("x")["needs_rebuild"]


def test_cache():
    now = [0.0]
    c = QueryCache(2, 10, clock=lambda: now[0])
    c.put(1, "a"), c.put(2, "b")
    assert c.get(1) == "a"
    c.put(3, "c")
    assert c.get(2) is None and c.statistics().evictions == 1
    now[0] = 11
    assert c.get(1) is None
    c.set_ttl(0), c.put(1, "x")
    now[0] = 1e9
    assert c.get(1) == "x" and c.statistics().hit_rate == pytest.approx(2 / 4)
    c.set_max_entries(0)
    c.put(5, "y")
    assert c.get(5) is None


def test_engine_cache(spark):
    e = engine_of(spark, ["one two", "two three"])
    e.search("Two"), e.search(" two ")
    assert e.cache_statistics().hits == 1
    e.index_document({"content": "two"})
    assert len(e.search("two")) == 3 and e.cache_statistics().hits == 1
    e.search("two", SearchOptions(use_cache=False))
    assert e.cache_statistics().hits == 1


def test_jsonl(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"id": 9, "title": "A", "content": "x y", "year": 2020, "ok": true, "none": null}\n\n{"title": "B", "content": ""}\n')
    rows = loaders.load_jsonl(spark, str(f)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [1, 2]
    assert rows[0].fields == {"title": "A", "content": "x y", "year": "2020", "ok": "true", "none": ""}
    f.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        loaders.load_jsonl(spark, str(f)).collect()
    with pytest.raises(Exception):
        loaders.load_jsonl(spark, str(tmp_path / "missing"))


def test_csv(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text('id,title,content\n7,"a ""b"", c",text\n8,,"x"\n')
    rows = loaders.load_csv(spark, str(f), ["id", "title", "content"]).orderBy("doc_id").collect()
    assert [r.fields for r in rows] == [{"title": 'a "b", c', "content": "text"}, {"title": "", "content": "x"}]
    with pytest.raises(ValueError):
        loaders.load_csv(spark, str(f), [])
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        loaders.load_csv(spark, str(tmp_path / "bad.csv"), ["a", "b"]).collect()


def test_other_sources(spark, tmp_path):
    assert [r.doc_id for r in loaders.create_documents(spark, [{"a": "x"}, {"a": None}], 5).collect()] == [5, 6]
    (tmp_path / "w.txt").write_text("The\n\n# note\n and \n")
    assert loaders.load_stop_words(spark, str(tmp_path / "w.txt")) == ("and", "the")
    (tmp_path / "p.txt").write_text("T|a|b\nonly\n")
    rows = loaders.load_piped(spark, str(tmp_path / "p.txt")).orderBy("doc_id").collect()
    assert [r.fields for r in rows] == [{"title": "T", "content": "a|b"}, {"title": "only", "content": ""}]


def test_stream(spark, tmp_path):
    from quernel.streaming.ingest import ingest, windowed_terms

    spark.createDataFrame([(1, {"content": "hello world"})], "doc_id long, fields map<string,string>").write.parquet(f"{tmp_path}/in")
    e = SearchEngine(spark)
    s = spark.readStream.schema("doc_id long, fields map<string,string>").parquet(f"{tmp_path}/in")
    ingest(s, e, f"{tmp_path}/cp").awaitTermination(60)
    assert [r.doc_id for r in e.search("hello")] == [1]
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'b b c' AS text").write.parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/ev")
    q = windowed_terms(ev).writeStream.outputMode("complete").format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert {r.term: r.n for r in spark.sql("SELECT * FROM terms").collect()} == {"b": 2, "c": 1}
