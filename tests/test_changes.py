"""Changes of an index, snapshots, pages under a penalty, commands, and what works on terms in bulk."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quernel.cli import Shell
from quernel.engine import SEGMENTS, SearchEngine
from quernel.functions.analysis import AnalyzerConfig
from quernel.functions.edit_distance import auto_distance, osa
from quernel.operators import fuzzy
from quernel.operators.heap import TopK
from quernel.operators.search import SearchOptions
from tests.test_engine import engine_of, scores


def test_clear_and_config(spark):
    e = engine_of(spark, ["The cats", "a dog"])
    e.set_config(AnalyzerConfig(remove_stop_words=False, stemmer="simple"))
    assert e.statistics() == {"n": 2, "avgdl": 2.0, "n_terms": 4} and e.has_term("the") and e.has_term("cat") and not e.has_term("cats")
    e.clear()
    assert e.documents() == [] and e.search("dog") == [] and not e.has_term("dog")
    assert e.index_document({"content": "again"}) == 1
    e.set_config(AnalyzerConfig())
    assert scores(e.search("again"))


def test_many_changes(spark):
    """More changes than there may be segments, against a dict."""
    e, want = SearchEngine(spark), {}
    rng = random.Random(3)
    for step in range(SEGMENTS + 3):
        if step % 4 == 3:
            gone = rng.choice(sorted(want))
            assert e.delete_document(gone)
            del want[gone]
        else:
            i = e.index_document({"content": f"common word{step}"}, rng.choice([0, 0, 1]))
            want[i] = f"common word{step}"
    assert {d["doc_id"]: d["fields"]["content"] for d in e.documents(limit=100)} == want
    assert sorted(r.doc_id for r in e.search("common", SearchOptions(max_results=100))) == sorted(want)
    assert {r.term for r in e.vocabulary().collect()} == {w for t in want.values() for w in t.split()}
    assert len(e._segments) <= SEGMENTS


def test_fresh_words_for_typos(spark):
    e = engine_of(spark, ["machine", "garden"])
    assert e.search("machne", SearchOptions(fuzzy=True))[0].expanded_terms == {"machne": "machine"}
    e.delete_document(1)
    assert e.search("machne", SearchOptions(fuzzy=True)) == []
    e.index_document({"content": "machines"})
    assert e.search("machne", SearchOptions(fuzzy=True))[0].expanded_terms == {"machne": "machines"}


def test_saving_where_it_was_loaded_from(spark, tmp_path):
    e, path = engine_of(spark, ["one two", "two three"]), f"file://{tmp_path}/snap"
    assert e.save(path)
    for n in (3, 4):
        e = SearchEngine(spark)
        assert e.load(path)
        assert e.index_document({"content": f"two more{n}"}) == n
        assert e.save(path) and len(e.search("two")) == n
    other = SearchEngine(spark)
    assert other.load(path) and sorted(r.doc_id for r in other.search("two")) == [1, 2, 3, 4]
    (tmp_path / "file").write_text("")
    assert not e.save(f"file://{tmp_path}/file/below") and not e.load(f"file://{tmp_path}/file")


def test_cursor_under_a_penalty(spark):
    e = engine_of(spark, ["machine " * (1 + i % 7) + "filler " * (i % 5) for i in range(40)])
    o, seen, after = SearchOptions(fuzzy=True, max_results=7), [], {}
    while page := e.search_page("machne", SearchOptions(fuzzy=True, max_results=7, **after)).results:
        seen += [r.doc_id for r in page]
        after = {"after_score": page[-1].score, "after_id": page[-1].doc_id}
    assert len(seen) == len(set(seen)) == 40
    assert seen[:7] == [r.doc_id for r in e.search("machne", o)]


def test_offset_is_for_pages(spark):
    e = engine_of(spark, ["word"] * 3)
    assert [r.doc_id for r in e.search("word", SearchOptions(offset=2))] == [1, 2, 3]
    assert e.search_by("word", "TF-IDF", 2) == e.search("word", SearchOptions(ranker="TF-IDF", max_results=2))
    rows = e.search_rows("word", SearchOptions(max_results=2, snippets=True))
    assert json.loads(json.dumps(rows))["pagination"]["last_doc_id"] == 2 and rows["results"][0]["snippets"] == ["<mark>word</mark>"]


def test_use_by_many_threads(spark):
    e = engine_of(spark, [f"shared text{i}" for i in range(30)])
    with ThreadPoolExecutor(6) as pool:
        found = [pool.submit(e.search, "shared", SearchOptions(max_results=50, use_cache=i % 2 == 0)) for i in range(6)]
        ids = [pool.submit(e.index_document, {"content": f"shared new{i}"}) for i in range(3)]
        assert sorted(x.result() for x in ids) == [31, 32, 33]
        assert all(30 <= len(x.result()) <= 33 for x in found)
    assert len(e.search("shared", SearchOptions(max_results=50))) == 33


@given(st.lists(st.tuples(st.integers(-3, 3).map(float), st.integers(0, 20)), max_size=40, unique_by=lambda x: x[1]), st.integers(0, 8))
def test_heap(rows, k):
    heap = TopK(k)
    for r in rows:
        heap.push(*r)
    best = sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
    assert heap.peek() == best and len(heap) == len(best) and heap.full == (len(rows) >= k)
    assert heap.min_score == (best[-1][0] if best else 0.0)
    assert heap.drain() == best and len(heap) == 0


def test_heap_bounds():
    with pytest.raises(ValueError):
        TopK(-1)


def test_terms_come_and_go(spark):
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    grams = fuzzy.ngram_index(terms("machine", "garden"))
    grams = fuzzy.add_terms(grams, terms("learning", "garden"))
    assert fuzzy.vocabulary_size(grams) == 3
    grams = fuzzy.remove_terms(grams, terms("garden", "none"))
    assert fuzzy.vocabulary_size(grams) == 2 and fuzzy.find_matches(grams, "gardn").count() == 0
    assert [r.term for r in fuzzy.find_matches(grams, "lerning").collect()] == ["learning"]
    assert [r.term for r in fuzzy.suggest(terms("tea", "team", "teams", "teapot", "x"), "tea").collect()] == ["tea", "team", "teams"]


def test_many_words_at_once(spark):
    """Against the distance of every pair that shares a bigram."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    vocabulary, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})
    got = fuzzy.match_words(fuzzy.ngram_index(spark.createDataFrame([(x,) for x in vocabulary], "term string")), spark.createDataFrame([(x,) for x in asked], "word string"), limit=1000)
    pairs = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    want = {(a, t, d) for a in asked for t in vocabulary if pairs(a) & pairs(t) and (d := osa(a, t)) <= auto_distance(len(a))}
    assert {(r.word, r.term, r.distance) for r in got.collect()} == want and len(want) > 50


def test_commands(spark, tmp_path):
    s = Shell(SearchEngine(spark))
    say = lambda line: json.loads(s.execute(line))
    assert say("index 0 machine learning") == {"success": True, "doc_id": 1} and say("INDEX 7  deep learning")["doc_id"] == 7
    assert [x["document"] for x in say("find deep")["results"]] == [{"id": 7, "content": "deep learning"}]
    assert say("stats") == {"total_documents": 2, "total_terms": 3, "avg_doc_length": 2.0}
    assert say("skip stats learning")["postings_count"] == 2 and say("skip rebuild")["success"]
    assert say(f"save file://{tmp_path}/s") == {"success": True} and say("rm 7") == {"success": True} and say("rm 7") == {"success": False}
    assert say(f"load file://{tmp_path}/s") == {"success": True} and say("search deep")["total"] == 1
    for line in ("index x y", "index 3", "search", "delete", "save", "load", "skip", "skip stats", "st", "zzz"):
        assert "error" in say(line)
    assert say("s")["suggestions"] == ["search", "stats", "save"] and s.execute("  ") == "" and s.execute("exit") is None
    assert len(say("?")["commands"]) == 9 and s.execute("cls").startswith("\033")
