import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import analysis, edit_distance, snippets
from quernel.functions.analysis import AnalyzerConfig


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, terms",
    [("hello@world.com test#123", ["hello", "world", "com", "test", "123"]), ("The quick brown", ["quick", "brown"]), ("", []), (None, []), ("café don't", ["caf", "don't"])],
)
def test_tokens(spark, text, terms):
    assert one(spark, analysis.tokens("t"), t=text) == terms
    assert [x[0] for x in analysis.analyze(text)] == terms


def test_positions_and_offsets(spark):
    got = one(spark, analysis.token_offsets("t"), t="The quick brown")
    assert [(r.term, r.position, r.start, r.end) for r in got] == [("quick", 0, 4, 9), ("brown", 1, 10, 15)]


def test_config(spark):
    assert one(spark, analysis.tokens("t", AnalyzerConfig(lowercase=False)), t="The the X") == ["The", "X"]
    assert one(spark, analysis.tokens("t", AnalyzerConfig(remove_stop_words=False)), t="The x") == ["the", "x"]
    assert one(spark, analysis.tokens("t", AnalyzerConfig(stemmer="porter")), t="running cats") == ["running", "cats"]
    assert one(spark, analysis.tokens("t", AnalyzerConfig(simd=False)), t="A b") == one(spark, analysis.tokens("t"), t="A b")
    with pytest.raises(ValueError):
        AnalyzerConfig(stemmer="other")


STEMS = {
    "running": "runn", "walked": "walk", "quickly": "quick", "cats": "cat", "educational": "education", "national": "nation",
    "relational": "relation", "regional": "region", "king": "k", "class": "class", "bus": "bus", "ed": "ed",
}


def test_stems(spark):
    for word, stem in STEMS.items():
        assert analysis.stem_word(word) == one(spark, analysis.stem_simple("t"), t=word) == stem


def test_fields_and_counts(spark):
    df = spark.sql("SELECT map('b', 'two', 'a', 'one') AS f")
    r = df.select(analysis.all_text("f").alias("t"), analysis.field("f", "a").alias("a"), analysis.field("f", "z").alias("z")).first()
    assert (r.t, r.a, r.z) == ("one two", "one", "")
    assert one(spark, analysis.loader_term_count("t"), t="a b\tc") == 3
    assert one(spark, analysis.loader_term_count("t"), t="") == 0
    assert one(spark, analysis.normalize_query("t"), t="  A \n b ") == "a b"


@pytest.mark.parametrize("a, b, d", [("machne", "machine", 1), ("cat", "bat", 1), ("teh", "the", 1), ("recieve", "receive", 1), ("kitten", "sitting", 3), ("ca", "abc", 3), ("", "ab", 2), ("ab", "", 2), ("", "", 0)])
def test_distance(spark, a, b, d):
    assert edit_distance.osa(a, b) == d
    assert one(spark, edit_distance.osa_distance("a", "b"), a=a, b=b) == d


def test_ngrams(spark):
    assert one(spark, edit_distance.ngrams("t"), t="cat") == ["^c", "ca", "at", "t$"]
    assert one(spark, edit_distance.ngrams("t"), t="") == []
    assert [edit_distance.auto_distance(n) for n in (1, 2, 3, 4, 5, 9)] == [0, 0, 1, 1, 2, 2]
    assert one(spark, edit_distance.auto_edit_distance(F.col("n")), n=4) == 1


def test_highlight(spark):
    mark = lambda t, terms: one(spark, snippets.highlight("t", terms), t=t)
    assert mark("Fox foxes, FOX!", ["fox"]) == "<mark>Fox</mark> foxes, <mark>FOX</mark>!"
    assert mark("Fox", []) == "Fox" and mark("", ["fox"]) == ""
    assert snippets.generate("Fox foxes", ["fox"]) == ["<mark>Fox</mark> foxes"]


def test_snippets():
    text = "filler " * 20 + "Needle here " + "filler " * 20
    o = snippets.SnippetOptions(max_length=40, count=1)
    (s,) = snippets.generate(text, ["needle"], o)
    assert "<mark>Needle</mark>" in s and s.startswith("...") and s.endswith("...")
    assert snippets.generate("", ["x"]) == [] and snippets.generate("abc", []) == []
    assert snippets.windows("a b c", ["zz"], 2, 3) == [(0, 2, 0)]
    assert snippets.windows("!!", ["a"], 2, 3) == []
    assert snippets.snap("hello world", 2, 8) == (6, 11)
    assert len(snippets.generate("x needle " * 100, ["needle"], o)) == 1


def slow_windows(text, terms, size, count):
    import re

    words = [(m.start(), m.group().lower()) for m in re.finditer("[A-Za-z0-9']+", text)]
    found = [(s, min(s + size, len(text))) for s, _ in words]
    scored = [(s, e, sum(w in terms and s <= p < e for p, w in words)) for s, e in found]
    out = []
    for w in sorted((w for w in scored if w[2]), key=lambda w: (-w[2], w[0])):
        if len(out) < count and all(w[0] >= x[1] or w[1] <= x[0] for x in out):
            out.append(w)
    return sorted(out) if out else [(0, min(size, len(text)), 0)] if words else []


@settings(max_examples=60, deadline=None)
@given(st.text("ab '.", max_size=60), st.integers(1, 20), st.integers(1, 4))
def test_windows_brute_force(text, size, count):
    assert snippets.windows(text, ["a", "b"], size, count) == slow_windows(text, ["a", "b"], size, count)


def slow_snippets(text, terms, size=150, count=3):
    import re

    def word(i):
        return re.fullmatch("[A-Za-z0-9']", text[i]) is not None

    def mark(part):
        return "".join(f"<mark>{x}</mark>" if x.lower() in terms else x for x in re.findall("[A-Za-z0-9']+|[^A-Za-z0-9']+", part))

    if not text:
        return []
    if len(text) <= size:
        return [mark(text)]
    out, inside = [], [i for i in range(1, len(text)) if word(i) and word(i - 1)]
    for a, b, _ in slow_windows(text, terms, size, count):
        if a in inside:
            a = next((i for i in range(a, len(text)) if word(i) and i not in inside), len(text))
        while b in inside:
            b += 1
        out.append(("..." if a else "") + mark(text[a : b if a < b else a + 1]) + ("..." if b < len(text) else ""))
    return out


def test_snippets_all(spark, tmp_path):
    import random

    from quernel.plans import catalog

    rng = random.Random(4)
    vocabulary = ["thing", "Thing", "NICHT", "nicht", "things", "a", "don't", "größer", "filler", "x" * 40, "1985"]
    texts = [None, "", "!?", "thing", "thing " * 100, "filler " * 60, "- " * 200, "w" * 400, "thing" + "y" * 300, "ü" * 149 + "nicht" + "z" * 9]
    for n in range(60):
        rare = rng.random() < 0.5
        texts.append("".join(rng.choice(vocabulary[5 * rare :]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randrange(1, 120))) + "nicht" * (n % 3 == 0))
    rows = list(enumerate(texts)) + [(3, "again thing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.snippets) for r in catalog.QUERIES["snippets_all"](spark, str(tmp_path)).collect())
    assert got == sorted((i, slow_snippets(t, ["thing", "nicht"])) for i, t in rows)
    assert sum(len(x) > 1 for _, x in got) > 10 and sum(len(t or "") > 150 for t in texts) > 40
