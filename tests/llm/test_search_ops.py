"""N-gram join, suffix dedup, decontamination, license scan and embedding dedup against brute force."""

import contextlib
import pathlib
import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import _spark, _text, decontaminate, embedding_dedup, licenses, ngram_join, suffix_dedup
from tests.llm.helpers import documents, odd, prose, shuffled, words


def split(t):
    import re

    return re.findall(r"[^\W_]+", (t or "").lower())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_words():
    w = next(_text.words(pa.array(["Ab, c_d 12!", None, "", "é x"])))
    assert [[w.word(k).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(4)] == [["ab", "c", "d", "12"], [], [], ["é", "x"]]


# n-gram join


def slow_pairs(rows, n=3, t=0.5):
    sets = {}
    for i, text in rows:
        w = split(text)
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    out = {(first[s], i, len(s), 1.0) for i, s in sets.items() if first[s] != i}
    reps = sorted(first.values())
    for x in range(len(reps)):
        for y in range(x + 1, len(reps)):
            a, b = sets[reps[x]], sets[reps[y]]
            o = len(a & b)
            if o >= t * (len(a) + len(b) - o):
                out.add((reps[x], reps[y], o, o / (len(a) + len(b) - o)))
    return out


def test_all_long_lists_have_a_length(spark):
    """However many lists of 8 documents or more there are, none is taken for a short one; those of one document nearly all are."""
    common, own = [f"a{k}" for k in range(600_000)], [f"b{k}" for k in range(50_000)]
    docs = documents(spark, [*((k, " ".join(common)) for k in range(8)), (8, " ".join(own))])
    _spark.session(docs)
    table = ngram_join.list_lengths(docs, 3, 4)
    long, short = (ngram_join.gram_sets(next(_text.words(pa.array([" ".join(w)]))), 3)[0] & ngram_join._MASK for w in (common, own))
    assert len(long) > 1 << 19 and ngram_join.length_class(table, long).min() == 1
    assert (ngram_join.length_class(table, short) == 0).mean() > 0.95


def test_meeting_with_many_cells():
    """Pairs count where no smaller cell has both; what is read for a pair is a bit for each smaller cell."""
    rng = np.random.default_rng(1)
    cells = [[5000, *rng.choice(2000, 12, replace=False).tolist()] for _ in range(400)]
    here = _spark.Meeting((5000, 0), np.zeros(400, np.int64), cells)
    i, j = (x.ravel() for x in np.triu_indices(400, 1))
    want = np.array([not set(cells[a]) & set(cells[b]) - {5000} for a, b in zip(i.tolist(), j.tolist())])
    assert 0 < want.sum() < len(want)
    assert (here.first(i, j) == want).all()
    assert (here.first(7, j[i == 7]) == want[i == 7]).all()
    assert here.before.nbytes <= 400 * (2000 / 8 + 8)


def test_postings_are_not_written_to_tables(spark, monkeypatch):
    """The second stage of the pipeline holds its postings once, in a shuffle: no table that it writes has as much as a byte an n-gram."""
    import corpus_pipeline

    written, cut = {}, _spark.cut

    def watched(df, name):
        out, path = cut(df, name)
        written[name] = sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file://")).glob("*.parquet"))
        return out, path

    monkeypatch.setattr(_spark, "cut", watched)
    docs = documents(spark, [(k, prose(k, 4000)) for k in range(30)])
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 30
    assert max(written.values()) < 30 * 4000
    assert {"met", "sets"} <= set(written)


def long_words(n, docs):
    """Documents of which the text takes far more than the n-grams."""
    rng = random.Random(3)
    return [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60)) for _ in range(n))) for k in range(docs)]


def test_near_copies_without_a_shuffle_of_texts(spark, monkeypatch):
    """The second stage of the pipeline shuffles n-grams, no texts, where tables are too large to be sent to all tasks by themselves."""
    import corpus_pipeline

    rows = long_words(1000, 60)
    rows += [(100 + k, text + " more") for k, text in rows[:5]]
    docs = documents(spark, rows)
    monkeypatch.setattr(_spark, "freed", lambda spark: contextlib.nullcontext(), raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = shuffled(spark)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(60))
        assert 0 < sum(n for name, n in shuffled(spark).items() if name not in old) < 0.6 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffles_are_freed(spark):
    """What was shuffled for a written table doesn't stay on disk until the driver's garbage is collected."""
    df, old = spark.range(50_000).repartition(5), shuffled(spark)
    out, _ = _spark.cut(df, "numbers")
    for _ in range(30):
        left = sum(n for name, n in shuffled(spark).items() if name not in old)
        if not left:
            break
        time.sleep(0.1)
    assert left == 0 and out.count() == df.count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_marks(spark):
    """The bits of all rows are set, and hardly any others."""
    _spark.session(spark.range(1))
    a, b = np.arange(-500, 500), np.arange(1000) ** 3
    table = _spark.marks(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long"), 7)
    assert table.nbytes == 1 << 24 and _spark.marked(table, a, b).all()
    assert _spark.marked(table, a, b + 1).sum() <= 1
    assert not _spark.marks(spark.createDataFrame([], "a long, b long"), 7).any()


@pytest.mark.parametrize("few", [0, 2, 100])
def test_without(spark, monkeypatch, few):
    monkeypatch.setattr(_spark, "FEW", few)
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, gone string")
    got = _spark.without(docs, spark.createDataFrame([(1,), (3,), (9,)], "doc_id long"), "doc_id")
    assert got.columns == docs.columns and sorted(r.gone for r in got.collect()) == ["b", "d"]


def slow_links(rows, n=3, t=0.5):
    """doc_id: (class_id, links) by comparing all texts."""
    sets = {}
    for i, text in rows:
        w = split(text)
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sorted(near):
        if near[i] and i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = (i, len(near[j]))
                    todo += near[j]
    return out


def linked(spark, rows):
    got = ngram_join.linked(documents(spark, rows)).collect()
    out = {r.doc_id: (r.class_id, r.links) for r in got}
    assert len(out) == len(got)
    return out


def test_join(spark):
    rng = random.Random(3)
    rows = []
    for k in range(12):
        base = prose(k, rng.choice([4, 30, 120, 400]))
        rows += [base] + [edited(rng, base, rng.randrange(0, max(2, len(base.split()) // 6))) for _ in range(rng.randrange(0, 9))]
    passage = prose(99, 60)
    rows += [f"{prose(200 + k, 30)} {passage} {prose(300 + k, 30)}" for k in range(12)] + ["a", "A!", "a b", "x y z", "x y z", ""]
    rows = list(enumerate(rows)) + [(None, "x y z"), (0, rows[0]), (777, None)]
    got = ngram_join.pairs(documents(spark, rows)).collect()
    assert {(r.doc_a, r.doc_b, r.overlap, r.jaccard) for r in got} == slow_pairs(rows)
    assert len(got) == len(slow_pairs(rows)) > 50
    assert linked(spark, rows) == slow_links(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30), min_size=1, max_size=20), min_size=2, max_size=14), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_divide_skip(sets, t):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = {(i, j, len(sets[i] & sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}
    assert {(i, int(b), int(o)) for i, j, k in ngram_join.divide_skip(arrays, t) for b, o in zip(j, k)} == want


def test_join_odd(spark):
    got = ngram_join.pairs(odd(spark)).collect()
    assert got == []  # equal rows of one id are one document
    assert ngram_join.pairs(odd(spark).limit(0)).count() == 0
    assert ngram_join.linked(odd(spark)).count() == 0 and ngram_join.linked(odd(spark).limit(0)).count() == 0
    assert ngram_join.keep_one(odd(spark)).count() == odd(spark).count()
    with pytest.raises(ValueError):
        ngram_join.pairs(odd(spark), threshold=0)


def test_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 5)
    rng, base, other = random.Random(5), prose(7, 60), prose(8, 60)
    rows = [(k, edited(rng, base, 2)) for k in range(23)] + [(k, edited(rng, other, rng.randrange(9))) for k in range(30, 50)]
    rows += [(k + 100, t) for k, t in rows[:30:3]]
    for crowd in (32, 2):
        monkeypatch.setattr(ngram_join, "CROWD", crowd)
        got = ngram_join.pairs(documents(spark, rows)).collect()
        assert {(r.doc_a, r.doc_b, r.overlap, r.jaccard) for r in got} == slow_pairs(rows)
        assert len(got) == len(slow_pairs(rows))
        assert linked(spark, rows) == slow_links(rows)


def test_several_texts_of_an_id(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, prose(3, 50))]
    got = {(r.doc_id, r.class_id, r.links) for r in ngram_join.linked(documents(spark, rows)).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_hot_set(spark, monkeypatch):
    """More copies than spread_join sends through a shuffle."""
    known = spark.range(30_000).selectExpr("id", "if(id < 20000, 1, id) AS k")
    keyed = known.groupBy("k").count()
    assert _spark.spread_join(known, keyed, "k", "count").agg({"count": "sum", "id": "count"}).first()["count(id)"] == 30_000


def test_keep_one(spark):
    base = prose(1, 50)
    rows = [(5, base), (3, base), (9, base + " more"), (1, prose(2, 50)), (None, base)]
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_one(documents(spark, rows)).collect()) == [0, 1, 3]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (5, 5), (None, 1), (9, 8), (8, 7)], "src long, dst long")
    assert {(r.node, r.comp) for r in _spark.components(e)[0].collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (8, 5), (9, 5)}
    assert _spark.components(e.limit(0))[0].count() == 0


# suffix dedup


def slow_repeats(rows, n):
    seen, docs = {}, [(i, split(t)) for i, t in rows if i is not None]
    for i, w in docs:
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])] = seen.get(tuple(w[k : k + n]), 0) + 1
    out = []
    for i, w in docs:
        hit = [k for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1]
        spans = []
        for k in hit:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + n
            else:
                spans.append([k, k + n])
        out += [(i, a, b) for a, b in spans]
    return sorted(out)


def test_suffix_dedup(spark):
    rng = random.Random(1)
    passages = [prose(50 + k, n) for k, n in enumerate((12, 20, 45, 90))]
    rows = [(k, " ".join([prose(1000 + k, rng.randrange(0, 50)), *(p for p in passages if rng.random() < 0.5), prose(2000 + k, 20)])) for k in range(40)]
    rows += [(100, "the the " * 40), (101, passages[3]), (102, passages[3]), (103, "short")]
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.find_repeats(documents(spark, rows), 15).collect())
    assert got == slow_repeats(rows, 15)


def test_suffix_dedup_odd(spark):
    got = suffix_dedup.find_repeats(odd(spark)).collect()
    assert {r.doc_id for r in got} == {5}  # the repeated row is a repeat of itself
    assert suffix_dedup.find_repeats(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(odd(spark), 8)


def test_merge_keeps_order():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))).encode() for _ in range(rng.randrange(0, 30))) for _ in range(7)]
    encoded = [suffix_dedup.decode(suffix_dedup.encode([(x, b"", 0, 0, 0, 0, 0) for x in r])) for r in runs]
    out = list(suffix_dedup.merge(encoded))
    assert [e[0] for e in out] == sorted(x for r in runs for x in r)
    for a, b in zip(out, out[1:]):
        assert b[1] <= suffix_dedup.lcp(a[0], b[0])


# decontamination


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def leak_tables(spark, n=60):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.randrange(8, 60)))) for k in range(25)]
    rows = []
    for k in range(n):
        w = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, int(0.15 * len(w)) + 2)):
            p, kind = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + (kind < 2)] = [f"q{k}"][: kind != 1]
        rows.append((k, f"{prose(k, 50)} {' '.join(w) if k % 2 else ''} {prose(k + 500, 50)}"))
    return items, rows, spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark):
    items, rows, benchmark = leak_tables(spark)
    want = {}
    for i, t in rows:
        for k, item in items:
            w = split(item)
            d = slow_distance(w, split(t))
            if d <= int(decontaminate.RATE * len(w)):
                want[i, k] = d
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(documents(spark, rows), benchmark).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(want) > 20 and len(got) >= 0.9 * len(want)
    kept = {r.doc_id for r in decontaminate.clean(documents(spark, rows), benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_short_items(spark):
    """Items of any length count: the shortest exactly, those of seven words and more with edits."""
    texts = ["yes", "two words", "a b c d e f", "one two three four five six seven", "it is it is it is", "yes"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(1, "well YES yes"), (2, "two, words!"), (3, "two other words"), (4, "x a b c d e f a b c d e f"), (5, "a b c d e"), (6, "one two three FOUR five 6 seven"), (7, "it is it is it is it is"), (8, "a b c d x f"), (9, "")]
    got = {(r.doc_id, r.item_id, r.distance, r.end_word) for r in decontaminate.find_leaks(documents(spark, rows), items).collect()}
    assert got == {(1, 0, 0, 2), (1, 5, 0, 2), (2, 1, 0, 2), (4, 2, 0, 7), (6, 3, 1, 7), (7, 4, 0, 6)}
    assert {r.item_id for r in decontaminate.find_leaks(documents(spark, rows), items, min_words=6).collect()} == {2, 3, 4}
    one = items.where("item_id = 0")
    assert {r.doc_id for r in decontaminate.clean(documents(spark, rows), one).collect()} == {2, 3, 4, 5, 6, 7, 8, 9}


def test_recall_that_is_not_reached():
    rows = [SimpleNamespace(item_id=k, text=prose(k, 40)) for k in range(5)]
    assert decontaminate.Index(rows).classes[0].recall >= 0.95
    with pytest.raises(ValueError):
        decontaminate.Class(decontaminate.Index(rows).words, [0, 1, 2, 3, 4], 0.15, 1.0, 1, per_walk=1, walks=1)


def test_leaks_odd(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, prose(2, 30)), (4, prose(2, 30)), (None, prose(1, 40))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(odd(spark), items).collect()]
    assert sorted(got, key=str) == sorted([(5, 4, 0)] * 4 + [(4, None, 0)], key=str)
    assert decontaminate.find_leaks(odd(spark).limit(0), items).count() == 0
    assert decontaminate.clean(odd(spark), items.limit(0)).count() == odd(spark).count()
    assert decontaminate.clean(odd(spark), items).columns == odd(spark).columns


# licenses


def test_license(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (1, f"{prose(1, 30)} {mit} {prose(2, 30)}"), (2, f"# {mit.upper().replace(' ', chr(10) + '# ')}"), (3, prose(3, 200)),
        (4, "x\nReleased under the MIT License.\ny\nReleased under the MIT License."), (5, " ".join(mit.split()[:60])), (6, mit.replace("Software", "Program", 2)),
    ]
    got = [(r.doc_id, r.license, r.start_word, r.end_word) for r in licenses.scan(documents(spark, rows)).orderBy("doc_id", "start_word").collect()]
    n = len(split(mit))
    assert got == [(1, "MIT", 30, 30 + n), (2, "MIT", 0, n), (4, "MIT-notice", 1, 6), (4, "MIT-notice", 7, 12), (6, "MIT", 0, n)]


def test_whole_license_texts(spark):
    names = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    names += [f"{x}-header" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")] + [f"{x}-start" for x in ("BSD-2-Clause", "ISC", "Zlib", "Unlicense")]
    ends = {"BSD-3-Clause": "SUCH DAMAGE.", "BSD-2-Clause": "SUCH DAMAGE.", "ISC": "THIS SOFTWARE.", "Zlib": "any source distribution.", "Unlicense": "unlicense.org/>", "GPL-3.0-header": "licenses/>."}
    assert all(licenses.TEMPLATES[n].strip().endswith(e) for n, e in ends.items())
    rows = [(k, f"{prose(k, 30)} {licenses.TEMPLATES[n]} {prose(k + 99, 30)}") for k, n in enumerate(names)]
    got = [(r.doc_id, r.license, r.start_word, r.end_word) for r in licenses.scan(documents(spark, rows)).orderBy("doc_id", "start_word").collect()]
    assert got == [(k, n, 30, 30 + len(split(licenses.TEMPLATES[n]))) for k, n in enumerate(names)]


def test_chain_over_many_matches():
    scanner = licenses.Scanner({"x": "a b c"})
    crowd = [(9, 1000 + 20 * i, 3) for i in range(600)]  # many places of one short match between two that belong together
    assert scanner.chains([(0, 0, 10), *crowd, (11, 11, 10)], 24) == [(0, 21, 20)]


def test_license_odd(spark):
    assert licenses.scan(odd(spark)).count() == 0 and licenses.scan(odd(spark).limit(0)).count() == 0
    d = documents(spark, [(None, "Released under the MIT License.")] * 2)
    assert [r.doc_id for r in licenses.scan(d).collect()] == [None, None]
    assert licenses.scan(d, {}).count() == 0 and licenses.scan(d, {"x": "", "y": "!"}).count() == 0
    assert [r.license for r in licenses.scan(d, {"x": "mit"}).collect()] == ["x", "x"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
def test_matching_statistics(templates, text):
    a = licenses.Automaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, (n, s) in enumerate(a.statistics(text), 1):
        assert n == max((m for m in range(k + 1) if m == 0 or tuple(text[k - m : k]) in runs))
        if n:
            run = text[k - n : k]
            assert set(a.ends[s]) == {(i, e) for i, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == run}


# embeddings


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    return np.concatenate([base + rng.standard_normal(base.shape) * 0.12 for _ in range(4)]).round(3)


def slow_near(x, t):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= t, 1))
    return set(zip(i.tolist(), j.tolist()))


def near_classes(want, n):
    """vec_id: (class_id, links) of pairs."""
    near = [set() for _ in range(n)]
    for i, j in want:
        near[i].add(j)
        near[j].add(i)
    out = {}
    for i in range(n):
        todo = [i] if near[i] and i not in out else []
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = (i, len(near[j]))
                todo += near[j]
    return out


def embeddings(spark, x):
    return spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_embeddings(spark, monkeypatch):
    x = vectors()
    v, want = embeddings(spark, x), slow_near(x, 0.9)
    assert {(r.vec_a, r.vec_b) for r in embedding_dedup.pairs(v).collect()} == want
    assert {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.dedup(v).collect()} == near_classes(want, len(x))
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 100)  # so that nodes are split in several rounds
    got = [(r.vec_a, r.vec_b) for r in embedding_dedup.pairs(v, leaf=20).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want) > 100
    assert {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.dedup(v, leaf=20).collect()} == near_classes(got, len(x))


def test_embeddings_that_cannot_be_split(spark, monkeypatch):
    """A group of near copies with equal projections of most, larger than what is compared as a whole."""
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    x = np.tile([1.0, 2.0, 3.0, 4.0], (90, 1))
    x[:, 0] += np.arange(90) * 1e-15
    x = np.concatenate([x, [[1.0, 2.0, 3.0, 4.5], [-1.0, 0.0, 0.0, 0.0]]])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.dedup(v, leaf=8).collect()} == {i: (0, 90) for i in range(91)}


def test_embeddings_sql(spark):
    import duckdb

    x = np.concatenate([vectors(200), vectors(200)[:7] * 1.0])
    v, c = embeddings(spark, x), duckdb.connect()
    c.register("embeddings", v.toArrow())
    want = set(c.sql(embedding_dedup.SQL).fetchall())
    assert {(r.vec_id, r.class_id, r.links) for r in embedding_dedup.dedup(v).select("vec_id", "class_id", "links").collect()} == want and len(want) > 100


def test_embeddings_odd(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 0.0]), (6, []), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' AS norm", "'c' AS tree", "'c' AS x", "'c' AS sid", "'c' AS cell", "'c' AS copies")
    assert {(r.vec_a, r.vec_b, r.similarity) for r in embedding_dedup.pairs(v).collect()} == {(1, 2, 1.0), (1, 3, 1.0)}
    assert {(r.vec_id, r.class_id, r.links) for r in embedding_dedup.dedup(v).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
    assert embedding_dedup.dedup(v.limit(0)).count() == 0
