"""Language ID, toxicity and quality: held-out accuracy on planted signals, and odd input."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quernel.llm import _spark, _subword, _text, langid, quality, toxicity
from tests.llm.helpers import documents, odd

SYLLABLES = {"en": ["th", "er", "ing", "on", "st", "ou"], "de": ["sch", "ung", "ein", "ver", "ü", "ä"], "es": ["ción", "mente", "os", "que", "ñ", "ll"]}


def text(rng, lang="en", n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang), lang) for k, lang in enumerate([*SYLLABLES] * 60)]
    docs = documents(spark, [(i, t) for i, t, _ in rows]).drop("lang")
    known = spark.createDataFrame([(i, t, g) for i, t, g in rows if i % 2], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, known).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].lang_pred == g for i, _, g in rows if i % 2 == 0)
    assert right >= 0.95 * len([1 for i, *_ in rows if i % 2 == 0])
    other = documents(spark, [(1, "12 34 56 !!"), (2, "яблоко груша слива " * 9)]).drop("lang")
    assert {r.lang_pred for r in langid.identify(other, known).collect()} == {"und"}


def plain_ids(text, bits):
    """Buckets of the n-grams of each word with a space around it, one at a time."""
    import re

    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        b = f" {w} ".encode()
        for n in _subword.SIZES:
            for k in range(len(b) - n + 1):
                h = (int.from_bytes(b[k : k + n], "little") + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                h ^= h >> 29
                out.append((h * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> (64 - bits))
    return out


def test_language_by_hand(spark):
    """Scores of identify() against sums over n-grams taken one by one; a text longer than any piece counts whole."""
    rng = random.Random(4)
    rows = [(k, text(rng, lang), lang) for k, lang in enumerate([*SYLLABLES] * 20)]
    model = langid.fit([SimpleNamespace(text=t, label=g) for _, t, g in rows])
    long = text(rng, "de", 60_000) + " " + text(rng, "es", 90_000)
    for t in [text(rng, "en", 9), text(rng, "es", 30), long, "a", "th"]:
        ids = plain_ids(t, model.bits)
        for w in _text.words(pa.array([t])):
            best, conf, ok = model.predict(w)
        if not ids:
            assert not ok[0] and conf[0] == 0
            continue
        mean = model.table[ids].astype(np.float64).mean(axis=0)
        z = (mean[:-1] + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert best[0] == p.argmax() and conf[0] == pytest.approx(p.max(), rel=1e-4)
        assert ok[0] == (p.max() >= model.least and mean[-1] >= model.known)


def test_training_texts_count_whole():
    """What stands behind the first 100,000 n-grams of a training text decides."""
    rng, filler = random.Random(5), text(random.Random(6), "en", 20_000)
    rows = [SimpleNamespace(text=f"{filler} {text(rng, lang, 9000)}", label=lang) for lang in ["de", "es"] * 8]
    model = langid.fit(rows)
    for lang in ("de", "es"):
        (w,) = _text.words(pa.array([text(rng, lang, 50)]))
        assert model.names[model.predict(w)[0][0]] == lang


def test_language_odd(spark):
    d = odd(spark)
    got = langid.identify(d).collect()
    assert len(got) == d.count() and sum(r.doc_id is None for r in got) == 2
    assert all(r.lang_pred == "und" and r.confidence == 0 for r in got if r.doc_id in (1, 2, 3))
    assert langid.identify(d.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(d.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def toxic_rows(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        w = text(rng, n=60).split()
        if k % 3 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vilebad", "vilebads", "rudeword", "rudewordly"])
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity(spark):
    train, test = toxic_rows(1, 300), toxic_rows(2, 90)
    test.append((90, text(random.Random(5), n=60) + " rudewrod vilebbad", 1))  # not seen like this
    scorer = toxicity.train(documents(spark, [r[:2] for r in train]), labels(spark, [(i, 1, y) for i, _, y in train]))
    docs = documents(spark, [r[:2] for r in test])
    got = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    assert sum(got[i].is_toxic == bool(y) for i, _, y in test) >= 0.95 * len(test)
    kept = {r.doc_id for r in toxicity.clean(docs, scorer).collect()}
    assert kept == {i for i, r in got.items() if not r.is_toxic}
    for i, t, y in test[:30]:
        if y and got[i].is_toxic:
            assert any(x in " ".join(t.split()[got[i].worst_word :][: toxicity.WINDOW]) for x in ("vile", "rude"))


def test_toxicity_by_hand(spark):
    """The worst window of each text by scoring every window n-gram by n-gram."""
    rows = toxic_rows(1, 200)
    scorer = toxicity.train(documents(spark, [r[:2] for r in rows]), labels(spark, [(i, 1, y) for i, _, y in rows]))
    for _, t, _ in toxic_rows(7, 12) + [(0, "one", 0), (0, text(random.Random(1), n=3), 0)]:
        w = t.split()
        scores = []
        for k in range(len(w)):
            ids = plain_ids(" ".join(w[k : k + toxicity.WINDOW]), toxicity.BITS)
            scores.append(float(np.mean(scorer.table[ids].astype(np.float64)) if ids else 0) + scorer.bias)
        (x,) = _text.words(pa.array([t]))
        top, at = scorer.worst(x)
        assert top[0] == pytest.approx(max(scores), abs=1e-4) and scores[at[0]] == pytest.approx(max(scores), abs=1e-4)


def test_several_labels_of_an_id(spark):
    both = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (None, "a"), (3, None)] + [(10 + k, "c") for k in range(99)], "doc_id long, label string")
    got = {(r.doc_id, r.label) for r in _spark.some_of_each(both, 200).collect()}
    assert got == {(1, "a"), (2, "b")} | {(10 + k, "c") for k in range(99)}
    few = [r.doc_id for r in _spark.some_of_each(both, 7).where("label = 'c'").collect()]
    want = [r.doc_id for r in both.where("label = 'c'").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(7).collect()]
    assert sorted(few) == sorted(want)


def test_toxicity_odd(spark):
    d = odd(spark)
    none = toxicity.train(d, labels(spark, [(1, 1, 1), (5, 0, 0), (99, 1, 1), (None, 1, 1), (4, None, None)]))
    assert none is None
    got = toxicity.score(d, none).collect()
    assert len(got) == d.count() and not any(r.is_toxic for r in got)
    train = toxic_rows(3, 120)
    scorer = toxicity.train(documents(spark, [r[:2] for r in train]), labels(spark, [(i, 1, y) for i, _, y in train] * 2))
    got = toxicity.score(d, scorer).collect()
    assert len(got) == d.count() and all(r.toxicity == 0 and r.worst_word == -1 for r in got if r.doc_id in (1, 2, 3))
    kept = toxicity.clean(d, scorer)
    assert kept.columns == d.columns and kept.where("doc_id IN (1, 2, 3)").count() == 3
    assert toxicity.score(d.limit(0), scorer).count() == 0 and toxicity.clean(d.limit(0), scorer).count() == 0


def quality_rows(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        w = text(rng, n=rng.randrange(30, 300)).split()
        if k % 4 == 0:
            at = rng.randrange(len(w) // 2)
            w[at : at + 40] = [x.upper() + "!!" for x in w[at : at + 40]]
        out.append((k, " ".join(w), int(k % 4 != 0)))
    return out


def test_quality(spark):
    train, test = quality_rows(1, 300), quality_rows(2, 100)
    model = quality.train(documents(spark, [r[:2] for r in train]), labels(spark, [(i, y, 0) for i, _, y in train]))
    got = {r.doc_id: r for r in quality.score(documents(spark, [r[:2] for r in test]), model).collect()}
    assert sum(got[i].is_good == bool(y) for i, _, y in test) >= 0.95 * len(test)
    assert all(r.n_passages == -(-len(t.split()) // quality.PASSAGE) for r, (_, t, _) in zip((got[i] for i, *_ in test), test))
    assert all(0 <= r.top_passage < r.n_passages and 0 < r.top_weight <= 1.0001 for r in got.values())


def test_quality_odd(spark):
    d = odd(spark)
    assert quality.train(d, labels(spark, [(1, 1, 1)])) is None
    got = {r.doc_id: r for r in quality.score(d, None).collect()}
    assert not got[2].is_good and got[4].is_good and got[3].n_passages == 0
    train = quality_rows(3, 100)
    model = quality.train(documents(spark, [r[:2] for r in train]), labels(spark, [(i, y, 0) for i, _, y in train]))
    got = quality.score(d, model).collect()
    assert len(got) == d.count() and all(r.quality == 0 and r.top_passage == -1 for r in got if r.doc_id in (1, 2, 3))
    assert quality.score(d.limit(0), model).count() == 0


def test_gradient():
    import numpy as np
    import pyarrow as pa

    m = quality.Model(1)
    for n in m.NAMES:
        setattr(m, n, getattr(m, n).astype(np.float64))
    (b,) = quality.bags(pa.array([" ".join(f"t{i % 17}" for i in range(200))]))
    e, h = m.encode(b)
    _, g = m.step(e, h, 1)
    loss = lambda: np.log1p(np.exp(-m.score(b)[0][0]))
    for n in m.NAMES:
        x = getattr(m, n)
        at = tuple(0 for _ in x.shape)
        old, eps = x[at], 1e-5
        x[at] = old + eps
        up = loss()
        x[at] = old - eps
        down = loss()
        x[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[n][at], rel=1e-3, abs=1e-6)
