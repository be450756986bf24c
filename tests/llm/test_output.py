"""Mixing, records and the pipeline."""

import random
import struct
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import _spark, decontaminate, mixing, ngram_join, records, toxicity
from tests.llm.helpers import documents, odd, prose, shuffled

# Pfair


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=9), st.integers(9, 80))
def test_period(weights, size):
    k = mixing.units(weights, size)
    assert sum(k) == size and min(k) >= 1
    done = Counter()
    for slot, (i, j) in enumerate(mixing.period(k), 1):
        assert j == done[i]
        done[i] += 1
        for s, n in enumerate(k):
            assert abs(done[s] - Fraction(slot * n, size)) < 1


def sources(spark, sizes, seed=1, chars=100):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        rows += [(len(rows) + i, "x" * rng.randrange(1, chars), s) for i in range(n)]
    return documents(spark, rows), rows


def slow_schedule(rows_in_order, k, block):
    """rows_in_order: source to (doc_id, size) in its order. Slots by simulating every slot."""
    size, blocks = sum(k.values()), {}
    for s, docs in rows_in_order.items():
        at, blocks[s] = 0, {}
        for i, n in docs:
            blocks[s].setdefault(at // block + 1, []).append(i)
            at += n
        blocks[s]["n"] = max(1, -(-at // block))
    done, out, slot = Counter(), {}, 0
    names = sorted(k)
    while True:
        ready = [((-(-(done[s] + 1) * size // k[s])), n, s) for n, s in enumerate(names) if done[s] * size // k[s] <= slot]
        _, _, s = min(ready)
        done[s] += 1
        if done[s] > blocks[s]["n"]:
            return out
        for i in blocks[s].get(done[s], []):
            out[i] = slot
        slot += 1


def test_schedule(spark):
    docs, rows = sources(spark, {"a": 300, "b": 100, "c": 40})
    weights = {"a": 2.0, "b": 1.0, "c": 1.0, "missing": 5.0}
    got = mixing.schedule(docs, weights, block_chars=250, resolution=16).collect()
    assert len(got) == len(rows)
    order = {s: [(r.doc_id, len(r.text)) for r in sorted((r for r in got if r.source == s), key=lambda r: r.char_start)] for s in "abc"}
    for s in "abc":  # places add up
        assert [r.char_start for r in sorted((r for r in got if r.source == s), key=lambda r: r.char_start)] == np.cumsum([0, *(n for _, n in order[s])])[:-1].tolist()
    k = dict(zip("abc", mixing.units([2.0, 1.0, 1.0], 24)))
    assert {r.doc_id: r.slot for r in got if r.slot is not None} == slow_schedule(order, k, 250)
    again = mixing.schedule(docs.repartition(7), weights, block_chars=250, resolution=16).collect()
    assert {(r.doc_id, r.slot) for r in again} == {(r.doc_id, r.slot) for r in got}


def test_mix(spark, tmp_path):
    docs, rows = sources(spark, {"a": 500, "b": 60}, chars=2000)
    plan = {r.doc_id: (r.slot, r.char_start) for r in mixing.schedule(docs).collect()}
    mixing.mix(docs).write.parquet(f"{tmp_path}/m")
    out = spark.read.parquet(f"{tmp_path}/m").collect()
    assert spark.read.parquet(f"{tmp_path}/m").columns == docs.columns
    assert [r.doc_id for r in mixing.mix(docs).collect()] == sorted((i for i, (s, _) in plan.items() if s is not None), key=lambda i: plan[i])
    assert {r.doc_id for r in out} == {i for i, (s, _) in plan.items() if s is not None}


def test_buckets(spark, monkeypatch):
    docs, rows = sources(spark, {"a": 200, "b": 50})
    monkeypatch.setattr(mixing, "BUCKET_CHARS", 700)
    got = mixing.schedule(docs, block_chars=250).collect()
    for s in "ab":
        own = sorted((r for r in got if r.source == s), key=lambda r: r.char_start)
        assert [r.char_start for r in own] == np.cumsum([0, *(len(r.text) for r in own)])[:-1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 10), st.integers(1, 300)), min_size=1, max_size=7), st.integers(8, 40))
def test_phases(sources, size):
    k, blocks = mixing.units([w for w, _ in sources], size), [n for _, n in sources]
    ranges, table, end = mixing.phases(k, blocks)
    at = {(p, i, n): s for p, i, n, s in table}
    order = {}
    for p, i, before, upto, first, n, period in ranges:
        for j in range(before, upto):
            order[first + (j - before) // n * period + at[p, i, (j - before) % n]] = p, i, j
    assert sorted(order) == list(range(end)) and end == sum(blocks)  # a slot for every block, none twice
    assert len({p for p, *_ in ranges}) <= len(k)
    done, since, phase, start = Counter(), Counter(), 0, 0
    for slot in range(end):
        p, i, j = order[slot]
        if p != phase:
            assert any(done[s] == blocks[s] for s in of)  # a phase ends where a source does
            phase, start, since = p, slot, Counter()
        if not since:
            of = [s for s in range(len(k)) if done[s] < blocks[s]]
        assert j == done[i]
        done[i] += 1
        since[i] += 1
        for s in of:
            assert abs(since[s] - Fraction((slot + 1 - start) * k[s], sum(k[x] for x in of))) < 1


def test_whole_mixture(spark):
    docs, rows = sources(spark, {"a": 400, "b": 60, "tiny": 1}, chars=2000)
    rows.append((999, "", "b"))
    docs = documents(spark, rows)
    got = mixing.schedule(docs).collect()
    assert len(got) == len(rows) and all(r.slot is not None for r in got)
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == sorted(i for i, *_ in rows)
    # weights that are given: whole when asked for, and the part that holds the weights is where it was
    strict = {r.doc_id: r.slot for r in mixing.schedule(docs, {"a": 1.0, "b": 1.0, "tiny": 1.0}).collect()}
    whole = {r.doc_id: r.slot for r in mixing.schedule(docs, {"a": 1.0, "b": 1.0, "tiny": 1.0}, whole=True).collect()}
    assert None in strict.values() and None not in whole.values()
    assert all(whole[i] == s for i, s in strict.items() if s is not None)


def test_empty_behind_full_block(spark):
    docs = documents(spark, [(i, "x" * 100, "a") for i in range(5)] + [(10 + i, "", "a") for i in range(20)])
    assert mixing.schedule(docs, block_chars=100).where("slot IS NULL").count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_mixture_of_repeated_rows_in_parts(spark, monkeypatch, few):
    """Parts are successive slots, and rows that are alike but for other columns are there once each, on whichever side of an edge."""
    monkeypatch.setattr(mixing, "PART_CHARS", 2000)
    monkeypatch.setattr(mixing, "BUCKET_CHARS", 5000)
    monkeypatch.setattr(_spark, "FEW", few)
    rng = random.Random(8)
    rows = [(rng.randrange(12) or None, "x" * rng.choice([0, 70, 400, 3000]), rng.choice(["a", "b", None])) for _ in range(60)]
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 7]))]
    docs = documents(spark, rows).withColumn("n_chars", F.monotonically_increasing_id()).repartition(5)
    docs, _ = _spark.cut(docs, "repeated")
    for options in ({}, {"weights": {"a": 2.0, "b": 1.0}}):
        plan = mixing.schedule(docs, block_chars=150, **options).where("slot IS NOT NULL").orderBy("slot", "char_start", "doc_id").collect()
        got = mixing.mix(docs, block_chars=150, **options)
        assert got.rdd.getNumPartitions() > 5
        got = got.collect()
        assert [(r.doc_id, r.text, r.source) for r in got] == [(r.doc_id, r.text, r.source) for r in plan]
        assert len({r.n_chars for r in got}) == len(got) and (options or len(got) == len(rows))


def test_mix_shuffles_texts_once(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)), "ab"[k % 2]) for k in range(100)]
    docs, _ = _spark.cut(documents(spark, rows), "texts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = shuffled(spark)
        assert mixing.mix(docs).count() == 100 and len(mixing.mix(docs).collect()) == 100
        assert sum(n for name, n in shuffled(spark).items() if name not in old) < 1.2 * 100 * 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mix_odd(spark):
    d = odd(spark)
    got = mixing.schedule(d)
    assert got.count() == d.count() and got.where("slot IS NULL").count() < d.count()
    assert mixing.mix(d).columns == d.columns and mixing.mix(d).where("block = 'clash'").count() == mixing.mix(d).count() > 0
    assert mixing.schedule(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    n = documents(spark, [(1, "a", None), (2, "b", "x"), (3, None, None)])
    assert mixing.schedule(n).where("slot IS NOT NULL").count() == 3
    assert mixing.schedule(n, {"x": 1.0}).where("slot IS NOT NULL").count() == 1
    assert mixing.schedule(n, {"x": 0.0}).where("slot IS NOT NULL").count() == 0


# records


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12))
def test_crc(parts):
    offs = np.cumsum([0, *map(len, parts)])
    assert records.crc32c(np.frombuffer(b"".join(parts), np.uint8), offs).tolist() == [slow_crc(x) for x in parts]


def test_crc_known():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0] == 0xE3069283


def test_records(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 40 + i) if i % 5 else "" if i % 2 else None) for i in range(50)]).repartition(3)
    enc = records.tokenizer(records.load_ranks())
    got = records.encode(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 50
    for r in got:
        payload = records.unframe(r.record)
        ids = np.frombuffer(payload, "<u2").tolist()
        assert enc.decode(ids) == (texts[r.doc_id] or "") and len(ids) == r.n_tokens and len(r.record) == r.size
    index = records.write_shards(docs, f"{tmp_path}/out", end_id=50256).collect()
    for r in index:
        assert enc.decode(records.read_record(f"{tmp_path}/out", r.shard, r.offset, r.size)[:-1]) == (texts[r.doc_id] or "")
    for shard in {r.shard for r in index}:
        own = sorted((r for r in index if r.shard == shard), key=lambda r: r.seq)
        assert [r.offset for r in own] == np.cumsum([0, *(r.size for r in own)])[:-1].tolist()
        assert (tmp_path / "out" / f"shard-{shard:05d}.rec").stat().st_size == sum(r.size for r in own)


def test_order_of_the_mixture_in_shards(spark, tmp_path, monkeypatch):
    """The records of a mixture of several files, read back, are in the mixture's order by (shard, seq)."""
    monkeypatch.setattr(mixing, "PART_CHARS", 60_000)
    docs, _ = sources(spark, {"a": 500, "b": 60}, chars=2000)
    order = [r.doc_id for r in mixing.mix(docs).collect()]
    mixing.mix(docs).write.parquet(f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    assert len(back.inputFiles()) > 4
    index = records.write_shards(records.in_file_order(back, "shard"), f"{tmp_path}/out", shard="shard").collect()
    assert [r.doc_id for r in sorted(index, key=lambda r: (r.shard, r.seq))] == order
    enc, texts = records.tokenizer(records.load_ranks()), {r.doc_id: r.text for r in docs.collect()}
    for r in index[::7]:
        assert enc.decode(records.read_record(f"{tmp_path}/out", r.shard, r.offset, r.size)) == texts[r.doc_id]
    assert records.in_file_order(back.selectExpr("*", "1 AS file", "2 AS start"), "shard").columns == [*back.columns, "file", "start", "shard"]


def test_ranks_by_setting(spark):
    spark.conf.set(records.SETTING, "/nowhere.tiktoken")
    try:
        with pytest.raises(FileNotFoundError, match=records.SETTING):
            records.encode(odd(spark))
    finally:
        spark.conf.unset(records.SETTING)


def test_broken_records():
    frame = bytes(records.frames(np.frombuffer(b"hello", np.uint8), np.array([0, 5]))[0])
    assert records.unframe(frame) == b"hello"
    assert struct.unpack("<Q", frame[:8])[0] == 5
    for k in (0, 9, 13, len(frame) - 1):
        bad = bytearray(frame)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(frame[:10])


def test_records_odd(spark):
    d = odd(spark)
    got = records.encode(d).collect()
    assert len(got) == d.count() and sum(r.n_tokens == 0 for r in got) == 3
    assert records.encode(d.limit(0)).count() == 0


def test_pipeline_odd(spark, tmp_path):
    """Clashing columns, nulls, empty and very long texts and repeated rows through every stage; an empty table, too."""
    d = odd(spark)
    spark.createDataFrame([(k, 1, k % 2) for k in range(7)], "doc_id long, quality int, toxic int").where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, x in enumerate((d, d.limit(0))):
        stage = x
        for name, f in corpus_pipeline.STAGES:
            f(spark, stage, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            stage = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            if name != "token_records":
                assert stage.columns == d.columns and stage.where("_slot <> 'clash' OR gone <> 'clash' OR c0 <> 'clash'").count() == 0
            assert stage.count() == x.count()


# pipeline


def pipeline_tables(spark, folder):
    rng, rows, lab = random.Random(8), [], []
    items = [(k, prose(900 + k, 30)) for k in range(5)]
    for k in range(240):
        w = prose(k, 60).split()
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vilebad", "rudeword", "vilebads"])
        if k % 11 == 1:
            w += items[k % 5][1].split()
        rows.append((k, " ".join(w), f"s{k % 3}"))
        lab.append((k, 1, int(k % 6 == 0)))
    rows += [(300 + k, rows[k][1] + " tail", "s1") for k in range(1, 40, 3)] + [(400, None, "s0"), (401, "", "s0"), (None, prose(5000, 20), "s1")]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    from tests.llm.test_search_ops import slow_distance, slow_pairs, split

    folder = str(tmp_path)
    rows, items = pipeline_tables(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_records"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # the same decisions, one row at a time
    scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, scorer).where("is_toxic").collect()}
    left = [(i, t) for i, t, _ in rows if i not in bad]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b, *_ in slow_pairs(left, ngram_join.N, ngram_join.THRESHOLD):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    left = [(i, t) for i, t in left if i is None or root(i) == i]
    left = [(i, t) for i, t in left if not any(slow_distance(split(x), split(t)) <= int(decontaminate.RATE * 30) for _, x in items)]
    s = {i: s for i, _, s in rows}
    mixed = mixing.mix(documents(spark, [(i, t, s[i]) for i, t in left]))
    out = corpus_pipeline.run(spark, folder)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in mixed.collect())
    assert out.count() > 50 and len(left) < len(rows) - len(bad)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, folder)
        assert stage.columns == docs.columns
