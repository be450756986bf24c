"""The inverted index as tables: docs, postings, terms, skip pointers and statistics.

docs: doc_id, fields, text (all fields), lt (in ASCII lower case), tokens, term_count. postings: term, doc_id, tf, positions,
one row for each term and document. A term's places in a document never leave the document, so building moves nothing: each
Arrow batch of token lists is sorted by document and term at once, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel import storage
from quernel.functions import analysis
from quernel.functions.analysis import AnalyzerConfig

#: Tokens that a worker sorts at once, of one document if it has more.
TOKENS = 1 << 18
POSTINGS = "term string, doc_id long, tf int, positions array<int>"


def with_fields(documents: DataFrame, **columns: str) -> DataFrame:
    """doc_id and fields, a map of the columns by field name; null values count as empty."""
    pairs = [x for name, c in sorted(columns.items()) for x in (F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.create_map(*pairs).alias("fields"))


def analyze(docs: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """The docs table of (doc_id, fields)."""
    text = docs.select("doc_id", "fields", analysis.all_text("fields").alias("text"))
    return text.withColumn("lt", analysis.ascii_lower("text")).withColumn("tokens", analysis.tokens("text", config)).withColumn("term_count", F.size("tokens").cast("long"))


def postings_of_batch(ids: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    """Postings of some documents, by document."""
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key = row * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")  # places stay in order
    at = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(key)])
    ends = np.append(at, len(key)).astype(np.int32)
    first = pa.array(order[at])
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([words.take(first).cast(pa.string()), ids.take(pa.array(row[order[at]])), pa.array(np.diff(ends)), positions], ["term", "doc_id", "tf", "positions"])


def build_postings(docs: DataFrame) -> DataFrame:
    """Postings of the docs table, of which each document is one row; positions ascend and start at 0."""
    storage.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in storage.slices(sizes, TOKENS):
                yield postings_of_batch(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))

    return docs.select("doc_id", "tokens").mapInArrow(storage.tidy(run), POSTINGS)


def by_term(postings: DataFrame) -> DataFrame:
    """Laid out by term, so that a term's rows are in few row groups, by whose statistics a filter skips the others. Rows of
    frequent terms spread over several parts."""
    return postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def postings_of(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term)


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct()


def terms_of(docs: DataFrame) -> DataFrame:
    """The vocabulary from the docs table."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df from the docs table: no positions, and partial counts leave little to shuffle."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def statistics(docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row: n documents, avgdl (0 if there are none), n_terms."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("term_count"), F.lit(0.0)).alias("avgdl"))
    terms = (postings.select("term") if postings is not None else docs.select(F.explode("tokens").alias("term"))).agg(F.count_distinct("term").alias("n_terms"))
    return size.crossJoin(terms)  # one row by one row


@dataclass(frozen=True)
class Stats:
    """What scores need of the corpus, on the driver: a number for each query term."""

    n: int
    avgdl: float
    df: dict[str, int] = field(default_factory=dict)


def size_of(docs: DataFrame) -> tuple[int, float]:
    """Number of documents and their average number of tokens."""
    r = docs.agg(F.count("*").alias("n"), F.avg("term_count").alias("avgdl")).first()
    return r.n, r.avgdl or 0.0


def stats_of(postings: DataFrame, size: tuple[int, float], terms: list[str]) -> Stats:
    """By the terms' postings alone."""
    names = sorted(set(terms))
    found = postings.where(F.col("term").isin(*names)).groupBy("term").agg(F.count("*").alias("df")).collect() if names else []  # a row per term
    return Stats(*size, {t: 0 for t in names} | {r.term: r.df for r in found})


def query_stats(docs: DataFrame, terms: list[str]) -> Stats:
    """One pass over the docs table."""
    names = sorted(set(terms))
    hits = [F.count_if(F.array_contains("tokens", t)).alias(f"t{i}") for i, t in enumerate(names)]
    r = docs.agg(F.count("*").alias("n"), F.avg("term_count").alias("avgdl"), *hits).first()
    return Stats(r.n, r.avgdl or 0.0, {t: r[f"t{i}"] for i, t in enumerate(names)})


def without(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """docs or postings without some documents (a doc_id column)."""
    return table.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """docs with new rows in place of those of the same doc_id."""
    return without(docs, new).unionByName(new)


def skip_interval(n: Column, interval: int = 0) -> Column:
    return F.lit(interval).cast("long") if interval > 0 else F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(n)))


def skip_pointers(postings: DataFrame, interval: int = 0) -> DataFrame:
    """term, position, doc_id of every interval-th posting by doc_id (default: the root of the list's length)."""
    by_term = Window.partitionBy("term")
    ranked = postings.select(
        "term",
        "doc_id",
        (F.row_number().over(by_term.orderBy("doc_id")) - 1).cast("long").alias("position"),
        F.count("*").over(by_term).alias("n"),
    )
    return ranked.where(F.col("position") % skip_interval(F.col("n"), interval) == 0).select("term", "position", "doc_id")


def find_skip_target(skips: DataFrame, target: int) -> DataFrame:
    """For each term the position of its last skip before the target document, 0 if there is none."""
    return skips.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("doc_id") < target, F.col("position"))), F.lit(0).cast("long")).alias("position"))


def skip_statistics(postings: DataFrame, interval: int = 0) -> DataFrame:
    """term, postings_count, skip_count, interval (0 with a single skip)."""
    counts = postings.groupBy("term").agg(F.count("*").alias("postings_count"))
    step = skip_interval(F.col("postings_count"), interval)
    skips = F.floor((F.col("postings_count") - 1) / step) + 1
    return counts.select("term", "postings_count", skips.alias("skip_count"), F.when(skips > 1, step).otherwise(F.lit(0).cast("long")).alias("interval"))


def intersect(postings: DataFrame, first: str, second: str) -> DataFrame:
    """doc_ids that both terms occur in."""
    a, b = postings_of(postings, first).select("doc_id"), postings_of(postings, second).select("doc_id")
    return a.join(b, "doc_id", "left_semi")


def found_in(docs: DataFrame, postings: DataFrame, stats: Stats, most: int = 1_000_000) -> DataFrame:
    """Documents that any of the terms of stats occurs in, by their postings. Ids are sent to the documents if there are at most so many."""
    names = [t for t, df in stats.df.items() if df]
    if not names:
        return docs.limit(0)
    ids = postings.where(F.col("term").isin(*names)).select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if sum(stats.df.values()) <= most else ids, "doc_id", "left_semi")


def candidates(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that any of the terms occurs in."""
    return docs.where(F.arrays_overlap("tokens", F.array(*map(F.lit, sorted(set(terms)))))) if terms else docs.limit(0)


def asked(docs: DataFrame, terms: list[str]) -> DataFrame:
    """All that a search for the terms needs of the docs table, by one pass: doc_id, term_count and found, the terms that occur, of each document, and
    fields of those where any does. Once written, statistics and hits are read from it."""
    found = docs.select("doc_id", "fields", "term_count", F.array_intersect(F.array(*map(F.lit, sorted(set(terms)))).cast("array<string>"), "tokens").alias("found"))
    return found.select("doc_id", "term_count", "found", F.when(F.size("found") > 0, F.col("fields")).alias("fields"))


def found_of(rows: DataFrame) -> DataFrame:
    """Of asked(): the documents that any of the terms occurs in, with text and lt."""
    d = rows.where(F.size("found") > 0).select("doc_id", "fields", analysis.all_text("fields").alias("text"), "term_count")
    return d.withColumn("lt", analysis.ascii_lower("text"))


def stats_of_asked(rows: DataFrame, terms: list[str]) -> Stats:
    return query_stats(rows.withColumnRenamed("found", "tokens"), terms)
