"""Ranked search: candidates, scores, top k, pages, explanations, and many queries at once.

Candidates are the documents that any query term occurs in as a token; of these the ones that score over 0 are hits, in
the order of score, then doc_id. With postings, candidates are the documents of the terms' postings, and only their texts are
read; without, a query is a filter and a projection over the docs table. Statistics are literals either way, so the
exchanges are those of the top k rows and of ids. Many queries are joins over the postings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel import storage
from quernel.functions.snippets import SnippetOptions, snippets
from quernel.operators import index
from quernel.operators.ranking import B, K1, Ranker, Registry, ScoreContext, bm25
from quernel.plans.parser import extract_terms


@dataclass(frozen=True)
class SearchOptions:
    ranker: str = ""
    algorithm: str = "bm25"  # or tf_idf: older way to choose a ranker
    max_results: int = 10
    explain: bool = False
    use_top_k: bool = True
    snippets: bool = False
    snippet: SnippetOptions = SnippetOptions()
    fuzzy: bool = False
    max_edit_distance: int = 0
    use_cache: bool = True
    offset: int = 0
    after_score: float | None = None
    after_id: int | None = None
    k1: float = K1
    b: float = B


def ranker_name(o: SearchOptions, registry: Registry) -> str:
    return registry.resolve(o.ranker) if o.ranker else "TF-IDF" if o.algorithm == "tf_idf" else registry.default


def hits(docs: DataFrame, terms: list[str], stats: index.Stats, ranker: Ranker = bm25, k1: float = K1, b: float = B, postings: DataFrame | None = None) -> DataFrame:
    """Candidates that score over 0: the docs table with a column score."""
    found = index.candidates(docs, terms) if postings is None else index.found_in(docs, postings, stats)
    return scored(found, terms, stats, ranker, k1, b)


def scored(found: DataFrame, terms: list[str], stats: index.Stats, ranker: Ranker = bm25, k1: float = K1, b: float = B) -> DataFrame:
    """The candidates that score over 0."""
    return found.withColumn("score", ranker(ScoreContext(terms, stats, k1, b)).cast("double")).where("score > 0")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), F.asc("doc_id"))


def top_k(found: DataFrame, k: int) -> DataFrame:
    return ordered(found).limit(k)


def explanation(name: str, use_top_k: bool) -> Column:
    method = "Top-K Heap (O(N log K))" if use_top_k else "Full Sort (O(N log N))"
    return F.format_string(f"Ranker: {name}, Score: %.6f, Method: {method}", F.col("score"))


def page(found: DataFrame, size: int, offset: int = 0, after: tuple[float, int] | None = None) -> DataFrame:
    """One page of hits, by offset or behind a (score, doc_id) that was seen."""
    if after is not None:
        score, doc_id = after
        rest = found.where((F.col("score") < F.lit(score)) | ((F.col("score") == F.lit(score)) & (F.col("doc_id") > doc_id)))
        return ordered(rest).limit(size)
    return ordered(found).offset(offset).limit(size)


def search(docs: DataFrame, query: str, o: SearchOptions = SearchOptions(), registry: Registry | None = None, stats: index.Stats | None = None, terms: list[str] | None = None) -> DataFrame:
    """doc_id, fields, score, and explanation and snippets if wanted, of the best max_results hits."""
    registry = registry or Registry()
    terms = extract_terms(query) if terms is None else terms
    stats = stats or index.query_stats(docs, terms)
    name = ranker_name(o, registry)
    best = top_k(hits(docs, terms, stats, registry.get(name), o.k1, o.b), o.max_results)
    return present(best, terms, name, o)


def present(best: DataFrame, terms: list[str], name: str, o: SearchOptions) -> DataFrame:
    out = best.select("doc_id", "fields", "text", "score")
    if o.explain:
        out = out.withColumn("explanation", explanation(name, o.use_top_k))
    if o.snippets:
        out = out.withColumn("snippets", snippets("text", terms, o.snippet))
    return out.drop("text")


def search_batch(spark: SparkSession, docs: DataFrame, postings: DataFrame, queries: list[str], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Best k hits of every query by BM25: qid (place in the list), doc_id, score, rank.

    Queries go to the postings, of which only their terms' rows move on; texts are read for candidates only. The partial
    top k of each partition comes first, so no query's hits are sorted in one place.
    """
    rows = [(q, i, t) for q, text in enumerate(queries) for i, t in enumerate(extract_terms(text))]
    n, avgdl = index.size_of(docs)
    asked = spark.createDataFrame(rows, "qid int, ord int, term string")
    names = asked.select("term").distinct()
    mine = storage.persist(postings.join(F.broadcast(names) if len(rows) <= 100_000 else names, "term").select("term", "doc_id"), "asked-postings")
    df = {r.term: r.df for r in mine.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row per query term
    idf = [(q, i, t, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1.0)) for q, i, t in rows]
    weights = spark.createDataFrame(idf, "qid int, ord int, term string, idf double")
    pairs = mine.join(asked.select("qid", "term").distinct(), "term").select("qid", "doc_id").distinct()
    need = pairs.join(weights, "qid").select("qid", "doc_id", "term", "idf")
    # a text meets all its terms at once, so it moves once and each term is counted in it once, whatever asks for it
    wanted = need.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    length = F.when(F.col("term_count") > 0, F.col("term_count")).otherwise(F.length("text")).cast("double")
    text = docs.select("doc_id", "lt", F.length("lt").alias("chars"), length.alias("dl")).join(wanted, "doc_id")
    text = text.select("doc_id", "lt", "chars", "dl", F.explode("terms").alias("term"))
    tf = ((F.col("chars") - F.length(F.replace("lt", "term", F.lit("")))) / F.length("term")).cast("double")
    each = need.join(text.select("doc_id", "term", "dl", tf.alias("tf")).where("tf > 0"), ["doc_id", "term"])
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * (F.col("dl") / F.lit(avgdl or 1.0)))
    part = F.col("idf") * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + norm)
    scores = each.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
