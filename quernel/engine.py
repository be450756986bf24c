"""The engine: an index that can be changed and asked, with results on the driver.

State is immutable: a list of segments, each a docs table and its postings, and for each the ids that later changes took
out. A change writes one segment of the documents that it brings, and ids; it reads nothing that is there. From SEGMENTS
segments on a change ends with writing all as one. Readers go on with the tables that they have.
"""

from __future__ import annotations

import threading
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel import storage
from quernel.cache import CacheStatistics, QueryCache
from quernel.functions.analysis import AnalyzerConfig
from quernel.functions.snippets import generate
from quernel.operators import fuzzy, index, search, structured
from quernel.operators.ranking import B, K1, Ranker, Registry
from quernel.operators.search import SearchOptions
from quernel.plans.parser import extract_terms, normalize_query
from quernel.sources import snapshot
from quernel.sources.loaders import numbered

DOCS = "doc_id long, fields map<string,string>, text string, lt string, tokens array<string>, term_count long"
#: Segments that there may be before a change writes all as one.
SEGMENTS = 8


@dataclass(frozen=True)
class SearchResult:
    doc_id: int
    score: float
    fields: dict[str, str]
    explanation: str = ""
    snippets: tuple[str, ...] = ()
    expanded_terms: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Page:
    results: list[SearchResult]
    total_hits: int
    offset: int
    page_size: int
    has_next_page: bool


@dataclass(frozen=True)
class Segment:
    docs: DataFrame
    postings: DataFrame
    gone: tuple[DataFrame, ...] = ()  # tables of ids

    def live(self, table: DataFrame) -> DataFrame:
        return index.without(table, reduce(DataFrame.union, self.gone)).select(*table.columns) if self.gone else table


class SearchEngine:
    def __init__(self, spark: SparkSession, config: AnalyzerConfig = AnalyzerConfig()):
        self.spark, self.config = spark, config
        self.registry, self.cache = Registry(), QueryCache()
        self.k1, self.b = K1, B
        self._lock = threading.RLock()
        self.version = 0
        self.clear()

    def clear(self) -> None:
        """Drops all documents; ids start at 1 again."""
        with self._lock:
            self._next_id = 1
            self._set([])

    def _set(self, segments: list[Segment]) -> None:
        if len(segments) > SEGMENTS:
            self._segments = segments
            docs, postings = (storage.persist(t, "compacted") for t in (self.docs, self.postings))
            segments = [Segment(docs, postings)]
        self._segments, self._size, self._grams = segments, None, None
        self.version += 1
        self.cache.clear()

    # changes

    def _segment(self, docs: DataFrame) -> Segment:
        table = storage.persist(index.analyze(docs, self.config), "docs")
        return Segment(table, storage.persist(index.by_term(index.build_postings(table)), "postings"))

    def _without(self, ids: DataFrame) -> list[Segment]:
        return [replace(s, gone=(*s.gone, ids)) for s in self._segments]

    def index_documents(self, documents: DataFrame) -> None:
        """Adds (doc_id, fields), in place of documents of the same ids; null ids are given, above all that there are."""
        with self._lock:
            # read once, so that rows keep their places
            docs = storage.persist(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "fields"), "incoming")
            ids = docs.agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("free")).first()
            first = max(self._next_id, (ids.top or 0) + 1)
            # of rows with one id in a batch one stays: the greatest
            given = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by("fields", F.to_json("fields")).alias("fields"))
            if ids.free:
                given = given.unionByName(numbered(docs.where("doc_id IS NULL").select("fields"), first).select("doc_id", "fields"))
            new = self._segment(given)
            old = self._segments if ids.low is None or ids.low >= self._next_id else self._without(new.docs.select("doc_id"))
            self._next_id = first + ids.free
            self._set([*old, new])

    def index_document(self, fields: dict[str, str], doc_id: int = 0) -> int:
        """Adds one document; an id of 0 is replaced by the next free one, which is returned."""
        with self._lock:
            doc_id = doc_id if doc_id > 0 else self._next_id
            self.index_documents(self.spark.createDataFrame([(doc_id, fields)], "doc_id long, fields map<string,string>"))
            return doc_id

    def _has(self, doc_id: int) -> bool:
        return bool(self.docs.where(F.col("doc_id") == doc_id).limit(1).count())

    def update_document(self, doc_id: int, fields: dict[str, str]) -> bool:
        with self._lock:
            if not self._has(doc_id):
                return False
            self.index_document(fields, doc_id)
            return True

    def delete_document(self, doc_id: int) -> bool:
        with self._lock:
            if not self._has(doc_id):
                return False
            self._set(self._without(self.spark.createDataFrame([(doc_id,)], "doc_id long")))
            return True

    def set_config(self, config: AnalyzerConfig) -> None:
        """Changes the analyzer and builds the index anew with it."""
        with self._lock:
            docs, self.config = self.docs.select("doc_id", "fields"), config
            self._set([self._segment(docs)] if self._segments else [])

    # tables

    def _all(self, name: str, schema: str) -> DataFrame:
        parts = [s.live(getattr(s, name)) for s in self._segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    @property
    def docs(self) -> DataFrame:
        with self._lock:
            return self._all("docs", DOCS)

    @property
    def postings(self) -> DataFrame:
        with self._lock:
            return self._all("postings", index.POSTINGS)

    def size(self) -> tuple[int, float]:
        """Number of documents and their average number of tokens."""
        with self._lock:
            if self._size is None:
                self._size = index.size_of(self.docs)
            return self._size

    def vocabulary(self) -> DataFrame:
        return index.vocabulary(self.postings)

    def has_term(self, term: str) -> bool:
        return bool(index.postings_of(self.postings, term).limit(1).count())

    def grams(self) -> DataFrame:
        with self._lock:
            if self._grams is None:
                self._grams = storage.persist(fuzzy.ngram_index(self.vocabulary()), "grams")
            return self._grams

    def statistics(self) -> dict:
        return index.statistics(self.docs, self.postings).first().asDict()

    def skip_statistics(self, term: str) -> dict:
        row = index.skip_statistics(index.postings_of(self.postings, term)).first()
        if row is None:
            return {"term": term, "postings_count": 0, "skip_count": 0, "interval": 0, "needs_rebuild": True}
        return row.asDict() | {"needs_rebuild": False}

    def rebuild_skip_pointers(self, term: str | None = None) -> None:
        """Nothing to do: skip pointers are a view of the postings."""

    def documents(self, offset: int = 0, limit: int = 10) -> list[dict]:
        return [r.asDict() for r in self.docs.orderBy("doc_id").offset(offset).limit(limit).select("doc_id", "fields", "term_count").collect()]

    def suggest(self, prefix: str, most: int = 3) -> list[str]:
        """The shortest terms that begin with the prefix."""
        return [r.term for r in fuzzy.suggest(self.vocabulary(), prefix, most).collect()]

    # rankers

    def register_ranker(self, name: str, ranker: Ranker) -> None:
        if ranker is not None:
            self.registry.register(name, ranker)

    def set_default_ranker(self, name: str) -> bool:
        return self.registry.set_default(name)

    def set_bm25(self, k1: float, b: float) -> None:
        self.k1, self.b = k1, b

    # search

    def _key(self, query: str, o: SearchOptions) -> tuple:
        return normalize_query(query), o, self.version, self.registry.version, self.registry.default, self.k1, self.b

    def _plan(self, query: str, o: SearchOptions) -> tuple[DataFrame | None, list[str], dict[str, str], str]:
        """Hits (scores with the penalty for expansions), the terms in use, the expansions and the ranker's name."""
        terms = extract_terms(query)
        if not terms:
            return None, [], {}, ""
        new: dict[str, str] = {}
        if o.fuzzy:
            new = fuzzy.expand(self.vocabulary(), self.grams(), terms, o.max_edit_distance)
            terms = [new.get(t, t) for t in terms]
        name = search.ranker_name(o, self.registry)
        postings = self.postings
        stats = index.stats_of(postings, self.size(), terms)
        found = search.hits(self.docs, terms, stats, self.registry.get(name), self.k1, self.b, postings)
        # the penalty is part of the score that cursors are compared with
        return found.withColumn("score", F.col("score") * F.lit(fuzzy.penalty(len(new)))), terms, new, name

    def _results(self, best: DataFrame, terms: list[str], new: dict[str, str], name: str, o: SearchOptions) -> list[SearchResult]:
        out = []
        method = "Top-K Heap (O(N log K))" if o.use_top_k else "Full Sort (O(N log N))"
        for r in best.select("doc_id", "fields", "text", "score").collect():
            why = f"Ranker: {name}, Score: {r.score:.6f}, Method: {method}" if o.explain else ""
            cut = tuple(generate(r.text, terms, o.snippet)) if o.snippets else ()
            out.append(SearchResult(r.doc_id, r.score, r.fields, why, cut, dict(new)))
        return out

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> list[SearchResult]:
        """The best max_results hits. Offset and cursor don't matter here."""
        o = options
        key = self._key(query, o) if o.use_cache and normalize_query(query) else None
        if key and (known := self.cache.get(key)) is not None:
            return known
        found, terms, new, name = self._plan(query, o)
        if found is None:
            return []
        out = self._results(search.top_k(found, o.max_results), terms, new, name, o)
        if key:
            self.cache.put(key, out)
        return out

    def search_by(self, query: str, ranker: str, k: int = 10) -> list[SearchResult]:
        """The best k hits by a ranker of that name."""
        return self.search(query, SearchOptions(ranker=ranker, max_results=k))

    def search_rows(self, query: str, options: SearchOptions = SearchOptions()) -> dict:
        """A page as a dict of JSON values: results, each a dict, and pagination."""
        page = self.search_page(query, options)
        rows = [asdict(r) | {"snippets": list(r.snippets)} for r in page.results]
        pages = {"total_hits": page.total_hits, "offset": page.offset, "page_size": page.page_size, "has_next_page": page.has_next_page}
        if page.results:
            pages |= {"last_score": page.results[-1].score, "last_doc_id": page.results[-1].doc_id}
        return {"query": query, "total_results": len(rows), "results": rows, "pagination": pages}

    def search_page(self, query: str, options: SearchOptions = SearchOptions()) -> Page:
        """A page of max_results hits, by offset, or behind (after_score, after_id) if both are given."""
        o = options
        found, terms, new, name = self._plan(query, o)
        if found is None:
            return Page([], 0, 0, 0, False)
        total, offset, after = found.count(), o.offset, None
        if o.after_score is not None and o.after_id is not None:
            after = (o.after_score, o.after_id)
            rest = (F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("doc_id") > after[1]))
            offset = total - found.where(rest).count()
        best = search.page(found, o.max_results, 0 if after else offset, after)
        results = self._results(best, terms, new, name, o)
        return Page(results, total, offset, len(results), offset + len(results) < total and bool(results))

    def search_batch(self, queries: list[str], k: int = 10) -> DataFrame:
        return search.search_batch(self.spark, self.docs, self.postings, queries, k, self.k1, self.b)

    def search_structured(self, query: str) -> DataFrame:
        return structured.search_structured(self.docs, query, self.config)

    # snapshots and cache

    def save(self, path: str) -> bool:
        """False if nothing can be written there; what was saved there before stays until the new snapshot is whole."""
        with self._lock:
            docs, postings, next_id = self.docs, self.postings, self._next_id
        try:
            snapshot.save(path, docs, postings, next_id)
        except (Py4JJavaError, PySparkException, snapshot.SnapshotError):
            return False
        return True

    def load(self, path: str) -> bool:
        """False, and nothing changes, if there is no snapshot."""
        try:
            s = snapshot.load(self.spark, path)
        except snapshot.SnapshotError:
            return False
        with self._lock:
            self._next_id = s.next_id
            self._set([Segment(s.docs, s.postings)])
        return True

    def clear_cache(self) -> None:
        self.cache.clear()

    def set_cache(self, max_entries: int, ttl: float) -> None:
        self.cache.set_max_entries(max_entries)
        self.cache.set_ttl(ttl)

    def cache_statistics(self) -> CacheStatistics:
        return self.cache.statistics()
