"""Rankers: column expressions of a query's terms and the corpus statistics, and their registry.

A ranker is a function of a ScoreContext that returns a Column. Scores add up over the query's terms in their order; a term
that is given twice counts twice. Term frequency counts non-overlapping occurrences in the lower-cased text, within words too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.analysis import ascii_lower, field
from quernel.operators.index import Stats

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class ScoreContext:
    """terms and stats, and the columns of the docs table that scores are made of."""

    terms: list[str]
    stats: Stats
    k1: float = K1
    b: float = B

    @property
    def length(self) -> Column:
        """Number of tokens, or of characters if there is no token."""
        return F.when(F.col("term_count") > 0, F.col("term_count")).otherwise(F.length("text")).cast("double")

    @property
    def title(self) -> Column:
        return ascii_lower(field("fields", "title"))

    def tf(self, term: str) -> Column:
        return term_frequency("lt", term)


Ranker = Callable[[ScoreContext], Column]


def term_frequency(lt: str | Column, term: str) -> Column:
    text = F.col(lt) if isinstance(lt, str) else lt
    if not term:
        return F.lit(0.0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("double")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def bm25(c: ScoreContext) -> Column:
    s = c.stats
    if not s.n or not s.avgdl:
        return F.lit(0.0)
    norm = F.lit(c.k1) * (F.lit(1.0 - c.b) + F.lit(c.b) * (c.length / F.lit(s.avgdl)))

    def part(term: str) -> Column:
        df = s.df.get(term, 0)
        idf, tf = math.log((s.n - df + 0.5) / (df + 0.5) + 1.0), c.tf(term)
        return F.when(tf > 0, F.lit(idf) * (tf * F.lit(c.k1 + 1.0)) / (tf + norm)).otherwise(0.0)

    return _sum([part(t) for t in c.terms])


def tf_idf(c: ScoreContext) -> Column:
    s = c.stats
    if not s.n:
        return F.lit(0.0)

    def part(term: str) -> Column:
        df = s.df.get(term, 1)
        idf, tf = math.log(s.n / df) if df else math.inf, c.tf(term)
        return F.when(tf > 0, F.log(tf + 1.0) * F.lit(idf)).otherwise(0.0)

    return _sum([part(t) for t in c.terms])


def features(c: ScoreContext) -> dict[str, Column]:
    """What the linear ranker weighs."""
    s = c.stats
    found = _sum([F.when(F.contains(F.col("lt"), F.lit(t)), 1.0).otherwise(0.0) for t in c.terms])
    return {
        "bm25": bm25(ScoreContext(c.terms, s)),
        "tf_idf": tf_idf(c),
        "coverage": found / F.lit(float(len(c.terms))) if c.terms else F.lit(0.0),
        "length_ratio": c.length / F.lit(s.avgdl) if s.avgdl > 0 else F.lit(1.0),
        "title_matches": _sum([F.when(F.contains(c.title, F.lit(t)), 1.0).otherwise(0.0) for t in c.terms]),
    }


WEIGHTS = {"bm25": 0.4, "tf_idf": 0.2, "coverage": 0.2, "length_ratio": 0.05, "title_matches": 0.15}


def linear(c: ScoreContext) -> Column:
    return _sum([x * F.lit(WEIGHTS[k]) for k, x in features(c).items()])


class Registry:
    """Rankers by name. get() of an unknown name gives the default one."""

    def __init__(self):
        self._rankers: dict[str, Ranker] = {}
        self._default = "BM25"
        for name, r in (("BM25", bm25), ("TF-IDF", tf_idf), ("ML-Ranker", linear)):
            self.register(name, r)
        self.version = 0

    def register(self, name: str, ranker: Ranker) -> None:
        if ranker is None or not callable(ranker):
            raise ValueError("a ranker must be callable")
        self._rankers[name] = ranker
        self.version = getattr(self, "version", 0) + 1

    def has(self, name: str) -> bool:
        return name in self._rankers

    def names(self) -> list[str]:
        return sorted(self._rankers)

    def resolve(self, name: str) -> str:
        return name if name in self._rankers else self._default

    def get(self, name: str = "") -> Ranker:
        return self._rankers[self.resolve(name)]

    @property
    def default(self) -> str:
        return self._default

    def set_default(self, name: str) -> bool:
        if name not in self._rankers:
            return False
        self._default = name
        self.version += 1
        return True
