"""Structured search: the syntax tree as predicates over the docs table. It never changes ranked search.

A term must be a token; a phrase's words must follow each other; with ~N, they must be in order with at most N other
tokens between first and last. field:x looks at the tokens of that field alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import analysis
from quernel.plans.parser import And, Fielded, Node, Not, Or, Phrase, Term, parse


def phrase(tokens: Column, words: list[str]) -> Column:
    """The words next to each other; tokens hold no spaces, so a look at the joined tokens is enough."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(words)} "))


def near(tokens: Column, words: list[str], gap: int) -> Column:
    """In order, with at most gap other tokens between the first and the last word.

    One pass over the tokens keeps, for each number of words matched so far, the latest place at which that match begins.
    """
    n = len(words)
    names = [f"s{j}" for j in range(n)]
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("ok"), *[F.lit(-(1 << 28)).alias(x) for x in names])

    def take(acc: Column, token: Column) -> Column:
        new = [F.when(token == words[0], acc["i"]).otherwise(acc["s0"])]
        new += [F.when(token == words[j], acc[names[j - 1]]).otherwise(acc[names[j]]) for j in range(1, n)]
        begin = acc[names[n - 2]] if n > 1 else acc["i"]
        ok = acc["ok"] | ((token == words[-1]) & (acc["i"] - begin - (n - 1) <= gap))
        return F.struct((acc["i"] + 1).alias("i"), ok.alias("ok"), *[c.alias(x) for c, x in zip(new, names)])

    return F.aggregate(tokens, start, take)["ok"]


def predicate(node: Node | None, tokens: Column, fields: Column, config: analysis.AnalyzerConfig = analysis.AnalyzerConfig()) -> Column:
    match node:
        case Term(text):
            return F.array_contains(tokens, text)
        case Phrase(words, distance):
            return near(tokens, words, distance) if distance > 0 else phrase(tokens, words)
        case Fielded(name, query):
            return predicate(query, analysis.tokens(analysis.field(fields, name), config), fields, config) if query is not None else F.lit(False)
        case Not(child):
            return ~predicate(child, tokens, fields, config)
        case And(children):
            return reduce(lambda a, b: a & b, [predicate(c, tokens, fields, config) for c in children])
        case Or(children):
            return reduce(lambda a, b: a | b, [predicate(c, tokens, fields, config) for c in children])
    return F.lit(False)


def search_structured(docs: DataFrame, query: str, config: analysis.AnalyzerConfig = analysis.AnalyzerConfig()) -> DataFrame:
    """Rows of the docs table that the query holds for."""
    return docs.where(predicate(parse(query), F.col("tokens"), F.col("fields"), config))
