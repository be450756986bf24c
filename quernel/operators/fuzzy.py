"""Typo-tolerant terms: a similarity join of query words with the vocabulary through shared bigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import edit_distance
from quernel.functions.edit_distance import ngrams, osa_distance


def ngram_index(terms: DataFrame) -> DataFrame:
    """(ngram, term), each once, of a table of terms."""
    return terms.select("term").distinct().select(F.explode(F.array_distinct(ngrams("term"))).alias("ngram"), "term")


def match_words(grams: DataFrame, words: DataFrame, max_distance: int = 0, limit: int = 10) -> DataFrame:
    """word, term, distance, rank: the nearest terms of each of many words (a column word), in one join; 0 chooses the distance by the word's length.

    A word's bigrams count as often as they occur in it. A term must share enough of them before its distance is computed.
    """
    most = F.lit(max_distance) if max_distance else edit_distance.auto_edit_distance(F.length("word"))
    asked = words.where("word <> ''").select("word").distinct().withColumn("most", most)
    same = asked.where("most = 0").join(grams.select(F.col("term").alias("word")).distinct(), "word").select("word", F.col("word").alias("term"), F.lit(0).alias("distance"))
    mine = asked.where("most > 0").select("word", "most", F.explode(ngrams("word")).alias("ngram")).groupBy("word", "most", "ngram").agg(F.count("*").alias("times"))
    near = grams.join(mine, "ngram").where(F.abs(F.length("term") - F.length("word")) <= F.col("most"))
    near = near.groupBy("word", "most", "term").agg(F.sum("times").alias("shared"))
    left = F.length("word") + 1 - 3 * F.col("most")
    near = near.where(F.col("shared") >= F.when(left > 1, left).otherwise(1))
    # a swap is two plain edits, so the built-in distance leaves few terms to the exact one
    near = near.where(F.levenshtein("word", "term") <= 2 * F.col("most"))
    near = near.select("word", "term", "most", osa_distance("word", "term").alias("distance")).where(F.col("distance") <= F.col("most"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "term"))
    found = near.select("word", "term", "distance").unionByName(same)
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def find_matches(grams: DataFrame, word: str, max_distance: int = 0, limit: int = 10) -> DataFrame:
    """term, distance of vocabulary terms near the word, as match_words()."""
    found = match_words(grams, grams.sparkSession.createDataFrame([(word,)], "word string"), max_distance, limit)
    return found.orderBy("rank").select("term", "distance")


def add_terms(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """The bigram table with more terms, each once."""
    return grams.unionByName(ngram_index(terms)).distinct()


def remove_terms(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """The bigram table without some terms; those that it doesn't have are no matter."""
    return grams.join(terms.select("term").distinct(), "term", "left_anti").select("ngram", "term")


def vocabulary_size(grams: DataFrame) -> int:
    return grams.select("term").distinct().count()


def prefix_expand(terms: DataFrame, word: str) -> DataFrame:
    """The shortest term (then the first) that begins with the word."""
    return suggest(terms, word, 1)


def suggest(terms: DataFrame, prefix: str, most: int = 3) -> DataFrame:
    """The shortest terms (then the first) that begin with the prefix."""
    return terms.where(F.startswith("term", F.lit(prefix))).orderBy(F.length("term"), "term").limit(most).select("term")


def expand(terms: DataFrame, grams: DataFrame, query_terms: list[str], max_distance: int = 0) -> dict[str, str]:
    """Replacements of the query terms that aren't in the vocabulary: by prefix, else by the nearest of few matches. Two jobs, however many words."""
    names = list(dict.fromkeys(query_terms))
    if not names:
        return {}
    words = F.array(*map(F.lit, names))
    begun = terms.where(reduce(lambda a, b: a | b, [F.startswith("term", F.lit(w)) for w in names]))
    begun = begun.select("term", F.explode(F.filter(words, lambda w: F.startswith("term", w))).alias("word"))
    first = {r.word: r.term for r in begun.groupBy("word").agg(F.min_by("term", F.struct(F.length("term").alias("n"), "term")).alias("term")).collect()}  # a row per word
    rest = [w for w in names if w not in first]  # a known word is the shortest that begins with itself
    if rest:
        asked = terms.sparkSession.createDataFrame([(w,) for w in rest], "word string")
        first |= {r.word: r.term for r in match_words(grams, asked, max_distance, 5).where("rank = 1").collect()}
    return {w: first[w] for w in names if first.get(w, w) != w}


def penalty(expanded: int) -> float:
    return max(0.5, 1.0 - 0.1 * expanded) if expanded else 1.0
