"""Bigrams and optimal-string-alignment distance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(term: Column | str) -> Column:
    """Bigrams of ^term$, repeated ones included; none for empty terms."""
    t = _col(term)
    padded = F.concat(F.lit("^"), t, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(grams)


def auto_edit_distance(length: Column) -> Column:
    return F.when(length <= 2, 0).when(length <= 4, 1).otherwise(2)


def auto_distance(n: int) -> int:
    return 0 if n <= 2 else 1 if n <= 4 else 2


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Edits, and swaps of neighbours that are not edited again: rows of the usual table, folded over the characters."""
    a, b = _col(a), _col(b)
    n, m = F.length(a), F.length(b)

    def char(s: Column, i: Column) -> Column:
        return F.substring(s, i, F.lit(1))

    def row(acc: Column, i: Column) -> Column:
        before, last = acc["last"], acc["before"]

        def cell(cells: Column, j: Column) -> Column:
            same = char(a, i) == char(b, j)
            swap = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            base = F.least(
                F.get(before, j) + 1,
                F.element_at(cells, -1) + 1,
                F.get(before, j - 1) + F.when(same, 0).otherwise(1),
            )
            return F.concat(cells, F.array(F.when(swap, F.least(base, F.get(last, j - 2) + 1)).otherwise(base)))

        return F.struct(before.alias("before"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("last"))

    first = F.sequence(F.lit(0), m)
    table = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("before"), first.alias("last")), row)
    return F.when(n == 0, m).when(m == 0, n).otherwise(F.element_at(table["last"], -1))


def osa(a: str, b: str) -> int:
    """osa_distance for two strings."""
    last, now = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        before, last_row = now, last
        now = [i]
        for j in range(1, len(b) + 1):
            v = min(before[j] + 1, now[-1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, last_row[j - 2] + 1)
            now.append(v)
        last = before
    return now[-1]
