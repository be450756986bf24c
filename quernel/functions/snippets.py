"""Highlighting, and snippets around the densest windows of query words."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.analysis import RUNS, TOKEN, ascii_lower

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class SnippetOptions:
    max_length: int = 150
    count: int = 3
    open: str = "<mark>"
    close: str = "</mark>"


def highlight(text: Column | str, terms: list[str], open: str = "<mark>", close: str = "</mark>") -> Column:
    """Marks whole words that are query terms, whatever their case."""
    t = F.col(text) if isinstance(text, str) else text
    words = sorted({x.translate(_LOWER) for x in terms})
    if not words:
        return t
    runs = F.regexp_extract_all(t, F.lit(RUNS), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.when(ascii_lower(w).isin(*words), F.concat(F.lit(open), w, F.lit(close))).otherwise(w)), "")


def _mark(text: str, terms: set[str], o: SnippetOptions) -> str:
    return re.sub(TOKEN, lambda m: f"{o.open}{m.group()}{o.close}" if m.group().translate(_LOWER) in terms else m.group(), text)


def windows(text: str, terms: list[str], size: int, count: int) -> list[tuple[int, int, int]]:
    """(start, end, hits) of up to count windows of most hits that don't overlap, by place; one from the start if there are no hits."""
    wanted = {t.translate(_LOWER) for t in terms}
    words = [(m.start(), m.group().translate(_LOWER) in wanted) for m in re.finditer(TOKEN, text)]
    if not words:
        return []
    hits = [0]
    for _, hit in words:
        hits.append(hits[-1] + hit)
    scored, j = [], 0
    for i, (start, _) in enumerate(words):
        end = min(start + size, len(text))
        while j < len(words) and words[j][0] < end:
            j += 1
        if hits[j] > hits[i]:
            scored.append((start, end, hits[j] - hits[i]))
    if not scored:
        return [(0, min(size, len(text)), 0)]
    out: list[tuple[int, int, int]] = []
    for w in sorted(scored, key=lambda w: (-w[2], w[0])):
        if len(out) >= count:
            break
        if all(w[0] >= x[1] or w[1] <= x[0] for x in out):
            out.append(w)
    return sorted(out)


def _is_word(text: str, i: int) -> bool:
    return re.match(TOKEN, text[i : i + 1]) is not None


def snap(text: str, start: int, end: int) -> tuple[int, int]:
    """Moves a start within a word to the next word, and an end within a word behind it."""
    n = len(text)
    if 0 < start < n and _is_word(text, start) and _is_word(text, start - 1):
        while start < n and _is_word(text, start):
            start += 1
        while start < n and not _is_word(text, start):
            start += 1
    if 0 < end < n and _is_word(text, end - 1) and _is_word(text, end):
        while end < n and _is_word(text, end):
            end += 1
    return (start, end) if start < end else (start, min(start + 1, n))


def generate(text: str | None, terms: list[str], o: SnippetOptions = SnippetOptions()) -> list[str]:
    """Snippets of one text."""
    if not text or not terms:
        return []
    wanted = {t.translate(_LOWER) for t in terms}
    if len(text) <= o.max_length:
        return [_mark(text, wanted, o)]
    out = []
    for start, end, _ in windows(text, terms, o.max_length, o.count):
        start, end = snap(text, start, end)
        out.append("..." * (start > 0) + _mark(text[start:end], wanted, o) + "..." * (end < len(text)))
    return out


def snippets(text: Column | str, terms: list[str], options: SnippetOptions = SnippetOptions()) -> Column:
    """Snippets of each text, batch by batch."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: generate(t, terms, options))

    return run(F.col(text) if isinstance(text, str) else text)
