"""Text analysis as column expressions: ASCII lower case, tokens, stop words, stems, positions, offsets.

A token is a maximal run of ASCII letters, digits and apostrophes; all other characters separate. Lower-casing is
ASCII-only. Stop words are dropped before stemming, and positions count the tokens that stay. Null texts have no tokens.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel import storage

#: By length, then alphabetically.
STOP_WORDS = tuple(
    (
        "a an as at be by he in is it no of on so to all and are but can few for had has how its nor not now own the too was who why "
        "both each from have just more most only same some such than that they this very what when will with every other where which should"
    ).split()
)
TOKEN = "[A-Za-z0-9']+"
RUNS = "[A-Za-z0-9']+|[^A-Za-z0-9']+"


@dataclass(frozen=True)
class AnalyzerConfig:
    """Options of the tokenizer. stemmer: none, simple or porter (accepted, but leaves words as they are)."""

    lowercase: bool = True
    remove_stop_words: bool = True
    stop_words: tuple[str, ...] = STOP_WORDS
    stemmer: str = "none"
    simd: bool = True  # accepted; execution is vectorised anyway, and results never depend on it

    def __post_init__(self):
        if self.stemmer not in ("none", "simple", "porter"):
            raise ValueError(f"unknown stemmer {self.stemmer}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_col(text), string.ascii_uppercase, string.ascii_lowercase)


def raw_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def is_stop_word(term: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return _col(term).isin(*stop_words) if stop_words else F.lit(False)


def stem_simple(term: Column | str) -> Column:
    """The first rule that fits: tional, ational (shadowed by the former), ional, ing, ed, ly, a single s."""
    t = _col(term)
    n = F.length(t)

    def cut(ending: str, longer: int, drop: int) -> tuple[Column, Column]:
        return F.endswith(t, F.lit(ending)) & (n > longer), F.substring(t, F.lit(1), n - drop)

    rules = [cut("tional", 6, 2), cut("ional", 5, 2), cut("ing", 3, 3), cut("ed", 3, 2), cut("ly", 3, 2)]
    out = F.when(n < 4, t)
    out = reduce(lambda c, r: c.when(*r), rules, out)
    return out.when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def tokens(text: Column | str, config: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """Terms of the text in order, as an array."""
    out = raw_tokens(ascii_lower(text) if config.lowercase else text)
    if config.remove_stop_words and config.stop_words:
        out = F.filter(out, lambda t: ~is_stop_word(t, config.stop_words))
    return F.transform(out, stem_simple) if config.stemmer == "simple" else out


def stem_word(t: str) -> str:
    """stem_simple for one word."""
    n = len(t)
    if n < 4:
        return t
    for ending, longer, drop in (("tional", 6, 2), ("ional", 5, 2), ("ing", 3, 3), ("ed", 3, 2), ("ly", 3, 2)):
        if t.endswith(ending) and n > longer:
            return t[: n - drop]
    return t[:-1] if t.endswith("s") and not t.endswith("ss") else t


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def analyze(text: str | None, config: AnalyzerConfig = AnalyzerConfig()) -> list[tuple[str, int, int, int]]:
    """Tokens of one text as (term, position, start, end); offsets count characters."""
    out, stop = [], set(config.stop_words) if config.remove_stop_words else set()
    for m in re.finditer(TOKEN, text or ""):
        t = m.group().translate(_LOWER) if config.lowercase else m.group()
        if t not in stop:
            out.append((stem_word(t) if config.stemmer == "simple" else t, len(out), m.start(), m.end()))
    return out


_INSIDE = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits + "'").encode(), np.uint8))
_LOWER_BYTES = np.frombuffer(bytes(range(256)).lower(), np.uint8)
OFFSETS = ("term", "position", "start", "end")


def offsets_of_batch(texts: pa.Array, config: AnalyzerConfig = AnalyzerConfig()) -> pa.ListArray:
    """analyze() of many texts, as a list of (term, position, start, end) for each, from their bytes without an object per token."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside, edge = np.append(_INSIDE[data], False), np.zeros(size + 1, bool)
    edge[ends] = True  # of texts
    start = np.flatnonzero(inside[:-1] & (edge[:-1] | ~np.append(False, inside[:-2])[:size]))
    length = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1 - start  # in bytes and in characters, as tokens are ASCII
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before each byte
    row = np.searchsorted(ends, start, side="right") - 1
    begin = chars[start] - chars[ends[row]]
    bytes_ = (_LOWER_BYTES[data] if config.lowercase else data)[inside[:-1]]
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(bytes_))
    if config.remove_stop_words and config.stop_words:
        stay = ~pc.is_in(terms, value_set=pa.array(config.stop_words, pa.string())).to_numpy(zero_copy_only=False)
        terms, row, begin, length = terms.filter(pa.array(stay)), row[stay], begin[stay], length[stay]
    if config.stemmer == "simple":
        words = terms.dictionary_encode()
        terms = pa.array([stem_word(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    first = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
    columns = [np.arange(len(row)) - first[row], begin, begin + length]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([terms, *[pa.array(x, pa.int32()) for x in columns]], list(OFFSETS)))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of a batch's texts of some 4 MB."""
    return storage.slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1 << 22)


def token_offsets(text: Column | str, config: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """Array of (term, position, start, end): cumulative, so done over Arrow batches in linear time."""

    @F.arrow_udf("array<struct<term string, position int, start int, end int>>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [offsets_of_batch(texts.slice(lo, hi - lo), config) for lo, hi in text_slices(texts)]
        return pa.concat_arrays(parts) if parts else offsets_of_batch(texts, config)

    return run(F.coalesce(_col(text), F.lit("")))


def explode_offsets(documents: DataFrame, id: str, text: str, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """doc_id, pos, term, start, end: a row per token, handed on a few MB of text at a time, so memory doesn't rise with a batch's tokens."""

    def run(batches):
        for b in batches:
            for lo, hi in text_slices(b.column(1)):
                found = offsets_of_batch(b.column(1).slice(lo, hi - lo), config)
                of = np.repeat(np.arange(lo, hi), np.diff(found.offsets.to_numpy()))
                term, *places = found.values.flatten()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), places[0].cast(pa.int64()), term, *[x.cast(pa.int64()) for x in places[1:]]], ["doc_id", "pos", "term", "start", "end"])

    storage.ship(documents.sparkSession)
    rows = documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(storage.tidy(run), "doc_id long, pos long, term string, start long, end long")


def all_text(fields: Column | str) -> Column:
    """All field values, in the order of the fields' names, with a space between."""
    f = _col(fields)
    return F.concat_ws(" ", F.transform(F.array_sort(F.map_keys(f)), lambda k: F.coalesce(f[k], F.lit(""))))


def field(fields: Column | str, name: str) -> Column:
    """A field's value, empty if it is missing."""
    return F.coalesce(F.try_element_at(_col(fields), F.lit(name)), F.lit(""))


def loader_term_count(text: Column | str) -> Column:
    """One more than the number of white-space characters; 0 for empty texts."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.regexp_replace(t, "[ \\t\\n\\x0B\\f\\r]", "")) + 1)


def normalize_query(query: Column | str) -> Column:
    """Lower case with single spaces, as cache keys have it."""
    return F.trim(F.regexp_replace(ascii_lower(query), "[ \\t\\n\\x0B\\f\\r]+", " "))
