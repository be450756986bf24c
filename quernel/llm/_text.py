"""Vectorised text primitives: normalised byte streams, words and 64-bit hashes of whole Arrow batches.

A word is a maximal run of ASCII letters and digits and of all characters beyond ASCII, lower-cased.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
CHUNK, ROWS = 1 << 19, 2048
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WORD_BYTES = np.full(256, SPACE, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    WORD_BYTES[_b] = _b
for _b in range(65, 91):
    WORD_BYTES[_b] = _b + 32

_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash's base and of its inverse modulo 2**64."""
    if len(_tables.get("p", ())) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        for k, base in (("p", _P), ("i", _PI)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _tables[k] = np.multiply.accumulate(x)
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    bufs = arr.buffers()
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    offs = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    data = data[offs[0] : offs[-1]]
    return data, offs - offs[0]


def spaced(arr: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, a space behind each."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if lower:
        arr = pc.utf8_lower(arr)
    return raw(pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))


def pieces(data: np.ndarray, offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about size bytes, 2**15 at most, together: first row, end, bytes, offsets."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1), lo + (1 << 15))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of consecutive rows: the normalised bytes (one space behind each word, rows may be empty), each word's start and end, each row's first word."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi = lo, hi
        b = WORD_BYTES[data]
        sp = b == SPACE
        keep = np.empty(len(b), bool)
        keep[:1] = ~sp[:1]
        np.logical_not(sp[1:] & sp[:-1], out=keep[1:])
        at = np.zeros(len(b) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        self.buf = b[keep]
        self.offs = at[offs]
        sp = self.buf == SPACE
        self.ends = np.flatnonzero(sp)
        if len(self.ends) and self.ends[0] == 0:  # cannot happen: a leading space is never kept
            self.ends = self.ends[1:]
        self.starts = np.empty_like(self.ends)
        self.starts[:1] = 0
        self.starts[1:] = self.ends[:-1] + 1
        self.first = np.searchsorted(self.starts, self.offs)  # per row, with the end at last

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        p, inv = powers(len(self.buf) + 1)
        s = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(self.buf * p[: len(self.buf)], out=s[1:])
        return mix((s[self.ends] - s[self.starts]) * inv[self.starts])

    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def words(arr: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a column, some rows at a time."""
    for base in range(0, len(arr), ROWS):
        data, offs = spaced(arr.slice(base, ROWS), True)
        for lo, hi, part, ends in pieces(data, offs, size):
            yield Words(base + lo, base + hi, part, ends)


def tidy(run):
    """The function for mapInArrow, which then gives free memory back to the system: workers live on, beside those of later stages."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # a C library that has no such call
            pass

    return tidied


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n of the hashes (n <= len(h))."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x100000001B3)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the end."""
    pad = np.zeros(len(b) + 16, np.uint8)
    pad[: len(b)] = b
    out = np.empty(len(b) + 8, np.uint64)
    m = len(b) // 8 + 1
    for k in range(8):
        v = pad[k : k + m * 8].view(np.uint64)
        out[k::8][: len(v)] = v[: len(out[k::8])]
    return out[: len(b)]
