"""Result cache of the driver: least recently used out first, entries expire after a time."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass


@dataclass(frozen=True)
class CacheStatistics:
    hits: int
    misses: int
    evictions: int
    size: int
    max_entries: int

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class QueryCache:
    """Holds collected results by key. ttl in seconds; 0 or less never expires. No more than max_entries stay."""

    def __init__(self, max_entries: int = 1024, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self._max, self._ttl, self._clock = max_entries, ttl, clock
        self._entries: OrderedDict[Hashable, tuple[float, object]] = OrderedDict()
        self._lock = threading.RLock()
        self._hits = self._misses = self._evictions = 0

    def get(self, key: Hashable):
        """The result, or None."""
        with self._lock:
            found = self._entries.get(key)
            if found is not None and self._ttl > 0 and self._clock() - found[0] > self._ttl:
                del self._entries[key]
                self._evictions += 1
                found = None
            if found is None:
                self._misses += 1
                return None
            self._entries.move_to_end(key)
            self._hits += 1
            return found[1]

    def put(self, key: Hashable, value: object) -> None:
        with self._lock:
            self._entries[key] = (self._clock(), value)
            self._entries.move_to_end(key)
            self._evict()

    def _evict(self) -> None:
        while len(self._entries) > self._max:
            self._entries.popitem(last=False)
            self._evictions += 1

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()

    def set_max_entries(self, n: int) -> None:
        with self._lock:
            self._max = n
            self._evict()

    def set_ttl(self, seconds: float) -> None:
        with self._lock:
            self._ttl = seconds

    def statistics(self) -> CacheStatistics:
        with self._lock:
            return CacheStatistics(self._hits, self._misses, self._evictions, len(self._entries), self._max)
