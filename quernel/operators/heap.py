"""A bounded heap of (score, doc_id) on the driver, for results that are merged there. Over tables, search.top_k does the same."""

from __future__ import annotations

import heapq


class TopK:
    """Keeps the best k: higher scores first, then lower ids. With k = 0 nothing stays."""

    def __init__(self, k: int):
        if k < 0:
            raise ValueError("k must not be negative")
        self.capacity = k
        self._heap: list[tuple[float, int]] = []  # the worst first; ids are negated, as the lower is the better

    def push(self, score: float, doc_id: int) -> None:
        if len(self._heap) < self.capacity:
            heapq.heappush(self._heap, (score, -doc_id))
        elif self.capacity and (score, -doc_id) > self._heap[0]:
            heapq.heapreplace(self._heap, (score, -doc_id))

    def peek(self) -> list[tuple[float, int]]:
        """The best first; the heap stays as it is."""
        return [(s, -i) for s, i in sorted(self._heap, reverse=True)]

    def drain(self) -> list[tuple[float, int]]:
        """The best first; the heap is empty afterwards."""
        out = self.peek()
        self.clear()
        return out

    @property
    def min_score(self) -> float:
        """The least score that is kept; 0 if there is none."""
        return self._heap[0][0] if self._heap else 0.0

    @property
    def full(self) -> bool:
        return len(self._heap) >= self.capacity

    def __len__(self) -> int:
        return len(self._heap)

    def clear(self) -> None:
        self._heap.clear()
