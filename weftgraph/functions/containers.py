"""Driver-side containers with the contracts of the priority queue and the integer multimap.

They hold what fits a driver: sequential algorithms on one component use them.  Relations use joins.
"""

from __future__ import annotations

import heapq
from collections import defaultdict


class MaxQueue:
    """A max-priority queue of distinct values with changeable keys."""

    def __init__(self) -> None:
        self._heap: list[tuple[float, int, int]] = []
        self._now: dict[int, tuple[float, int]] = {}
        self._n = 0

    def __len__(self) -> int:
        return len(self._now)

    def insert(self, value: int, key: float) -> None:
        if value in self._now:
            raise KeyError(f"{value} is in the queue")
        self._push(value, key)

    def update(self, value: int, key: float) -> None:
        if value not in self._now:
            raise KeyError(value)
        self._push(value, key)

    def delete(self, value: int) -> None:
        del self._now[value]

    def top(self) -> int:
        """Takes out the value of the largest key, the earlier of equals; -1 when empty."""
        value = self.see_top()
        if value != -1:
            heapq.heappop(self._heap)
            del self._now[value]
        return value

    def see_top(self) -> int:
        while self._heap and self._now.get(self._heap[0][2]) != (-self._heap[0][0], self._heap[0][1]):
            heapq.heappop(self._heap)
        return self._heap[0][2] if self._heap else -1

    def see_key(self, value: int) -> float:
        return self._now[value][0]

    def reset(self) -> None:
        self._heap.clear()
        self._now.clear()

    def _push(self, value: int, key: float) -> None:
        self._n += 1
        self._now[value] = (key, self._n)
        heapq.heappush(self._heap, (-key, self._n, value))


class MultiMap:
    """int -> int multimap: insert never replaces."""

    def __init__(self) -> None:
        self._d: dict[int, list[int]] = defaultdict(list)

    def insert(self, key: int, value: int) -> None:
        self._d[key].append(value)

    def search(self, key: int) -> int:
        """The first value, -1 if there is none."""
        return self._d[key][0] if self._d.get(key) else -1

    def values(self, key: int) -> list[int]:
        return list(self._d.get(key, ()))

    def delete(self, key: int) -> None:
        """Takes out the first value."""
        if self._d.get(key):
            self._d[key].pop(0)

    def search_and_delete(self, key: int) -> int:
        found = self.search(key)
        self.delete(key)
        return found

    def reset(self) -> None:
        self._d.clear()
