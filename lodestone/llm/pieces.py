"""Id sequences of text pieces, learned once per worker and looked up by hash."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

_I = np.int64


class PieceCache:
    """Sorted 64-bit keys with the ids of each. Forgets all when it holds ``most`` pieces."""

    def __init__(self, most: int):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys, self._slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self._from, self._many = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)
        self._ids, self._used = np.zeros(1 << 16, dtype=np.uint32), 0

    def lookup(self, keys: np.ndarray, learn: Callable[[np.ndarray], Sequence[Sequence[int]]]) -> np.ndarray:
        """Slots of distinct ascending keys; ``learn`` gives the ids at some of their indices."""
        spot, known = self._find(keys)
        if len(self.keys) + int((~known).sum()) > self.most:
            self._forget()
            spot, known = self._find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            lists = learn(new)
            many = np.fromiter(map(len, lists), dtype=_I, count=len(new))
            total, first = int(many.sum()), len(self.keys)
            self._from, self._many = (self._grown(x, first + len(new)) for x in (self._from, self._many))
            self._ids = self._grown(self._ids, self._used + total)
            self._ids[self._used : self._used + total] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=total)
            self._from[first : first + len(new)] = self._used + np.cumsum(many) - many
            self._many[first : first + len(new)] = many
            self._used += total
            self.keys = np.insert(self.keys, spot[new], keys[new])
            self._slot = np.insert(self._slot, spot[new], np.arange(first, first + len(new), dtype=np.int32))
            spot, _ = self._find(keys)
        return self._slot[spot]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return spot, np.zeros(len(keys), dtype=bool)
        return spot, self.keys[np.minimum(spot, len(self.keys) - 1)] == keys

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        if n <= len(x):
            return x
        out = np.zeros(max(n, len(x) + len(x) // 2), dtype=x.dtype)
        out[: len(x)] = x
        return out

    def spans(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each slot begin in the cache, and how many there are."""
        return self._from[slots].astype(_I), self._many[slots].astype(_I)

    def gather(self, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans in a row, and where each span begins among them."""
        before = np.cumsum(many) - many
        return self._ids[np.repeat(start - before, many) + np.arange(int(many.sum()))], before
