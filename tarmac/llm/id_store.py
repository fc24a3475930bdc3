"""Token ids of words that a task has met, in flat arrays."""

from __future__ import annotations

import numpy as np

from tarmac.llm.arrays import expand


class IdStore:
    """Hash of a word to its token ids and a flag; forgets everything when it is full."""

    def __init__(self, most: int, kind: type = np.uint32):
        self.most, self.kind = most, kind
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.count = 0
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.lengths, self.flags = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)

    def unknown(self, keys: np.ndarray) -> list[int]:
        """Places of the hashes that have to be added."""
        if len(self.hashes) > self.most:
            self.forget()
        keys = np.asarray(keys, np.uint64)
        if len(self.hashes) == 0:
            return list(range(len(keys)))
        near = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[near] != keys).tolist()

    def add(self, hashes: np.ndarray | None, ids: np.ndarray, lengths: np.ndarray, flags: np.ndarray | None = None) -> None:
        """The ids of all words, one word after the other, and how many each has.

        Without hashes, the words have the places of those that another store adds.
        """
        n, m, more = self.count, len(lengths), len(ids)
        while n + m > len(self.starts):
            self.starts, self.lengths, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.flags))
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[n : n + m], self.lengths[n : n + m] = self.used + np.cumsum(lengths) - lengths, lengths
        self.flags[n : n + m] = False if flags is None else flags
        self.flat[self.used : self.used + more] = ids
        self.used += more
        self.count += m
        if hashes is not None:
            hashes = np.asarray(hashes, np.uint64)
            order = np.argsort(hashes)
            where = np.searchsorted(self.hashes, hashes[order])
            self.hashes = np.insert(self.hashes, where, hashes[order])
            self.at = np.insert(self.at, where, (n + order).astype(np.int32))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes that are all there."""
        return self.at[np.searchsorted(self.hashes, np.asarray(keys, np.uint64))].astype(np.int64)

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Ids of words at these places, one word after the other."""
        return self.flat[expand(self.starts[places], self.lengths[places])]
