"""Cuckoo filters over 128-bit keys: sets that answer "maybe" or "no", and from which members can be taken out again.

A filter is an array of buckets of four 16-bit fingerprints. A key may lie in two buckets, the second being the first one
turned by its fingerprint, so a fingerprint can move without its key. All operations work on arrays of distinct keys. Fingerprints
for which no cell is found after KICKS rounds go to a stash with their buckets, so that a member is never denied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLOTS = 4
#: Buckets of a filter, as a power of two: 131,072 cells, 256 kB. KEYS is a load of 0.76.
BITS = 15
KEYS = 100_000
KICKS = 200


def _first(lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, fingerprint) of keys, from their lower half (the upper one chose the shard); a fingerprint is never 0, a free cell."""
    u = lo.view(np.uint64)
    mark = (u & np.uint64(0xFFFF)).astype(np.uint16)
    return ((u >> np.uint64(16)) & np.uint64((1 << bits) - 1)).astype(np.int64), np.where(mark == 0, 1, mark).astype(np.uint16)


def _other(bucket: np.ndarray, mark: np.ndarray, bits: int) -> np.ndarray:
    """The other bucket of a fingerprint, from either of its two."""
    turn = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return bucket ^ np.maximum(turn, 1).astype(np.int64)


def _ranks(sorted_values: np.ndarray) -> np.ndarray:
    """The place of each value among its equals."""
    at = np.arange(len(sorted_values))
    starts = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]) if len(at) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(starts, at, 0))


@dataclass
class Cuckoo:
    """cells: uint16 (buckets, slots); stash: int64, fingerprints without a cell, each with the smaller of its buckets."""

    cells: np.ndarray
    stash: np.ndarray

    @classmethod
    def empty(cls, bits: int = BITS) -> Cuckoo:
        return cls(np.zeros((1 << bits, SLOTS), np.uint16), np.zeros(0, np.int64))

    @classmethod
    def read(cls, cells: bytes, stash: bytes) -> Cuckoo:
        return cls(np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.int64).copy())

    @property
    def bits(self) -> int:
        return len(self.cells).bit_length() - 1

    def _codes(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, _other(bucket, mark, self.bits)) << 16 | mark

    def holds(self, lo: np.ndarray) -> np.ndarray:
        """Whether each key may be a member; false only for keys that aren't."""
        bucket, mark = _first(lo, self.bits)
        both = (self.cells[bucket] == mark[:, None]) | (self.cells[_other(bucket, mark, self.bits)] == mark[:, None])
        return both.any(axis=1) | np.isin(self._codes(bucket, mark), self.stash)

    def add(self, lo: np.ndarray) -> None:
        """Takes in distinct keys that aren't members."""
        bucket, mark = _first(lo, self.bits)
        for turn in range(KICKS):
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            rank, full = _ranks(bucket), self.cells[bucket] != 0
            fits = rank < SLOTS - full.sum(axis=1)
            slot = np.argsort(full[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.cells[bucket[fits], slot] = mark[fits]
            bucket, mark = bucket[~fits], mark[~fits]
            if not len(bucket):
                return
            if turn:  # the first that waits at a full bucket takes a cell there, and what lay in it waits instead
                first = _ranks(bucket) == 0
                at, slot = bucket[first], turn % SLOTS
                mark[first], self.cells[at, slot] = self.cells[at, slot], mark[first]
            bucket = _other(bucket, mark, self.bits)
        self.stash = np.concatenate([self.stash, self._codes(bucket, mark)])

    def drop(self, lo: np.ndarray) -> None:
        """Takes out distinct keys that are members."""
        bucket, mark = _first(lo, self.bits)
        for _ in range(2):
            order = np.lexsort((mark, bucket))
            bucket, mark = bucket[order], mark[order]
            rank, match = _ranks(bucket << 16 | mark), self.cells[bucket] == mark[:, None]
            found = rank < match.sum(axis=1)
            slot = np.argsort(~match[found], axis=1, kind="stable")[np.arange(found.sum()), rank[found]]
            self.cells[bucket[found], slot] = 0
            bucket, mark = bucket[~found], mark[~found]
            bucket = _other(bucket, mark, self.bits)
        for code in self._codes(bucket, mark).tolist():
            at = np.flatnonzero(self.stash == code)
            if not len(at):
                raise KeyError("not a member")
            self.stash = np.delete(self.stash, at[0])
