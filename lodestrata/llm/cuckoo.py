"""A cuckoo filter over 64-bit key hashes: approximate membership with deletion."""

from __future__ import annotations

import numpy as np

from .textblock import mix64

SLOTS = 4
_MAX_KICKS = 500


class FilterFull(Exception):
    """The keys do not fit; build a larger filter from the exact table."""


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key's two buckets follow from either and its fingerprint.

    No key that is inside is ever missed. Others pass with a probability of about 8 / 2**16. Only keys that are
    inside may be deleted, which the exact table behind the filter makes sure of.
    """

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS of uint16, 0: free

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (0.75 * SLOTS)))) if n else 2)
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, dtype="<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int((self.table != 0).sum())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = mix64(keys.astype(np.uint64, copy=False))
        mask = np.uint64(len(self.table) - 1)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys & mask
        return prints, first.astype(np.int64), self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return ((bucket.astype(np.uint64) ^ mix64(prints.astype(np.uint64))) & mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        prints, first, second = self._places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Insert keys that are not inside. FilterFull leaves the filter unusable."""
        prints, first, second = self._places(keys)
        waiting = np.arange(len(keys))
        for place in (first, second):
            for _ in range(SLOTS):  # one key per bucket in a round
                if not len(waiting):
                    return
                _, chosen = np.unique(place[waiting], return_index=True)
                chosen = waiting[chosen]
                free = self.table[place[chosen]] == 0
                chosen, slot = chosen[free.any(axis=1)], free.argmax(axis=1)[free.any(axis=1)]
                self.table[place[chosen], slot] = prints[chosen]
                waiting = np.setdiff1d(waiting, chosen, assume_unique=True)
        for i in waiting:
            self._kick(int(first[i]), int(prints[i]))

    def _kick(self, bucket: int, print_: int) -> None:
        for n in range(_MAX_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = print_
                return
            slot = (n * 2654435761 >> 7) % SLOTS
            print_, row[slot] = int(row[slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], dtype=np.uint16))[0])
        raise FilterFull

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys that are inside."""
        for print_, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[bucket] == print_)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break
            else:
                raise KeyError("a key to delete is not in the filter")
