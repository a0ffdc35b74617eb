"""Cuckoo filters in NumPy: sets of 128-bit keys as 16-bit fingerprints, with insertion and removal of many keys at once.

A key's fingerprint lies in one of two buckets of four slots; either bucket follows from the other and the fingerprint.
A key that was added is always found; another is found with a chance of about 8 / 65,535.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .bytewords import mix

SLOTS, LOAD, ROUNDS = 4, 0.85, 400


def halves(keys: pa.Array) -> np.ndarray:
    """(keys, 2) of uint64 from an Arrow column of 16-byte keys without nulls."""
    if not len(keys):
        return np.zeros((0, 2), np.uint64)
    fixed = keys.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], "<u8", 2 * len(fixed), 16 * fixed.offset).reshape(-1, 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its first half; a filter uses the second."""
    return (keys[:, 0] % np.uint64(shards)).astype(np.int64)


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        """An empty filter with room for ``keys`` keys."""
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, payload: bytes) -> Cuckoo:
        return cls(np.frombuffer(payload, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of distinct ``keys``, doubled until all have a place."""
        room = max(1, len(keys))
        while not (made := cls.of_size(room)).add(keys):
            room *= 2
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def room_for(self, more: int) -> bool:
        return len(self) + more <= LOAD * self.table.size

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        return np.maximum(prints, 1), (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._places(keys)
        return (self.table[at] == prints[:, None]).any(1) | (self.table[self._other(at, prints)] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Adds ``keys``, none of them in the filter yet; False if they find no place (the filter is then of no more use)."""
        prints, at = self._places(keys)
        dice = np.random.default_rng(len(keys))
        for turn in range(ROUNDS):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[at[fits], slot] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if turn % 2 and len(at):  # one key of each full bucket takes another's slot
                first = np.concatenate(([True], at[1:] != at[:-1]))
                slot = dice.integers(0, SLOTS, int(first.sum()))
                out = self.table[at[first], slot]
                self.table[at[first], slot] = prints[first]
                prints[first] = out
            at = self._other(at, prints)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint for each of ``keys``, which must be in the filter."""
        prints, at = self._places(keys)
        while len(prints):
            second = self._other(at, prints)
            here = np.concatenate([self.table[at], self.table[second]], axis=1) == prints[:, None]
            if not here.any(1).all():
                raise KeyError("a key to remove is not in the filter")
            place = here.argmax(1)
            bucket, slot = np.where(place < SLOTS, at, second), place % SLOTS
            _, mine = np.unique(bucket * SLOTS + slot, return_index=True)  # keys of equal fingerprint take turns
            self.table[bucket[mine], slot[mine]] = 0
            rest = np.ones(len(prints), bool)
            rest[mine] = False
            prints, at = prints[rest], at[rest]
