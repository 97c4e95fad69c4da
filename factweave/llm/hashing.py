"""Hash tables and word hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.iinfo(np.uint64).max


class Table:
    """Fixed set of distinct 64-bit keys; find() gives each key's index. Open addressing, linear probing, at most half full."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _FREE, dtype=np.uint64)
        self.index = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.index[slot[left]] < 0
            at, first = np.unique(slot[left][free], return_index=True)
            chosen = left[free][first]
            self.keys[at], self.index[at] = keys[chosen], chosen
            left = left[~np.isin(left, chosen)]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        found = self.index[slot].astype(np.int64)
        left = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found[left] = self.index[slot[left]]
            left = left[(found[left] >= 0) & (self.keys[slot[left]] != keys[left])]
        return found


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise a 64-bit hash; different salts give independent hashes."""
    h = h + np.uint64((salt * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
