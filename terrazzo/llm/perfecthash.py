"""A minimal perfect hash over distinct 64-bit keys, built level by level with NumPy."""

from __future__ import annotations

import numpy as np

from .scan import mix

_U = np.uint64


class PerfectHash:
    """Maps n distinct keys one to one onto 0..n-1 in about three bits a key.

    Every level hashes the keys that are left into gamma slots a key; keys alone in their slot stay
    there, the others go on. A key's value is the rank of its slot. Keys of no level (after
    `levels`, practically none) are held sorted behind the ranks.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 1.5, levels: int = 24):
        self.n = len(keys)
        self.bits: list[np.ndarray] = []
        self.base: list[np.ndarray] = []
        rest, placed = keys.astype(_U), 0
        while len(rest) and len(self.bits) < levels:
            slots = max(8, -(-int(len(rest) * gamma) // 8) * 8)
            at = self._slot(rest, len(self.bits), slots)
            alone = np.bincount(at, minlength=slots) == 1
            packed = np.packbits(alone)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.base.append((placed + np.cumsum(ones) - ones).astype(np.int64 if self.n >= 2**31 else np.int32))
            placed += int(ones.sum())
            rest = rest[~alone[at]]
        self.placed = placed
        self.rest = np.sort(rest)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        h = mix(keys ^ _U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        return (((h >> _U(32)) * _U(slots)) >> _U(32)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys. A key outside the set gets any slot or -1; a fingerprint tells them apart."""
        keys = keys.astype(_U)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, packed in enumerate(self.bits):
            if not len(left):
                return out
            at = self._slot(keys[left], level, 8 * len(packed))
            byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
            hit = (packed[byte] >> bit) & 1 == 1
            before = np.bitwise_count((packed[byte[hit]].astype(np.uint16) >> (bit[hit] + np.uint16(1))).astype(np.uint8))
            out[left[hit]] = self.base[level][byte[hit]] + before
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            found = self.rest[at] == keys[left]
            out[left[found]] = self.placed + at[found]
        return out
