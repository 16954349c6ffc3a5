"""Lookup tables over NumPy arrays."""

from __future__ import annotations

import numpy as np


class Table:
    """64-bit numbers other than -1 to values, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.zeros(size, values.dtype), 1
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and where there is one."""
        at = self.slot(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.values[at], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (self.keys[at] != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            now = self.keys[at]
            same = now == keys[left]
            out[left[same]], hit[left[same]] = self.values[at[same]], True
            go = ~same & (now != -1)
            left, at = left[go], at[go]
        return out, hit
