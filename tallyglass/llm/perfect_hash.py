"""A minimal perfect hash over 64-bit keys with the values it indexes, as one compact binary."""

from __future__ import annotations

import numpy as np

# Positions per key on each level: wider levels place more keys at once but take more bits.
GAMMA = 2


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Spread the keys anew for each level (a 64-bit finaliser over key plus level)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0 .. n-1, by levels of bit arrays.

    On each level the keys that meet no other at their position stay there and mark it; the rest go on to the next
    level.  A key's number is the count of marks before its own.  Other keys get some number or -1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, total = levels, [], 0
        for marks in levels:
            ranks = np.cumsum(marks, dtype=np.int64)
            self.before.append(total + ranks - marks)
            total += int(ranks[-1]) if len(ranks) else 0
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels: list[np.ndarray] = []
        while len(keys):
            width = GAMMA * len(keys) + 1
            at = (_mixed(keys, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, marks in enumerate(self.levels):
            at = (_mixed(keys[open_], level) % np.uint64(len(marks))).astype(np.int64)
            hit = marks[at]
            found[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return found


def pack(high: np.ndarray, low: np.ndarray, counts: np.ndarray, first: np.ndarray) -> bytes:
    """Index ``high`` (distinct) and store ``low`` as fingerprints with ``counts`` and ``first``, in hash order."""
    index = PerfectHash.build(high)
    order = np.empty(len(high), np.int64)
    order[index.number(high)] = np.arange(len(high))
    widths = np.array([len(index.levels), *map(len, index.levels)], np.int64)
    parts = [widths.tobytes(), *(np.packbits(m).tobytes() for m in index.levels)]
    return b"".join([*parts, low[order].tobytes(), counts[order].astype(np.int64).tobytes(),
                     first[order].astype(np.int64).tobytes()])


def unpack(blob: bytes) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    n_levels = int(np.frombuffer(blob, np.int64, 1)[0])
    widths, at, levels = np.frombuffer(blob, np.int64, n_levels, 8), 8 * (n_levels + 1), []
    for width in widths.tolist():
        size = (width + 7) // 8
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=width).astype(bool))
        at += size
    index, arrays = PerfectHash(levels), []
    for kind in (np.uint64, np.int64, np.int64):
        arrays.append(np.frombuffer(blob, kind, index.size, at))
        at += 8 * index.size
    return index, *arrays
