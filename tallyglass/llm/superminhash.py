"""SuperMinHash signatures (Ertl, 2017) of many sets at a time.

Every element ranks all slots by a random permutation of its own and adds a random fraction to each rank; a slot keeps the
smallest value.  The ranks of one element are correlated across slots, which lowers the variance of the share of equal
slots, most of all for small sets.  The work goes rank by rank over all elements together and stops early: once every
slot of a set holds a rank below the next one, no element can lower any.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Elements whose permutations are held at a time: a byte per element and slot.
BLOCK = 1 << 15
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# The increment and the two factors of the SplitMix64 generator.
GOLDEN, MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LOW = np.uint64(0xFFFFFFFF)


def _random(elements: np.ndarray, turn: int) -> np.ndarray:
    """The ``turn``-th 64 random bits of each element."""
    z = elements + np.uint64(GOLDEN * (turn + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * MIX[0]
    z = (z ^ (z >> np.uint64(27))) * MIX[1]
    return z ^ (z >> np.uint64(31))


def _lower(slots: np.ndarray, elements: np.ndarray, owners: np.ndarray) -> None:
    """Let a block of elements lower the slots of the sets they belong to."""
    m = slots.shape[1]
    flat = slots.reshape(-1)
    places = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    rows = np.arange(len(elements))
    open_sets = np.unique(owners)
    for rank in range(m):
        # Early stopping: sets whose largest slot is below this rank are done.
        still = (slots[open_sets].max(axis=1) >> np.uint64(32)) >= rank
        if not still.all():
            going = np.zeros(len(slots), bool)
            open_sets = open_sets[still]
            going[open_sets] = True
            kept = going[owners]
            elements, owners, rows = elements[kept], owners[kept], rows[kept]
        if not len(elements):
            return
        bits = _random(elements, rank)
        # The next place of a Fisher-Yates shuffle: the slot that this element gives this rank.
        pick = rank + (((bits >> np.uint64(32)) * np.uint64(m - rank)) >> np.uint64(32)).astype(np.int64)
        slot = places[rows, pick]
        places[rows, pick] = places[rows, rank]
        np.minimum.at(flat, owners * m + slot, (bits & LOW) | np.uint64(rank << 32))


def signatures(sets: list[np.ndarray], slots: int = 256) -> np.ndarray:
    """One row of ``slots`` (at most 256) values per set of distinct 64-bit hashes; an empty set keeps ``EMPTY``."""
    found = np.full((len(sets), slots), EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    if sizes.sum():
        elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        for at in range(0, len(elements), BLOCK):
            _lower(found, elements[at:at + BLOCK], owners[at:at + BLOCK])
    return found


def band_keys(signature: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """One signed key per band of ``depth`` consecutive slots."""
    part = np.ascontiguousarray(signature[: bands * depth]).reshape(bands, depth)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(part)], np.uint64).view(np.int64)


def codes(signature: np.ndarray) -> np.ndarray:
    """A byte per slot: equal slots have equal bytes, others one time in 256."""
    return (signature & np.uint64(0xFF)).astype(np.uint8)
