"""Links between 64-bit values at few differing bits, by walking a binary trie against itself."""

from __future__ import annotations

import numpy as np

BITS = 64
# Node pairs that are split at a time; further ones wait, so memory does not grow with the number of pairs.
FRONTIER = 1 << 18


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable over the links ``a - b`` and what ``labels`` joins already."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        # Hook the roots, then halve all paths until every node points at its root.
        np.minimum.at(labels, before[a], low)
        np.minimum.at(labels, before[b], low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


class Trie:
    """A binary trie over sorted distinct values; a node at some depth is the range of values below it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._ones: dict[int, np.ndarray] = {}

    def middle(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where each node's second child begins."""
        ones = self._ones.get(depth)
        if ones is None:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones = self._ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return high - (ones[high] - ones[low])


def join_tries(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, most: int, early: int,
               half: int = BITS // 2) -> np.ndarray:
    """A label per value of ``a`` then ``b``: values with one label are linked by chains of near pairs.

    ``a`` and ``b`` are sorted, distinct, and the values of each share their first ``depth`` bits, in which the two
    sides differ at ``errors`` places; ``b`` is None for the pairs inside ``a``.  Node pairs are walked together from
    there on.  A pair is dropped once its nodes differ in more than ``early`` of the first ``half`` bits or more than
    ``most`` of all; two single values are compared at once.  Where even all bits left could not exceed the budget,
    the whole nodes are joined without listing pairs.
    """
    left = Trie(a)
    right = left if b is None else Trie(b)
    shift = 0 if b is None else len(a)
    n = len(a) + (0 if b is None else len(b))
    labels = np.arange(n)
    start = np.array([[0, len(a), 0, len(right.values), errors]], np.int64)
    stack = [(depth, start)] if len(a) and len(right.values) else []
    while stack:
        at, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack.append((at, pairs[FRONTIER:]))
            pairs = pairs[:FRONTIER]
        al, ah, bl, bh, err = pairs.T
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = popcount(a[i] ^ right.values[j]) <= most
            labels = smallest_labels(n, i[near], j[near] + shift, labels)
            pairs = pairs[~single]
        # All values below both nodes are near each other: chain them up.
        rest = BITS - at
        all_near = pairs[:, 4] + rest <= most if at >= half else np.zeros(len(pairs), bool)
        for al, ah, bl, bh, _ in pairs[all_near]:
            members = np.concatenate((np.arange(al, ah), np.arange(bl, bh) + shift))
            labels = smallest_labels(n, members[:-1], members[1:], labels)
        pairs = pairs[~all_near]
        if not len(pairs) or at >= BITS:
            continue
        al, ah, bl, bh, err = pairs.T
        am, bm = left.middle(at, al, ah), right.middle(at, bl, bh)
        budget = early if at + 1 <= half else most
        same = (al == bl) & (ah == bh) if b is None else np.zeros(len(pairs), bool)
        children = [
            np.stack((al, am, bl, bm, err), 1), np.stack((am, ah, bm, bh, err), 1),
            np.stack((al, am, bm, bh, err + 1), 1), np.stack((am, ah, bl, bm, err + 1), 1)[~same],
        ]
        below = np.concatenate(children)
        kept = (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2]) & (below[:, 4] <= budget)
        if b is None:  # a node against itself holds no pair once it is a single value
            kept &= ~((below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] == 1) & (below[:, 3] - below[:, 2] == 1))
        if kept.any():
            stack.append((at + 1, below[kept]))
    return labels
