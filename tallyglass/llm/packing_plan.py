"""How many sequences of which lengths: a packing of counts per length, whose size does not depend on the corpus."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within ``capacity`` (each size may repeat)."""
    value, last = np.zeros(capacity + 1), []
    for _ in range(int(capacity // sizes.min())):
        new, choice = value.copy(), np.full(capacity + 1, -1)
        for g, (size, gain) in enumerate(zip(sizes, worth)):
            if gain <= 0:
                continue
            candidate = value[: capacity + 1 - size] + gain
            better = candidate > new[size:] + 1e-12
            new[size:][better] = candidate[better]
            choice[size:][better] = g
        last.append(choice)
        if np.array_equal(new, value):
            break
        value = new
    pattern, at = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(last):
        if choice[at] >= 0:
            pattern[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return float(value[capacity]), pattern


def best_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that all demand is met by about the fewest sequences.

    The fractional problem over all configurations is solved by column generation; its solution is rounded down, and
    what is left (a few items per configuration) is packed first-fit by decreasing size.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, column = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        x, step = inverse @ demand, inverse @ column
        open_ = step > 1e-9
        if not open_.any():
            break
        ratio = np.where(open_, x / np.where(open_, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    patterns = [(np.rint(basis[:, j]).astype(np.int64), int(x[j])) for j in range(n) if x[j]]
    left = demand - sum((p * k for p, k in patterns), np.zeros(n, np.int64))
    left, rest = np.maximum(left, 0), []
    for g in np.argsort(-sizes):
        for _ in range(int(left[g])):
            for bin_ in rest:
                if bin_[1] >= sizes[g]:
                    break
            else:
                bin_ = [np.zeros(n, np.int64), capacity]
                rest.append(bin_)
            bin_[0][g] += 1
            bin_[1] -= int(sizes[g])
    return patterns + [(p, 1) for p, _ in rest]


@dataclass
class Plan:
    """Entries ``length, rank, sequences, each, sequence, offset``: the items of ``length`` from ``rank`` on fill
    ``sequences`` sequences from number ``sequence`` on, ``each`` of them in a row from ``offset`` on."""

    capacity: int
    sequences: int = 0
    entries: list[tuple] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)  # ranks given out, by length
    gaps: dict[int, list] = field(default_factory=dict)  # runs (first sequence, count) by space left
    order: list[int] = field(default_factory=list)  # the spaces in use, ascending

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def put(self, length: int, sequences: int, each: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.entries.append((length, rank, sequences, each, sequence, offset))
        self.used[length] = rank + sequences * each

    def leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.gaps.get(gap):
                bisect.insort(self.order, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((first, count))

    def take(self, least: int):
        """The run with the smallest space of at least ``least``; None if there is none."""
        at = bisect.bisect_left(self.order, least)
        if at == len(self.order):
            return None
        gap = self.order[at]
        run = self.gaps[gap].pop()
        if not self.gaps[gap]:
            self.order.pop(at)
        return gap, *run


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Cut items (length, count), longest first, into groups of equal cardinality."""
    total = sum(c for _, c in large)
    size, out, room = -(-total // groups), [[]], -(-total // groups)
    for length, count in large:
        while count:
            part = min(count, room)
            out[-1].append([length, part])
            count, room = count - part, room - part
            if not room:
                out.append([])
                room = size
    return [g for g in out if g]


def _substitute(plan: Plan, groups: list[list[list[int]]], pattern: np.ndarray, times: int) -> None:
    """Fill a configuration's places with actual items, runs of sequences with equal lengths at a time."""
    wanted = [(g, int(k)) for g, k in enumerate(pattern) if k]
    while times:
        live = [(g, k) for g, k in wanted if groups[g]]
        if not live:
            return
        run = min([times, *(groups[g][0][1] // k for g, k in live)])
        if run:
            first, offset = plan.open(run), 0
            for g, k in live:
                length = groups[g][0][0]
                plan.put(length, run, k, first, offset)
                offset += k * length
                groups[g][0][1] -= run * k
        else:  # a group's next items are of two lengths: one sequence, item by item
            run, first, offset = 1, plan.open(1), 0
            for g, k in live:
                for _ in range(k):
                    if not groups[g]:
                        break
                    length = groups[g][0][0]
                    plan.put(length, 1, 1, first, offset)
                    offset += length
                    groups[g][0][1] -= 1
                    if not groups[g][0][1]:
                        groups[g].pop(0)
        plan.leave(plan.capacity - offset, first, run)
        times -= run
        for g, _ in live:
            if groups[g] and not groups[g][0][1]:
                groups[g].pop(0)


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = 24, small: int = 8) -> Plan:
    """Pack ``counts`` items of each length (1 .. capacity) into sequences of ``capacity``.

    Linear grouping: items longer than ``capacity / small`` are cut, longest first, into ``groups`` groups of equal
    cardinality and counted at the group's largest length; the few sizes are packed by the best configurations, whose
    places then take the actual items.  The small items follow, longest first, each into the sequence with the least
    space that holds it, or a new one.  Runs of equal sequences are handled as one, so the work depends on the number of
    lengths and groups and not on the number of items.
    """
    plan = Plan(capacity)
    if counts.get(capacity):
        plan.put(capacity, counts[capacity], 1, plan.open(counts[capacity]), 0)
    bound = capacity // small
    large = sorted(((n, c) for n, c in counts.items() if bound < n < capacity and c), reverse=True)
    if large:
        grouped = _groups(large, groups)
        sizes = np.array([g[0][0] for g in grouped], np.int64)
        demand = np.array([sum(c for _, c in g) for g in grouped], np.int64)
        # Groups of one size are one size.
        distinct, where = np.unique(sizes, return_inverse=True)
        merged = [[part for g, w in zip(grouped, where) if w == i for part in g] for i in range(len(distinct))]
        total = np.bincount(where, weights=demand).astype(np.int64)
        for pattern, times in best_configurations(distinct, total, capacity):
            _substitute(plan, merged, pattern, times)
    for length in sorted((n for n, c in counts.items() if n <= bound and c), reverse=True):
        left = counts[length]
        while left:
            found = plan.take(length)
            if found is None:
                fresh = -(-left // (capacity // length))
                found = capacity, plan.open(fresh), fresh
            gap, first, count = found
            each = gap // length
            full = min(count, left // each)
            if full:
                plan.put(length, full, each, first, capacity - gap)
                plan.leave(gap - each * length, first, full)
                left -= full * each
            else:
                full = 1
                plan.put(length, 1, left, first, capacity - gap)
                plan.leave(gap - left * length, first, 1)
                left = 0
            plan.leave(gap, first + full, count - full)
    return plan
