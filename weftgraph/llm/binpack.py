"""Bin packing of item counts by length: linear grouping, few-size configurations, best fit for small items.

All of it works on how many items there are of each length, never on items: with capacity C there are
at most C lengths, so this runs on the driver at any corpus size.

1. Large lengths are sorted downwards and cut into groups of equal cardinality; each group counts as
   its largest length.
2. Configurations of these few sizes are optimised by column generation: a simplex over the groups
   whose new columns come from a knapsack over the capacity.  Whole multiples are kept; what is left of
   the groups is grouped and optimised anew until it is a few items.
3. Real items take the slots, the longest first: the longest of the group, or one of a group above where
   what earlier slots of the bin left free makes room for it.
4. Small items go, longest first, to the bin that they fill best; that also fills what rounding left
   over.  The last few large items, which make no whole configuration, go the same way before them.
"""

from __future__ import annotations

import numpy as np

#: A plan: (lengths in a bin, how many such bins).
Plan = list[tuple[tuple[int, ...], int]]


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``capacity``: its value and how often it has each."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j, size in enumerate(sizes.tolist()):
        for a in range(size, capacity + 1, size):  # a block only looks at the one before
            b = min(a + size, capacity + 1)
            value = best[a - size : b - size] + worth[j]
            better = value > best[a:b] + 1e-12
            best[a:b][better], pick[a:b][better] = value[better], j
    column, c = np.zeros(len(sizes)), capacity
    while c > 0 and pick[c] >= 0:
        column[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return float(worth @ column), column


def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size in a bin, bins): whole parts of a solution of the configuration LP."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    x = need / np.diag(basis)
    for _ in range(rounds):
        value, column = _best_column(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)  # duals: every column costs one bin
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        theta = ratio[leave]
        x = np.maximum(x - theta * step, 0)
        x[leave] = theta
        basis[:, leave] = column
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    return [(basis[:, j].astype(int), int(x[j] + 1e-7)) for j in range(k) if x[j] >= 1 - 1e-7]


def _groups(lengths: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """(length, items), longest first, cut into k groups of equal cardinality; groups of one size are one."""
    total = sum(n for _, n in lengths)
    k = min(k, total)
    ends = [total * (i + 1) // k for i in range(k)]
    out: list[list[tuple[int, int]]] = [[] for _ in ends]
    seen, at = 0, 0
    for length, n in lengths:
        while n:
            take = min(n, ends[at] - seen)
            if take:
                out[at].append((length, take))
                n, seen = n - take, seen + take
            if seen == ends[at] and at + 1 < k:
                at += 1
    merged: list[list[tuple[int, int]]] = []
    for g in filter(None, out):
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] = merged[-1] + g
        else:
            merged.append(g)
    return merged


def _fill(left: np.ndarray, least: int, sizes: np.ndarray, configurations: list[tuple[np.ndarray, int]], capacity: int) -> Plan:
    """The bins of the configurations with real items; takes them out of ``left`` (items by length).

    A slot takes the longest item that fits besides the slots behind it: what rounding leaves free in one
    slot is room for the next.  Items are those of at least ``least``.
    """
    below = np.arange(capacity + 1)  # below[x]: where to look for the longest length up to x that has items

    def longest(x: int, used: dict[int, int]) -> int:
        path = []
        while x >= least and left[x] <= 0:
            path.append(x)
            x = int(below[x]) if below[x] < x else x - 1
        for p in path:
            below[p] = x
        while x >= least and left[x] <= used.get(x, 0):
            x -= 1
        return x if x >= least else 0

    out: Plan = []
    for column, bins in sorted(configurations, key=lambda c: tuple(-sizes[np.flatnonzero(c[0])])):
        slots_ = [int(sizes[j]) for j, m in enumerate(column) for _ in range(int(m))]
        while bins > 0:
            used: dict[int, int] = {}
            taken, room = [], capacity - sum(slots_)
            for size in slots_:
                x = longest(size + room, used)
                room += size - x
                if x:
                    taken.append(x)
                    used[x] = used.get(x, 0) + 1
            if not taken:
                break
            many = min(bins, *(int(left[x]) // m for x, m in used.items()))
            for x, m in used.items():
                left[x] -= m * many
            out.append((tuple(taken), many))
            bins -= many
    return out


def pack_counts(counts: dict[int, int], capacity: int, groups: int = 80, small: float = 1 / 4, rounds: int = 600, levels: int = 3) -> tuple[Plan, int]:
    """Bins as (lengths in a bin, how many such bins), each item of ``counts`` in just one, and how many
    large items configurations placed.

    Items of up to ``small`` of the capacity are small.
    """
    bad = [x for x, n in counts.items() if not 0 < x <= capacity or n < 0]
    if bad:
        raise ValueError(f"lengths must be 1 to {capacity}: {bad[:5]}")
    done: Plan = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    left = {x: n for x, n in counts.items() if n and x < capacity}
    placed = 0
    open_bins: dict[int, Plan] = {}

    def put(lengths: tuple[int, ...], bins: int) -> None:
        room = capacity - sum(lengths)
        (open_bins.setdefault(room, []) if room else done).append((lengths, bins))

    items, least = np.zeros(capacity + 1, np.int64), int(small * capacity) + 1
    items[list(left)] = list(left.values())
    for _ in range(levels):
        large = [(x, int(items[x])) for x in range(capacity - 1, least - 1, -1) if items[x]]
        if not large:
            break
        by = _groups(large, groups)
        sizes, need = np.array([g[0][0] for g in by]), np.array([float(sum(n for _, n in g)) for g in by])
        bins = _fill(items, least, sizes, _configurations(sizes, need, capacity, rounds), capacity)
        for lengths, n in bins:
            put(lengths, n)
            placed += len(lengths) * n
        if not bins:
            break
    left = {int(x): int(items[x]) for x in np.flatnonzero(items)}
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                lengths, bins = (), -(-n // (capacity // length))
                room = capacity
            else:
                lengths, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            each = room // length
            whole = min(bins, n // each)
            if whole:
                put(lengths + (length,) * each, whole)
                n, bins = n - whole * each, bins - whole
            if bins and n:
                put(lengths + (length,) * n, 1)
                n, bins = 0, bins - 1
            if bins and lengths:
                put(lengths, bins)
    return done + [b for room in sorted(open_bins) for b in open_bins[room]], placed


#: (groups, share of the capacity up to which items are small) that ``best_plan`` tries, until one reaches
#: the bound.  Where lengths are spread evenly, large items above a half do best.
CHOICES = ((80, 1 / 4), (320, 0.3), (320, 1 / 6), (80, 1 / 2))


def best_plan(counts: dict[int, int], capacity: int, choices: tuple[tuple[int, float], ...] = CHOICES) -> tuple[Plan, int]:
    """The plan with the fewest bins over several numbers of groups and limits of small items, and how many
    items its configurations placed; of equally good ones that which placed most."""
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    found: list[tuple[Plan, int]] = []
    for groups, small in choices:
        found.append(pack_counts(counts, capacity, groups, small))
        if sum(n for _, n in found[-1][0]) <= bound:
            break
    return min(found, key=lambda p: (sum(n for _, n in p[0]), -p[1]))


def slots(plan: Plan, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The plan as sorted keys ``length << 44 | first rank``, with the first bin and the offset in it.

    The items of a length are numbered from 0; one with number r lies in the entry with the largest
    first rank up to r, in that entry's first bin + (r - first rank).
    """
    used = np.zeros(capacity + 1, np.int64)
    keys, firsts, offsets, bin_ = [], [], [], 0
    for lengths, bins in plan:
        at = 0
        for x in lengths:
            keys.append((x << 44) | int(used[x]))
            firsts.append(bin_)
            offsets.append(at)
            used[x] += bins
            at += x
        bin_ += bins
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(firsts, np.int64)[order], np.array(offsets, np.int64)[order]
