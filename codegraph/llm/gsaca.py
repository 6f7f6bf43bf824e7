"""Linear suffix sorting by grouping (no recursion, no renaming).

Phase one refines groups of suffixes from the highest to the lowest until each group's
suffixes share their longest Lyndon prefix: the members of the current group point to the
nearest earlier suffix of a lower group, and suffixes pointed to move to the back of their
groups, those pointed to more often further back. Phase two emits each group's order: as
suffixes come out in ascending order, the suffixes whose Lyndon prefix ends there take the
next free place of their group, found along the same pointers.

All but the members and pointers of the group at hand is kept in flat arrays of numbers.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of symbols in ascending order."""
    n = len(symbols)
    if not n:
        return []
    kind = "i" if n < 1 << 31 else "q"
    dtype = np.dtype(kind)
    # The members of a group stand together in `at`, from its first place on; `rank` is a suffix's place there.
    values = np.asarray(symbols)
    order = np.argsort(values, kind="stable").astype(dtype)
    heads = np.flatnonzero(np.append(True, np.diff(values[order]) != 0)).astype(dtype)
    sizes = np.diff(np.append(heads, n)).astype(dtype)
    by_place = np.empty(n, dtype)
    by_place[order] = np.arange(n, dtype=dtype)
    at, rank = array(kind, order.tobytes()), array(kind, by_place.tobytes())
    by_place[order] = np.repeat(heads, sizes)
    group = array(kind, by_place.tobytes())
    by_place[:] = 0
    by_place[heads] = sizes
    size = array(kind, by_place.tobytes())
    del values, order, heads, sizes, by_place
    before = array(kind, [-1]) * n
    end = n
    while end:
        first = group[at[end - 1]]
        count: dict[int, int] = {}
        for i in at[first:end] if end - first == 1 else sorted(at[first:end]):
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        end = first
        if not count:
            continue
        # Split the lower groups that hold suffixes pointed to, most often first to the back.
        hit: dict[int, list[int]] = {}
        for j in count:
            hit.setdefault(group[j], []).append(j)
        for g, moved in hit.items():
            whole = size[g]
            if whole == 1:
                continue
            times: dict[int, list[int]] = {}
            for j in moved:
                times.setdefault(count[j], []).append(j)
            for k in sorted(times, reverse=True):
                part = times[k]
                if len(part) == whole:
                    break
                place = whole = whole - len(part)
                place += g
                last = place + len(part)
                for j in part:
                    last -= 1
                    other, own = at[last], rank[j]
                    at[last], at[own] = j, other
                    rank[j], rank[other] = last, own
                    group[j] = place
                size[place] = len(part)
            size[g] = whole
    # `at` and `rank` have served: they take the result, and each group's next free place.
    out, free = at, rank
    free[:] = array(kind, range(n))
    placed = bytearray(n)
    for i in range(-1, n):
        s = (n if i < 0 else out[i]) - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    del at, rank, free, group, size, before, placed
    return out.tolist()


def common_prefixes(symbols: Sequence[int], order: Sequence[int]) -> list[int]:
    """Longest common prefix of each suffix in order with the one before it (0 for the first)."""
    n, rank = len(symbols), [0] * len(symbols)
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(h - 1, 0)
    return out
