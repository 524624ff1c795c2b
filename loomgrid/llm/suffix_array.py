"""Suffix arrays by grouping: Lyndon-prefix groups in descending order, then one emitting pass."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (integers); a suffix that is a prefix of another comes first.

    Suffixes are grouped by first symbol. Groups are taken from the highest down:
    each member's previous-smaller pointer names the nearest position to its left in a
    lower group, and positions that are pointed at leave their group for a new one right above it,
    those with more pointers higher. In the end a group holds the suffixes with one Lyndon
    prefix, and a single pass over the emerging order places each group's members. There is no renaming and no
    recursion.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.concatenate([np.unique(symbols, return_inverse=True)[1] + 1, [0]])
    n += 1
    first_order = np.argsort(text, kind="stable")
    counts = np.bincount(text)
    begin = np.cumsum(counts) - counts
    order: list[int] = first_order.tolist()
    place = np.empty(n, np.int64)
    place[first_order] = np.arange(n)
    at: list[int] = place.tolist()  # where a suffix stands in ``order``
    group: list[int] = begin[text].tolist()  # a group is named by where it begins; names follow the groups' order
    size = [0] * n
    for b, c in zip(begin.tolist(), counts.tolist(), strict=True):
        if c:
            size[b] = c
    prev = [-1] * n

    def leave(members: list[int]) -> None:
        """Members of one group go to its end and become the group right above it."""
        g = group[members[0]]
        z = size[g]
        new = g + z - len(members)
        if new == g:
            return
        end = g + z
        for s in members:
            end -= 1
            i = at[s]
            t = order[end]
            order[end], order[i] = s, t
            at[s], at[t] = end, i
        for s in members:
            group[s] = new
        size[g], size[new] = z - len(members), len(members)

    high = n
    while high > 1:
        low = group[order[high - 1]]
        if high - low == 1:
            s = order[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                g = group[p]
                z = size[g]
                if z > 1:  # a group of one stays as it is
                    new = g + z - 1
                    i, t = at[p], order[new]
                    order[new], order[i] = p, t
                    at[p], at[t] = new, i
                    group[p] = new
                    size[g], size[new] = z - 1, 1
        else:
            pointers: dict[int, int] = {}
            for s in sorted(order[low:high]):
                p = s - 1
                while p >= 0 and group[p] >= low:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            by: dict[tuple[int, int], list[int]] = {}
            for p, c in pointers.items():
                by.setdefault((-c, group[p]), []).append(p)
            for key in sorted(by):
                leave(by[key])
        high = low

    free = list(range(n))  # next place of the group that begins here
    done = [False] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return np.array(out[1:], np.int64)
