"""Suffix sorting by linear grouping.

First, suffixes are grouped by their longest Lyndon prefix. Groups are processed
from the highest down; each suffix of a group points to the nearest position on
its left that no processed group holds (its previous smaller suffix), and that
position's prefix grows by the group's. Positions that grow alike split off
their group into one just above it. Then the order inside the groups follows from
the lowest suffix up: the suffixes whose Lyndon prefix ends where a placed suffix
begins take the next places of their groups. No ranks are renamed and nothing
recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def _groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of equal longest Lyndon prefix, highest first, and each position's previous smaller one (-1: none)."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    held = [first[c] for c in sorted(first)]
    below = list(range(-1, len(held) - 1))
    above = [*range(1, len(held)), -1]
    group_of = [0] * n
    for g, members in enumerate(held):
        for i in members:
            group_of[i] = g
    open_ = list(range(n))  # open_[i]: where the search for an open position at or left of i goes on; i itself if open
    smaller = [-1] * n
    out = []
    at = len(held) - 1
    while at >= 0:
        members = [i for i in held[at] if group_of[i] == at]
        if members:
            out.append(members)
            for i in members:
                open_[i] = i - 1
            grown: dict[int, int] = {}
            for i in members:
                p = i - 1
                while p >= 0 and open_[p] != p:
                    p = open_[p]
                q = i
                while q > p:  # shorten the way for later searches
                    open_[q], q = p, open_[q]
                smaller[i] = p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + 1
            split: dict[int, dict[int, list[int]]] = {}
            for p, times in grown.items():
                split.setdefault(group_of[p], {}).setdefault(times, []).append(p)
            for low, parts in split.items():
                for times in sorted(parts):
                    new, high = len(held), above[low]
                    held.append(parts[times])
                    below.append(low)
                    above.append(high)
                    above[low] = below[high] = new
                    for p in parts[times]:
                        group_of[p] = new
                    low = new
        at = below[at]
    return out, smaller


def suffix_order(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a suffix comes before those it begins."""
    n = len(text)
    groups, smaller = _groups(text)
    groups.reverse()
    front, group_of, begin = [], [0] * n, 0
    for g, members in enumerate(groups):
        front.append(begin)
        begin += len(members)
        for i in members:
            group_of[i] = g
    order, placed = [-1] * n, [False] * n
    start = n  # the empty suffix, lower than all
    for k in range(-1, n):
        if k >= 0:
            start = order[k]
        p = start - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            order[front[group_of[p]]] = p
            front[group_of[p]] += 1
            p = smaller[p]
    return order
