"""Suffix arrays by linear grouping.

First suffixes are grouped by their first symbol. Groups are then processed from the highest down: each
suffix of a group points to its nearest predecessor in a lower group, and the suffixes pointed at leave
their groups for new ones just above, those with more pointers higher. So each group ends up with the
suffixes that begin with the same Lyndon word. Then the order is emitted: from each suffix in order, the
chain of pointers before it fills the next free places of their groups. Nothing is renamed or recursed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``symbols`` (small non-negative integers); a suffix that is a prefix of another comes first."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)  # ends with the least symbol
    group, order, place = _first_groups(text)
    before = _lyndon_groups(group, order, place)
    return np.array(_emit(group, before)[1:], np.int64)


def _first_groups(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For each suffix the first place of its group; suffixes by place; places by suffix."""
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text)
    group = (np.cumsum(counts) - counts)[text]
    place = np.empty_like(order)
    place[order] = np.arange(len(text))
    return group.tolist(), order.tolist(), place.tolist()


def _lyndon_groups(group: list[int], order: list[int], place: list[int]) -> list[int]:
    """Refines ``group`` in place; returns each suffix's pointer to the nearest one before it in a lower group, or -1."""
    n = len(order)
    before = [-1] * n
    size = [0] * n
    for g in group:
        size[g] += 1
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        if len(members) == 1:
            i = members[0]
            p = i - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            before[i] = p
            if p >= 0:
                _lift([p], group, order, place, size)
            end = first
            continue
        members.sort()
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            if p >= 0 and group[p] == first:  # an equal neighbour, whose own pointer is known
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for p, c in counts.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                _lift(by_count[c], group, order, place, size)
        end = first
    return before


def _lift(some: list[int], group: list[int], order: list[int], place: list[int], size: list[int]) -> None:
    """Moves suffixes to the upper end of their groups, where they become groups of their own."""
    shrunk: dict[int, int] = {}
    for p in some:
        g = group[p]
        left = size[g] - 1
        size[g] = left
        shrunk[g] = shrunk.get(g, 0) + 1
        at, last = place[p], g + left
        other = order[last]
        order[last], order[at] = p, other
        place[p], place[other] = last, at
    starts = {g: g + size[g] for g in shrunk}
    for p in some:
        group[p] = starts[group[p]]
    for g, moved in shrunk.items():
        size[starts[g]] = moved


def _emit(group: list[int], before: list[int]) -> list[int]:
    n = len(group)
    out = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out
