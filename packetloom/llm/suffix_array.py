"""Suffix arrays by linear grouping.

First the suffixes are grouped by their longest Lyndon prefix.  They start in groups by first symbol; groups
are visited in descending order, and every suffix of the visited group finds the previous suffix in a smaller
group by following the pointers of those in between.  That one's prefix grows by the group's prefix, once
per suffix that points to it, so it moves into a new group right above its own.  When all groups have been
visited, a suffix is its group's prefix followed by its next smaller suffix.  Then the order is emitted from
the smallest suffix on: each emitted suffix hands the next free place of their groups to the suffixes it is
the next smaller one of, which are again found by the pointers.  Nothing is renamed and no reduced text is
built; every suffix is moved once per pointer and placed once.
"""

from __future__ import annotations

import numpy as np


def _grouped(text: list[int]) -> tuple[list[int], list[int]]:
    """The group of each suffix (the place where the group starts) and its previous smaller suffix."""
    n = len(text)
    symbols = np.array(text)
    by_symbol = np.argsort(symbols, kind="stable")
    changes = np.flatnonzero(np.diff(symbols[by_symbol], prepend=-1))
    starts = np.zeros(n, np.int64)
    starts[by_symbol] = np.repeat(changes, np.diff(np.r_[changes, n]))
    order, group = by_symbol.tolist(), starts.tolist()
    place = np.argsort(by_symbol).tolist()
    end = [0] * n
    for low, high in zip(changes.tolist(), np.r_[changes[1:], n].tolist()):
        end[low] = high
    previous = [-1] * n
    high = n
    while high:
        here = group[order[high - 1]]
        if here == high - 1:
            at = order[here]
            before = at - 1
            while before >= 0 and group[before] >= here:
                before = previous[before]
            previous[at] = before
            if before >= 0:
                home = group[before]
                last = end[home] - 1
                if home != last:
                    other, spot = order[last], place[before]
                    order[spot], place[other] = other, spot
                    order[last], place[before] = before, last
                    group[before] = last
                    end[last], end[home] = last + 1, last
        else:
            pointed: dict[int, int] = {}
            for at in sorted(order[here:high]):
                before = at - 1
                while before >= 0 and group[before] >= here:
                    before = previous[before]
                previous[at] = before
                if before >= 0:
                    pointed[before] = pointed.get(before, 0) + 1
            # Those pointed to more often are larger; they go to the top of their group first.
            moves: dict[tuple[int, int], list[int]] = {}
            for before, times in pointed.items():
                moves.setdefault((group[before], times), []).append(before)
            for home, times in sorted(moves, reverse=True):
                moved = moves[home, times]
                top = last = end[home]
                for before in moved:
                    last -= 1
                    other, spot = order[last], place[before]
                    order[spot], place[other] = other, spot
                    order[last], place[before] = before, last
                for before in moved:
                    group[before] = last
                end[home] = last
                end[last] = top
        high = here
    return group, previous


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; the last symbol must be the only smallest one (and not negative)."""
    n = len(text)
    if not n:
        return []
    group, previous = _grouped(text)
    free = list(range(n))
    placed = [False] * n
    result = [0] * n
    result[0], placed[n - 1] = n - 1, True
    for spot in range(n):
        before = result[spot] - 1
        while before >= 0 and not placed[before]:
            home = group[before]
            result[free[home]] = before
            free[home] += 1
            placed[before] = True
            before = previous[before]
    return result
