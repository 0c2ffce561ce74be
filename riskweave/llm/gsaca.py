"""Suffix sorting by grouping, in linear time and without renaming (Baier's construction).

Phase 1 groups suffixes by their longest prefix that is a Lyndon word. Groups are processed from the
highest down. When a group is processed, each of its suffixes looks up the nearest earlier suffix of a
lower group by following previous-smaller pointers; the Lyndon prefix of that suffix grows by the group's
word, once for each suffix that points to it, so it moves to a new group right above its old one (more
copies, higher group). Phase 2 emits the order: scanning the sorted suffixes from the lowest, the chain of
previous-smaller pointers that ends before each suffix goes to the next free places of its groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (any integers) in ascending order."""
    n = len(symbols) + 1                           # with an end mark below all symbols
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(symbols, kind="stable")
    edges = np.flatnonzero(np.diff(symbols[order])) + 1
    start = [np.array([n - 1])] + np.split(order, edges)
    members: list[list[int]] = [x.tolist() for x in start]
    lower = list(range(-1, len(members) - 1))      # the next group below, and above
    upper = list(range(1, len(members))) + [-1]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    done = bytearray(n)
    previous = list(range(-1, n - 1))
    final: list[list[int]] = []
    here = len(members) - 1
    while here >= 0:
        own = [i for i in members[here] if group[i] == here]
        members[here] = own
        if not own:
            here = lower[here]
            continue
        for i in own:
            done[i] = 1
        follow: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                follow[p] = follow.get(p, 0) + 1
        if follow:
            grown: dict[tuple[int, int], list[int]] = {}
            for p, copies in follow.items():
                grown.setdefault((group[p], copies), []).append(p)
            for (old, _), moved in sorted(grown.items(), key=lambda x: -x[0][1]):
                new = len(members)                 # placed right above the old group; fewer copies come later, below
                members.append(moved)
                lower.append(old)
                upper.append(upper[old])
                if upper[old] >= 0:
                    lower[upper[old]] = new
                upper[old] = new
                for p in moved:
                    group[p] = new
        final.append(own)
        here = lower[here]
    rank = [0] * n                                 # of each suffix's group, as the place of its first member
    free: list[int] = []
    at = 0
    for g, own in enumerate(reversed(final)):
        free.append(at)
        at += len(own)
        for i in own:
            rank[i] = g
    out = [0] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free[rank[n - 1]] += 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = rank[i]
            out[free[g]] = i
            free[g] += 1
            i = previous[i]
    return np.array(out[1:], dtype=np.int64)
