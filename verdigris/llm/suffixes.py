"""Suffix arrays by linear grouping.

A suffix's group is known by the longest Lyndon word that starts it. Groups start as single symbols and
are taken in descending order. For every suffix of the group, the pointer to the previous smaller
suffix is found; the suffix it points to has the group's Lyndon word behind its own, once for each
pointer, so it moves behind the others of its group by that number. When all groups are done, the
order inside each is emitted in one sweep over the array itself, along the same pointers; nothing is
renamed and no subproblem is solved.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """The start places of all suffixes of text in lexicographic order (a prefix comes first)."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, np.uint8)
    order = np.argsort(data, kind="stable")
    sizes = np.bincount(data, minlength=256)
    starts = np.cumsum(sizes) - sizes
    group: list[int] = starts[data].tolist()  # a group is named by where it starts in the array
    members: dict[int, list[int]] = {int(a): order[a : a + c].tolist() for a, c in zip(starts, sizes) if c}
    size: dict[int, int] = {a: len(m) for a, m in members.items()}  # a list may still hold what has moved on
    start_before: dict[int, int] = {a + c: a for a, c in size.items()}
    previous = [-1] * n
    end = n
    while end:
        here = start_before[end]
        pointed: dict[int, int] = {}
        for s in sorted(s for s in members[here] if group[s] == here):
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_group: dict[int, dict[int, list[int]]] = {}
            for p, times in pointed.items():
                by_group.setdefault(group[p], {}).setdefault(times, []).append(p)
            for g, by_times in by_group.items():
                if len(by_times) == 1 and len(next(iter(by_times.values()))) == size[g]:
                    continue
                top = g + size[g]
                for times in sorted(by_times, reverse=True):
                    part = by_times[times]
                    at = top - len(part)
                    if at != g:
                        for p in part:
                            group[p] = at
                    members[at], size[at], start_before[top] = part, len(part), at
                    top = at
                if top > g:
                    size[g], start_before[top] = top - g, g
        end = here
    out, free, placed = [0] * n, {g: g for g in members}, bytearray(n)
    for i in range(-1, n):
        s = (n if i < 0 else out[i]) - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = previous[s]
    return out
