"""Suffix sorting by Lyndon groups, for many small texts at once (numpy).

Phase one keeps suffixes in groups of a common prefix and takes the groups in
descending order; every suffix of the group in hand finds, by its previous-smaller
pointer, the nearest earlier suffix of a lower group, whose prefix grows by the
group's (as often as the group's suffixes point to it) and which moves to a new group
right after its old one.  In the end a group's prefix is the Lyndon prefix of its
suffixes.  Phase two takes the groups in ascending order and emits each one's order
from the places of the suffixes that follow its Lyndon prefix: these are smaller, so
their places are known, and nothing is renamed or sorted recursively.

The texts are independent, so a step handles one group of every text.
"""

from __future__ import annotations

import numpy as np


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)


def suffix_ranks(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Place of every suffix among its text's suffixes, counted from the text's start.

    ``bounds`` are the texts' borders; each text ends with a symbol smaller than all its others.
    """
    n = len(text)
    base, end = bounds[:-1], bounds[1:].copy()
    owner = np.repeat(np.arange(len(base)), np.diff(bounds))
    group, length = np.empty(n, np.int64), np.ones(n, np.int64)
    size, ending = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    # members of the group that starts at s: those of log[at[s]:at[s]+held[s]] that have not left it
    at, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    log = np.empty(2 * n + 1, np.int64)
    order = np.lexsort((text, owner))
    new = np.concatenate(([True], (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1]))) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    group[order] = np.repeat(first, sizes)
    size[first], ending[first + sizes], at[first], held[first] = sizes, first, first, sizes
    log[:n], used = order, n
    before = np.arange(n) - 1
    before[base[base < n]] = -1
    done = np.zeros(n + 1, bool)
    while True:
        live = np.flatnonzero(end > base)
        if not len(live):
            break
        start = ending[end[live]]
        members = log[_spans(at[start], held[start])]
        members = members[group[members] == np.repeat(start, held[start])]
        done[members] = True
        p = before[members]
        far = np.flatnonzero(done[p])
        while len(far):
            p[far] = before[p[far]]
            far = far[done[p[far]]]
        before[members] = p
        has = p >= 0
        if has.any():
            grown, times = np.unique(p[has], return_counts=True)
            prefix = np.zeros(len(base), np.int64)
            prefix[owner[members]] = length[members]
            length[grown] += times * prefix[owner[grown]]
            old = group[grown]
            order = np.lexsort((times, old))
            grown, times, old = grown[order], times[order], old[order]
            lead = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1]))))
            count = np.diff(np.append(lead, len(grown)))
            parent = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            moved = np.diff(np.append(parent, len(grown)))
            was = old[parent]
            left = size[was] - moved
            # the k-th moved suffix of an old group goes to the group's tail, few repeats before many
            place = np.arange(len(grown)) + np.repeat(was + left - parent, moved)
            begin = place[lead]
            size[was] = left
            ending[(was + left)[left > 0]] = was[left > 0]
            group[grown] = np.repeat(begin, count)
            size[begin], ending[begin + count], at[begin], held[begin] = count, begin, used + lead, count
            if used + len(grown) > len(log):
                log = np.concatenate([log, np.empty(n + len(grown), np.int64)])
            log[used:used + len(grown)] = grown
            used += len(grown)
        end[live] = start
    # phase two
    rank = group.copy()
    many = np.flatnonzero(np.bincount(group, minlength=n) > 1) if n else np.zeros(0, int)
    if len(many):
        turn = np.arange(len(many)) - np.searchsorted(owner[many], owner[many])  # the how-manieth of its text
        by_group = np.argsort(group, kind="stable")
        sorted_groups = group[by_group]
        follow = np.arange(n) + length
        for t in range(int(turn.max()) + 1):
            now = many[turn == t]
            lo, hi = np.searchsorted(sorted_groups, now), np.searchsorted(sorted_groups, now, side="right")
            members = by_group[_spans(lo, hi - lo)]
            rest, hops = follow[members], np.zeros(len(members), np.int64)
            again = np.flatnonzero(group[rest] == group[members])
            while len(again):
                rest[again] = follow[rest[again]]
                hops[again] += 1
                again = again[group[rest[again]] == group[members[again]]]
            order = np.lexsort((rank[rest], hops, group[members]))
            rank[members[order]] = _spans(now, hi - lo)
    return rank
