"""Suffix arrays by linear grouping, with Lyndon-prefix groups.

Suffixes are grouped by their longest prefix that is a Lyndon word. Groups are
processed in descending order: each member hands its word to the previous smaller
suffix, found over pointers that skip what is larger, and those suffixes move to a
group right above their own; the more words in a row they got, the higher. A final
pass in ascending order emits each group's order: a suffix is smaller than another
of its group if the suffix right behind its word is. Nothing is renamed or recursed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int] | bytes | np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` in lexicographic order; a suffix comes before its extensions."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    first = np.asarray(np.frombuffer(text, np.uint8) if isinstance(text, bytes | bytearray) else text)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.append(starts[1:], n)
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(starts, ends - starts)
    group = group_of.tolist()  # a group's number is the place of its first suffix in the result
    listed = order.tolist()
    members = {s: set(listed[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)}
    start_at_end = dict(zip(ends.tolist(), starts.tolist(), strict=True))
    previous = [-1] * n
    length = [1] * n  # of each suffix's Lyndon prefix as far as it is known
    end = n
    while end:
        g = start_at_end[end]
        mine = members[g]
        end = g
        got: dict[int, int] = {}
        if len(mine) == 1:
            (i,) = mine
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                got[j] = 1
        else:
            mine = sorted(mine)
            for i in mine:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    got[j] = got.get(j, 0) + 1
        size = length[mine[0] if isinstance(mine, list) else i]
        if len(got) == 1:
            ((j, k),) = got.items()
            length[j] += k * size
            h = group[j]
            own = members[h]
            if len(own) > 1:
                own.discard(j)
                at = h + len(own)
                start_at_end[at + 1] = at
                start_at_end[at] = h
                members[at] = {j}
                group[j] = at
            continue
        moving: dict[int, dict[int, list[int]]] = {}
        for j, k in got.items():
            length[j] += k * size
            moving.setdefault(group[j], {}).setdefault(k, []).append(j)
        for h, by_count in moving.items():
            own = members[h]
            for js in by_count.values():
                own.difference_update(js)
            at = h + len(own)
            if own:
                start_at_end[at] = h
            for k in sorted(by_count):
                js = by_count[k]
                members[at] = set(js)
                for j in js:
                    group[j] = at
                start_at_end[at + len(js)] = at
                at += len(js)
    # emit: suffixes whose word ends where suffix i starts follow i's order
    out = [0] * n
    free = group
    place = {}
    for i in range(n):
        place[free[i]] = free[i]
    k = -1
    i = n
    while True:
        j = i - 1
        while j >= 0 and j + length[j] == i:
            g = free[j]
            at = place[g]
            out[at] = j
            place[g] = at + 1
            j = previous[j]
        k += 1
        if k == n:
            break
        i = out[k]
    return np.array(out, np.int64)
