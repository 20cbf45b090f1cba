"""Suffix arrays of many short strings at once, by linear grouping construction.

Phase one splits the suffixes into groups that share their Lyndon prefix: groups are taken in
descending order, the previous smaller suffix of each member is found along pointers that leap
over what is greater, and suffixes that members point to are moved, by how many do, to groups
right above their own. Phase two goes through the order from its start and puts each suffix whose
Lyndon prefix ends at the current one on the next place of its group; nothing is renamed and no
problem is solved twice.

Strings are independent, so step k of all of them is done together, as array operations.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def lyndon_groups(text: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: for each position the first place of its final group, and its previous smaller suffix (-1: none)."""
    n = len(text)
    owner = np.repeat(np.arange(len(base)), size)
    at = np.argsort(owner * 257 + text, kind="stable")  # place -> position
    key = (owner * 257 + text)[at]
    opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.empty(n, np.int64)  # position -> first place of its group
    group[at] = np.repeat(opens, np.diff(np.r_[opens, n]))
    place = np.empty(n, np.int64)  # position -> place
    place[at] = np.arange(n)
    stop = np.zeros(n + 1, np.int64)  # first place of a group -> place after its last
    stop[opens] = np.r_[opens[1:], n]
    before = np.full(n, -1, np.int64)
    chosen = np.zeros(n, bool)
    low, top = base.copy(), base + size
    while len(top):
        first = group[at[top - 1]]
        count = top - first
        if count.max() > 1:
            members = np.sort(at[_ranges(first, count)])
            mine, floor = np.repeat(first, count), np.repeat(low, count)
        else:
            members, mine, floor = at[first], first, low
        # Leap over greater suffixes; they have been dealt with and know what is smaller.
        p = members - 1
        look = np.flatnonzero(p >= floor)
        while len(look):
            look = look[group[p[look]] > mine[look]]
            p[look] = before[p[look]]
            look = look[p[look] >= floor[look]]
        inside = p >= floor
        same = inside.copy()
        same[inside] = group[p[inside]] == mine[inside]
        if same.any():  # a member right before: both point to what the first of the run points to
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(p))))
            p = p[head]
            inside = p >= floor
        p = np.where(inside, p, -1)
        before[members] = p
        p = p[inside]
        if len(p):
            edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            times = np.diff(np.r_[edge, len(p)])
            p = p[edge]
            g = group[p]
            if len(p) > 1:
                order = np.lexsort((times, g))
                p, g, times = p[order], g[order], times[order]
            fresh = np.r_[True, g[1:] != g[:-1]]
            parts = np.flatnonzero(fresh)
            many = np.diff(np.r_[parts, len(p)])
            owners = g[parts]
            tail = stop[owners] - many
            target = _ranges(tail, many)
            there, here = at[target], place[p]
            chosen[p] = True
            moved = there[~chosen[there]]
            free = here[here < np.repeat(tail, many)]
            chosen[p] = False
            # Members are in the order of their groups, and so are the vacated places.
            at[free] = moved
            place[moved] = free
            at[target] = p
            place[p] = target
            cuts = np.flatnonzero(fresh | np.r_[True, times[1:] != times[:-1]])
            length = np.diff(np.r_[cuts, len(p)])
            left = tail > owners
            stop[owners[left]] = tail[left]
            begin = target[cuts]
            stop[begin] = begin + length
            group[p] = np.repeat(begin, length)
        going = first > low
        low, top = low[going], first[going]
    return group, before


def suffix_arrays(text: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings that lie one after another: ``text[base[k]:base[k] + size[k]]``.

    Each string ends with its smallest character. Entries are positions in ``text``; the suffixes
    of string k fill the places ``base[k]`` to ``base[k] + size[k] - 1``.
    """
    n = len(text)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    group, before = lyndon_groups(text, base, size)
    free = np.arange(n)  # first place of a group -> its next free place
    done = np.zeros(n + 1, bool)
    order = np.argsort(-size, kind="stable")
    base, size = base[order], size[order]
    last = base + size - 1
    out[base] = last
    done[last] = True
    free[base] += 1
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # strings longer than k
    for k in range(int(size[0])):
        floor = base[:alive[k]]
        j = out[floor + k] - 1
        while len(j):
            ok = (j >= floor) & ~done[j]
            j, floor = j[ok], floor[ok]
            if not len(j):
                break
            g = group[j]
            spot = free[g]
            out[spot] = j
            free[g] = spot + 1
            done[j] = True
            j = before[j]
    return out
