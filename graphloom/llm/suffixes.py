"""Suffix sorting by linear grouping: Lyndon-prefix groups, then the order inside each group."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text`` (non-negative integers).

    Phase one handles groups of suffixes from the highest to the lowest; a group shares what is
    known of its Lyndon prefix. Each member finds the previous place of a lower group by the
    pointers found so far, and the places so pointed at move up within their own groups, further
    the more members point at them. At the end every group is the set of suffixes with one Lyndon
    prefix. Phase two goes through the order once and gives each group its members in turn; no
    symbol is renamed and nothing recurs.
    """
    n = len(text)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        buckets.setdefault(c, []).append(i)
    order, group, size = [0] * n, [0] * n, {}  # a group is named by its first slot
    at = 0
    for c in sorted(buckets):
        members = buckets[c]
        size[at] = len(members)
        for k, i in enumerate(members):
            order[at + k] = i
            group[i] = at
        at += len(members)
    slot = [0] * n
    for k, i in enumerate(order):
        slot[i] = k
    previous = [-1] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[first:end]):
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            levels: dict[int, list[int]] = {}
            for j, k in pointed.items():
                levels.setdefault(k, []).append(j)
            for k in sorted(levels, reverse=True):  # those pointed at most often become the highest
                by_group: dict[int, list[int]] = {}
                for j in levels[k]:
                    by_group.setdefault(group[j], []).append(j)
                for g, moved in by_group.items():
                    rest = size[g] - len(moved)
                    if not rest:
                        continue
                    top = g + size[g]
                    for j in moved:  # swap to the end of the group's slots
                        top -= 1
                        a, other = slot[j], order[top]
                        order[a], order[top] = other, j
                        slot[other], slot[j] = a, top
                    size[g], size[top] = rest, len(moved)
                    for j in moved:
                        group[j] = top
        end = first
    free = dict.fromkeys(size)
    for g in free:
        free[g] = g
    result, done = [-1] * n, [False] * n
    j = n - 1  # the empty suffix comes first: place what precedes it
    k = -1
    while True:
        while j >= 0 and not done[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            done[j] = True
            j = previous[j]
        k += 1
        if k >= n:
            return result
        j = result[k] - 1
