"""Suffix sorting by grouping (linear construction), for many strings side by side.

Phase 1 sorts suffixes into groups by their Lyndon prefixes, groups in descending order: the highest group
not yet processed is final; each of its suffixes looks up the nearest suffix to its left in a lower group
(previous-smaller pointer, over pointers known already), and every suffix so pointed at by k of the group
gets the group's prefix appended k times, which moves it behind the rest of its own group, higher for more.
Phase 2 emits the suffix array in ascending order: a suffix that is emitted puts every suffix whose Lyndon
prefix ends just before it to the front of that suffix's group. Nothing is renamed or sorted recursively.

The strings take their steps together: step t handles the current group (phase 1) or the t-th suffix
(phase 2) of every string, as numpy vectors over all of them, so the cost for a symbol is constant.
"""

from __future__ import annotations

import numpy as np

from docquarry.llm.common import ragged


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings laid end to end, also laid end to end (places in ``symbols``).

    symbols: small non-negative integers; sizes: length of each string. The end of a string sorts lowest.
    """
    total, count = int(sizes.sum()), len(sizes)
    if not total:
        return np.zeros(0, np.int64)
    # Places of string b are base[b]+1 .. base[b]+sizes[b]; base[b] stands for "nothing to the left".
    base = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(count), sizes)
    place = ragged(base + 1, sizes).astype(np.int64)
    n = total + count + 1
    none = np.zeros(n, bool)
    none[base] = True

    key = owner.astype(np.int64) << 32 | symbols.astype(np.int64)
    order = np.argsort(key, kind="stable")
    sa = np.zeros(n, np.int64)
    at = np.full(n, -1, np.int64)
    sa[place] = place[order]
    at[place[order]] = place
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    group_size = np.diff(np.concatenate([first, [total]]))
    start = np.full(n, -1, np.int64)  # of the group of a suffix
    start[place[order]] = np.repeat(place[first], group_size)
    size = np.zeros(n, np.int64)  # by group start
    size[place[first]] = group_size

    left = np.arange(-1, n - 1, dtype=np.int64)
    length = np.ones(n, np.int64)  # of the Lyndon prefix as far as known
    flag = np.zeros(n, bool)
    high = base + sizes + 1
    live = np.flatnonzero(sizes > 0)
    low = base + 1
    while len(live):
        ends = high[live]
        begins = start[sa[ends - 1]]
        counts = ends - begins
        if counts.max() == 1:
            members, border, prefix = sa[begins], begins, length[sa[begins]]
        else:
            members = sa[ragged(begins, counts)]
            border = np.repeat(begins, counts)
            prefix = np.repeat(length[sa[begins]], counts)
        todo = np.arange(len(members))
        while len(todo):
            m = members[todo]
            p = left[m]
            again = at[p] >= border[todo]  # "nothing" stands at -1
            todo = todo[again]
            if len(todo):
                left[members[todo]] = left[p[again]]
        parents = left[members]
        inner = ~none[parents]
        parents, prefix = parents[inner], prefix[inner]
        high[live] = begins
        live = live[begins > low[live]]
        if not len(parents):
            continue
        if counts.max() > 1:
            sort = np.argsort(parents, kind="stable")
            parents, prefix = parents[sort], prefix[sort]
            head = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            times = np.diff(np.concatenate([head, [len(parents)]]))
            parents, prefix = parents[head], prefix[head]
        else:
            times = np.ones(len(parents), np.int64)
        length[parents] += times * prefix
        old = start[parents]
        sort = np.lexsort((times, old))
        parents, old, times = parents[sort], old[sort], times[sort]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        heads = np.flatnonzero(new_group)
        moved = np.diff(np.concatenate([heads, [len(parents)]]))
        groups = old[heads]
        tail = groups + size[groups] - moved  # the moved ones take the last places of their group
        targets = ragged(tail, moved).astype(np.int64)
        flag[parents] = True
        there = sa[targets]
        aside = there[~flag[there]]
        vacant = at[parents]
        vacant = vacant[vacant < np.repeat(tail, moved)]
        flag[parents] = False
        sa[vacant] = aside
        at[aside] = vacant
        sa[targets] = parents
        at[parents] = targets
        size[groups] -= moved
        runs = np.flatnonzero(new_group | np.concatenate([[True], times[1:] != times[:-1]]))
        run_size = np.diff(np.concatenate([runs, [len(parents)]]))
        start[parents] = np.repeat(targets[runs], run_size)
        size[targets[runs]] = run_size

    # Phase 2. Suffixes by the place where their Lyndon prefix ends.
    ends = place + length[place]
    by_end = place[np.argsort(ends, kind="stable")]
    child_count = np.bincount(ends, minlength=n + 1)
    child_at = np.cumsum(child_count) - child_count
    front = np.arange(n, dtype=np.int64)  # next free place by group start
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(sizes > 0)
    now = base[live] + sizes[live] + 1  # the end of each string, the lowest
    step = base[live].copy()
    while len(live):
        c = child_count[now]
        children = by_end[ragged(child_at[now], c)]
        g = start[children]
        out[front[g]] = children
        front[g] += 1
        step += 1
        keep = step <= base[live] + sizes[live]
        if not keep.all():
            live, step = live[keep], step[keep]
        now = out[step]
    return out[place] - 1 - owner_shift(owner)


def owner_shift(owner: np.ndarray) -> np.ndarray:
    """Places are counted with one more in front of every string; this takes them out again."""
    return owner
