"""Suffix arrays of integer texts in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of a text, by its first ``depth`` symbols at least.

    Larsson-Sadakane refinement: suffixes are sorted by one symbol, and then, for h = 1, 2, 4, ...,
    each group that is not sorted out yet is sorted by the ranks h symbols further on. A rank is
    the place of the group's last suffix, so refining one group leaves all others as they are.
    Suffixes that agree in all compared symbols share a rank. The end of the text sorts first.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    slots = _rank_groups(sa, text[sa], np.arange(n), rank)
    h = 1
    while h < depth and len(slots):
        at = sa[slots]
        ahead = at + h
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key += rank[at] * (n + 1)
        order = np.argsort(key, kind="stable")
        sa[slots] = at[order]
        slots = _rank_groups(sa, key[order], slots, rank)
        h *= 2
    return sa, rank


def _rank_groups(sa: np.ndarray, keys: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Give each run of equal keys its last slot as rank; the slots of runs of two or more."""
    ends = np.append(keys[1:] != keys[:-1], True)
    last = np.flatnonzero(ends)
    sizes = np.diff(np.append(-1, last))
    rank[sa[slots]] = np.repeat(slots[last], sizes)
    return slots[np.repeat(sizes > 1, sizes)]


def common_prefixes(text: np.ndarray, sa: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """Length of the common prefix of each suffix in ``sa`` and the one before it.

    Kasai's pass over the text, with the text cut into lanes that advance side by side: the prefix
    shared at a place is at least the one shared at the place before, less one. The array must be
    fully sorted.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)  # by place, the place that sorts just before
    before[sa[1:]] = sa[:-1]
    lanes = min(lanes, n)
    at = np.arange(lanes) * n // lanes
    stop = np.append(at[1:], n)
    shared = np.zeros(lanes, np.int64)
    live = np.arange(lanes)
    while len(live):
        i = at[live]
        j = before[i]
        h = shared[live]
        x, y = i + h, j + h
        same = (j >= 0) & (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        shared[live[same]] += 1
        done = live[~same]
        out[slot[at[done]]] = np.where(before[at[done]] >= 0, shared[done], 0)
        shared[done] = np.where(before[at[done]] >= 0, np.maximum(shared[done] - 1, 0), 0)
        at[done] += 1
        live = live[at[live] < stop[live]]
    return out


def prefix_ranges(text: np.ndarray, sa: np.ndarray, other: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern ``other[start : start + length]`` the range of ``sa`` that begins with it.

    All patterns are searched at once, by bisection.
    """
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = _below(text, sa[mid], other, starts[todo], lengths[todo], upper)
            lo[todo] = np.where(right, mid + 1, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        bounds.append(lo)
    return bounds[0], bounds[1]


def _below(text: np.ndarray, at: np.ndarray, other: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """Whether the suffix sorts before the pattern (or, for the upper bound, begins with it)."""
    out = np.zeros(len(at), bool)
    open_ = np.arange(len(at))
    for k in range(int(lengths.max(initial=0))):
        done = lengths[open_] <= k
        out[open_[done]] = upper
        open_ = open_[~done]
        if not len(open_):
            return out
        pos = at[open_] + k
        have = np.where(pos < len(text), text[np.minimum(pos, len(text) - 1)].astype(np.int64), -1)
        want = other[starts[open_] + k].astype(np.int64)
        out[open_] = have < want
        open_ = open_[have == want]
    out[open_] = upper
    return out
