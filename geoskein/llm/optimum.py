"""Optimal length buckets by dynamic programming (no Spark in this module)."""

from __future__ import annotations

import numpy as np


def _layer(best: np.ndarray, lengths: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: for every j the least ``best[i] + lengths[j-1] * (upto[j] - upto[i])`` over i < j, and its i.

    The best i never falls as j grows (the cost is quadrangle-monotone), so the ends of every range of j bound the
    search at its middle; the ranges of one depth are searched together.
    """
    n = len(lengths)
    value, where = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    value[0] = 0.0
    first, last = np.array([1]), np.array([n])  # ranges of j
    low, high = np.array([0]), np.array([n - 1])  # where their best i may lie
    while len(first):
        middle = (first + last) // 2
        top = np.minimum(high, middle - 1)
        sizes = top - low + 1
        ends = np.cumsum(sizes)
        begins = ends - sizes
        i = np.arange(ends[-1]) - np.repeat(begins - low, sizes)
        j = np.repeat(middle, sizes)
        cost = best[i] + lengths[j - 1] * (upto[j] - upto[i])
        least = np.minimum.reduceat(cost, begins)
        hits = np.flatnonzero(cost == np.repeat(least, sizes))
        owner = np.searchsorted(ends, hits, side="right")
        found = np.empty(len(middle), dtype=np.int64)
        found[owner[::-1]] = i[hits[::-1]]  # the smallest of equal ones
        value[middle], where[middle] = least, found
        lefts, rights = first < middle, middle < last
        first, last, low, high = (
            np.concatenate([first[lefts], middle[rights] + 1]),
            np.concatenate([middle[lefts] - 1, last[rights]]),
            np.concatenate([low[lefts], found[rights]]),
            np.concatenate([found[lefts], high[rights]]),
        )
    return value, where


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending, the last one the longest length) with the least total padding for ascending distinct lengths; exact."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    sizes = np.asarray(lengths, dtype=float)
    best = np.concatenate([[0.0], sizes * upto[1:]])
    came = []
    for _ in range(buckets - 1):
        best, where = _layer(best, sizes, upto)
        came.append(where)
    out, j = [], n
    for where in reversed(came):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(where[j])
    if j > 0:
        out.append(int(lengths[j - 1]))
    return sorted(set(out))
