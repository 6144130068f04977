"""Boosted regression trees on sums of rows: the squared loss needs of a cell only its rows and their sum.

The rules are those of Spark's estimator: at most ``BINS`` bins a column, the first tree fits the target with weight one,
later ones twice the residual with the learning rate, each on its own draw of rows; a leaf gives the mean.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins of a column in one training set, and values of a fold that stand for its distribution where it has many.
BINS, QUANTILES = 32, 2048


def training_sets(folds: Sequence) -> set[frozenset]:
    """The sets of folds left out: each one, and with the next one for the inner choice."""
    return {frozenset({f}) for f in folds} | ({frozenset({f, folds[(i + 1) % len(folds)]}) for i, f in enumerate(folds)} if len(folds) > 2 else set())


def thresholds(values: Iterable[tuple[float, float]]) -> list[float]:
    """Midpoints between the distinct values while these are at most BINS, else between values of even steps of weight."""
    weight: dict[float, float] = {}
    for v, w in values:
        weight[v] = weight.get(v, 0.0) + w
    v = np.array(sorted(weight))
    middle = (v[:-1] + v[1:]) / 2
    if len(v) > BINS:
        upto = np.cumsum([weight[i] for i in v])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)
        middle = middle[np.unique(np.minimum(at, len(middle) - 1))]
    return [float(t) for t in middle]


class Cells:
    """Rows of (fold, cell numbers..., n, s, q, n0, s0, n1, s1, ...): counts and sums of the target, of all rows and of each tree's draw."""

    def __init__(self, rows: Sequence, numbers: Sequence[str], grid: Sequence[Sequence[float]], trees: int) -> None:
        self.fold = np.array([r["_f"] for r in rows], dtype=object)
        self.x = [np.array([r[c] for r in rows], np.int64) for c in numbers]
        self.grid, self.trees = grid, trees
        self.n, self.s, self.q = (np.array([r[c] for r in rows], float) for c in "nsq")
        self.drawn = [(np.array([r[f"n{t}"] for r in rows], float), np.array([r[f"s{t}"] or 0.0 for r in rows], float)) for t in range(trees)]

    def fit(self, left_out: set, cuts: Sequence[Sequence[float]], depth: int, rate: float) -> list[tuple[float, tuple]]:
        """(weight, tree) of each tree; a tree is a mean or (column, threshold, left, right)."""
        inside = np.flatnonzero(~np.isin(self.fold, list(left_out)))
        # the place of each threshold among those of all training sets
        bins = [np.searchsorted(np.searchsorted(g, c), x[inside], side="left") for g, c, x in zip(self.grid, cuts, self.x)]
        estimate, model = np.zeros(len(inside)), []
        for t in range(self.trees):
            n, s = (v[inside] for v in self.drawn[t])
            if t:
                s = 2 * (s - n * estimate)
            weight, tree = (rate if t else 1.0), self._grow(bins, n, s, cuts, depth, np.arange(len(inside)))
            model.append((weight, tree))
            estimate += weight * self._tree(tree, inside)
        return model

    def _grow(self, bins: list, n: np.ndarray, s: np.ndarray, cuts: Sequence[Sequence[float]], depth: int, rows: np.ndarray) -> tuple | float:
        total_n, total_s = n[rows].sum(), s[rows].sum()
        mean = float(total_s / total_n) if total_n else 0.0
        best = (1e-12 * max(1.0, abs(total_s * mean)), None, None)
        for c in range(len(bins)) if depth and total_n else ():
            ln, ls = (np.cumsum(np.bincount(bins[c][rows], weights=v[rows], minlength=len(cuts[c]) + 1))[:-1] for v in (n, s))
            rn, rs = total_n - ln, total_s - ls
            able = (ln > 0) & (rn > 0)
            gain = np.where(able, ls * ls / np.where(able, ln, 1) + rs * rs / np.where(able, rn, 1) - total_s * mean, -np.inf)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), c, int(gain.argmax()))
        if best[1] is None:
            return mean
        low = bins[best[1]][rows] <= best[2]
        return (best[1], cuts[best[1]][best[2]], *(self._grow(bins, n, s, cuts, depth - 1, rows[k]) for k in (low, ~low)))

    def _tree(self, tree: tuple | float, rows: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(rows), tree)
        c, threshold, left, right = tree
        low = self.x[c][rows] <= np.searchsorted(self.grid[c], threshold)
        out = np.empty(len(rows))
        out[low], out[~low] = self._tree(left, rows[low]), self._tree(right, rows[~low])
        return out

    def error(self, model: list[tuple[float, tuple]], fold: object) -> float:
        """Mean squared error on the rows of a fold."""
        rows = np.flatnonzero(self.fold == fold)
        e = sum(w * self._tree(t, rows) for w, t in model)
        return float((self.q[rows] - 2 * e * self.s[rows] + e * e * self.n[rows]).sum() / self.n[rows].sum())


def expression(model: list[tuple[float, tuple]], x: Sequence[Column]) -> Column:
    """The model's estimate of a row."""

    def of(tree: tuple | float) -> Column:
        return F.lit(tree) if isinstance(tree, float) else F.when(x[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    out = F.lit(0.0)
    for weight, tree in model:
        out = out + of(tree) * weight
    return out
