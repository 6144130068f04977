"""Counts within radii and nearest points inside one block of a grid, on arrays.

Points near one another share most of their candidates.  So candidates are sorted into small cells; a cell that lies
wholly within a radius of a cell of points counts as a number, one wholly outside not at all, and only the points of
cells that a circle may cut are tested one by one.  Distances are compared after the root, as in SQL.
"""

from __future__ import annotations

import math

import numpy as np

#: Elements of one matrix of distances, so that it stays in the cache, and pairs listed at once by the search of the nearest.
MATRIX, PAIRS = 1 << 16, 1 << 21
#: Cells of one index at most, and candidates that a candidate's own cell holds on average before cells are made smaller.
CELLS, IN_CELL = 1_000_000, 4
#: Relative slack of the bounds that decide without a test.
SLACK = 1e-9


def largest_square(radius: float) -> float:
    """The largest double whose root is at most the radius."""
    t = radius * radius
    while math.sqrt(math.nextafter(t, math.inf)) <= radius:
        t = math.nextafter(t, math.inf)
    while math.sqrt(t) > radius:
        t = math.nextafter(t, 0.0)
    return t


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    length = ends - starts
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(starts - before, length)


def _cells(x: np.ndarray, y: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, ends): rows sorted by cell, and where each occupied cell begins and ends in that order."""
    cx, cy = np.floor((x - x.min()) / size).astype(np.int64), np.floor((y - y.min()) / size).astype(np.int64)
    code = cy * (cx.max() + 1) + cx
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, starts, np.append(starts[1:], len(code))


def counts(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, radii: list[float]) -> np.ndarray:
    """For each point p and radius, how many points q are at most that far."""
    out = np.zeros((len(px), len(radii)), np.int64)
    if not len(px) or not len(qx):
        return out
    reach = max(radii)
    order, starts, ends = _cells(qx, qy, reach / 32)
    qx, qy, sizes = qx[order], qy[order], ends - starts
    x_low, x_high, y_low, y_high = (f.reduceat(v, starts) for v in (qx, qy) for f in (np.minimum, np.maximum))
    squares = [(r * r * (1 - SLACK), r * r * (1 + SLACK), largest_square(r)) for r in radii]
    dx, dy, hit = np.empty(MATRIX), np.empty(MATRIX), np.empty(MATRIX, bool)
    p_order, p_starts, p_ends = _cells(px, py, reach / (16 if len(px) > 8000 else 8))
    for a, b in zip(p_starts, p_ends):
        rows = p_order[a:b]
        x, y = px[rows], py[rows]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        gap_x, gap_y = np.maximum(np.maximum(x_low - x1, x0 - x_high), 0), np.maximum(np.maximum(y_low - y1, y0 - y_high), 0)
        far_x, far_y = np.maximum(x_high - x0, x1 - x_low), np.maximum(y_high - y0, y1 - y_low)
        near2, far2 = gap_x * gap_x + gap_y * gap_y, far_x * far_x + far_y * far_y
        for j, (inner, outer, largest) in enumerate(squares):
            whole = far2 <= inner
            found = np.full(len(rows), int(sizes[whole].sum()))
            cut = np.flatnonzero((near2 <= outer) & ~whole)
            if len(cut):
                at = ranges(starts[cut], ends[cut])
                sx, sy = qx[at], qy[at]
                for s in range(0, len(sx), MATRIX):
                    u, v = sx[s : s + MATRIX], sy[s : s + MATRIX]
                    step = max(1, MATRIX // len(u))
                    for i in range(0, len(rows), step):
                        n = len(x[i : i + step])
                        shape, size = (n, len(u)), n * len(u)
                        ex, ey, h = dx[:size].reshape(shape), dy[:size].reshape(shape), hit[:size].reshape(shape)
                        np.subtract(x[i : i + n, None], u, out=ex)
                        np.multiply(ex, ex, out=ex)
                        np.subtract(y[i : i + n, None], v, out=ey)
                        np.multiply(ey, ey, out=ey)
                        np.add(ex, ey, out=ex)
                        np.less_equal(ex, largest, out=h)
                        found[i : i + n] += [np.count_nonzero(row) for row in h]
            out[rows, j] = found
    return out


def nearest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest point q, its distance) for each point p; of equally near ones the first; -1 where none is within the reach."""
    best, least = np.full(len(px), -1), np.full(len(px), np.nan)
    if not len(px) or not len(qx):
        return best, least
    x0, y0, wide, high = qx.min(), qy.min(), float(np.ptp(qx)), float(np.ptp(qy))
    size = max(math.sqrt(wide * high / len(qx)), max(wide, high, reach) / 300)
    while True:
        cx, cy = np.floor((qx - x0) / size).astype(np.int64), np.floor((qy - y0) / size).astype(np.int64)
        columns, lines = int(cx.max()) + 1, int(cy.max()) + 1
        held = np.bincount(cy * columns + cx, minlength=columns * lines)
        if float((held * held).sum()) <= IN_CELL * len(qx) or columns * lines * 2.25 > CELLS:
            break
        size /= 1.5
    order = np.argsort(cy * columns + cx, kind="stable")
    starts = np.append(0, np.cumsum(held))
    qx, qy = qx[order], qy[order]
    at_x, at_y = np.floor((px - x0) / size).astype(np.int64), np.floor((py - y0) / size).astype(np.int64)
    open_, ring = np.arange(len(px)), 1
    while len(open_):
        c0, c1 = np.clip(at_x[open_] - ring, 0, columns), np.clip(at_x[open_] + ring + 1, 0, columns)
        l0, l1 = np.clip(at_y[open_] - ring, 0, lines), np.clip(at_y[open_] + ring + 1, 0, lines)
        step = max(1, PAIRS // (2 * ring + 1))
        left = [np.empty(0, np.int64)]
        i = 0
        while i < len(open_):
            part = slice(i, i + step)
            rows, of = ranges(l0[part], l1[part]), np.repeat(np.arange(len(open_[part])), l1[part] - l0[part])
            a, b = starts[rows * columns + c0[part][of]], starts[rows * columns + np.maximum(c1[part], c0[part])[of]]
            total = np.bincount(of, weights=b - a, minlength=len(open_[part])).astype(np.int64)
            if total.sum() > PAIRS and step > 1:
                step = max(1, step // 2)
                continue
            some = np.flatnonzero(total)
            ids = open_[part]
            if len(some):
                q, p = ranges(a, b), np.repeat(ids[some], total[some])
                ex, ey = px[p] - qx[q], py[p] - qy[q]
                d = np.sqrt(ex * ex + ey * ey)
                begins = np.cumsum(total[some]) - total[some]
                m = np.minimum.reduceat(d, begins)
                first = np.minimum.reduceat(np.where(d == np.repeat(m, total[some]), order[q], len(order)), begins)
                best[ids[some]], least[ids[some]] = first, m
            everything = (c0[part] == 0) & (c1[part] == columns) & (l0[part] == 0) & (l1[part] == lines)
            known = ring * size * (1 - SLACK)
            left.append(ids[~(everything | (least[ids] <= known) | (known > reach))])
            i += step
        open_ = np.concatenate(left)
        ring *= 2
    beyond = ~(least <= reach)
    best[beyond], least[beyond] = -1, np.nan
    return best, least
