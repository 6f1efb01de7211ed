"""Nearest points by rings of grid cells: plain numpy over many sets at once, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np

#: Points of a cell on average.
POINTS_A_CELL = 3.0
#: Sets of no more points are compared whole, which takes less than their grids.
FEW_POINTS = 128
#: What rounding may add to a distance between cells, as a share.
_SLACK = 1e-9


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Grid:
    """Points of several sets, dealt to square cells; each set has a grid of its own over its extent."""

    def __init__(self, owner: np.ndarray, x: np.ndarray, y: np.ndarray, n_sets: int):
        n = np.bincount(owner, minlength=n_sets)
        low = np.full((2, n_sets), np.inf)
        high = np.full((2, n_sets), -np.inf)
        for i, v in enumerate((x, y)):
            np.minimum.at(low[i], owner, v)
            np.maximum.at(high[i], owner, v)
        self.low = np.where(n > 0, low, 0.0)
        extent = np.where(n > 0, high - low, 0.0)
        cells = np.maximum(n / POINTS_A_CELL, 1.0)
        # Square cells of about equal number for any shape of the extent; a line is cut along its length.
        side = np.sqrt(extent[0] * extent[1] / cells)
        self.side = np.maximum(side, extent.max(axis=0) / cells)
        self.side[self.side <= 0] = 1.0
        self.shape = (extent // self.side).astype(np.int64) + 1
        sizes = self.shape[0] * self.shape[1]
        self.first = np.cumsum(sizes) - sizes
        key = self.first[owner] + self._cell(owner, y, 1) * self.shape[0][owner] + self._cell(owner, x, 0)
        self.order = np.argsort(key, kind="stable")
        self.starts = np.r_[0, np.cumsum(np.bincount(key, minlength=int(sizes.sum())))]

    def _cell(self, owner: np.ndarray, v: np.ndarray, axis: int) -> np.ndarray:
        return np.clip(np.floor((v - self.low[axis][owner]) / self.side[owner]).astype(np.int64), 0, self.shape[axis][owner] - 1)

    def spans(self, owner: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points of cells left..right of a row begin among the ordered points, and their number."""
        width, height = self.shape[0][owner], self.shape[1][owner]
        left, right = np.maximum(left, 0), np.minimum(right, width - 1)
        ok = (row >= 0) & (row < height) & (left <= right)
        at = np.where(ok, self.first[owner] + row * width + left, 0)
        begun = self.starts[at]
        ended = self.starts[np.where(ok, at + (right - left) + 1, 0)]
        return begun, np.where(ok, ended - begun, 0)


def nearest(owner: np.ndarray, rank: np.ndarray, x: np.ndarray, y: np.ndarray, to: np.ndarray, tx: np.ndarray, ty: np.ndarray, n_sets: int, within: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """For each target (of set ``to`` at tx, ty) the closest point of its set, of equal ones that of the least rank.

    Returns the points' places (-1 where there is none, or none within the radius), the distances, and how many pairs
    were compared. Rings of cells grow around each target until no cell further out can hold a closer point.
    """
    found, least = np.full(len(to), -1), np.full(len(to), np.inf)
    compared = 0
    if not len(owner) or not len(to):
        return found, least, compared
    grid = Grid(owner, x, y, n_sets)
    own = np.bincount(owner, minlength=n_sets)[to] > 0
    active = np.flatnonzero(own & np.isfinite(tx) & np.isfinite(ty))
    side = grid.side[to]
    cx, cy = (np.floor((v - grid.low[i][to]) / side) for i, v in enumerate((tx, ty)))
    far = 2.0**52
    cx, cy = np.clip(np.nan_to_num(cx), -far, far).astype(np.int64), np.clip(np.nan_to_num(cy), -far, far).astype(np.int64)
    wide, high = grid.shape[0][to] - 1, grid.shape[1][to] - 1
    # The first ring that meets the grid, and the last one.
    ring = np.maximum.reduce([np.zeros_like(cx), -cx, cx - wide, -cy, cy - high])
    last = np.maximum.reduce([np.abs(cx), np.abs(wide - cx), np.abs(cy), np.abs(high - cy)])
    bound = np.inf if within is None else within
    while len(active):
        r, s = ring[active], to[active]
        x0, y0 = cx[active], cy[active]
        spans = [(active, *grid.spans(s, y0 - r, x0 - r, x0 + r))]
        outer = r > 0
        spans.append((active[outer], *grid.spans(s[outer], (y0 + r)[outer], (x0 - r)[outer], (x0 + r)[outer])))
        # Rows in between have one cell on each side; only those within the grid are visited.
        low, top = np.maximum(y0 - r + 1, 0), np.minimum(y0 + r - 1, high[active])
        rows = np.maximum(top - low + 1, 0)
        which, row = np.repeat(np.arange(len(active)), rows), _flat(low, rows)
        for column in (x0 - r, x0 + r):
            c = column[which]
            spans.append((active[which], *grid.spans(s[which], row, c, c)))
        target, begun, n = (np.concatenate(v) for v in zip(*spans, strict=True))
        pair, point = np.repeat(target, n), grid.order[_flat(begun, n)]
        compared += len(pair)
        if len(pair):
            d = np.sqrt((x[point] - tx[pair]) * (x[point] - tx[pair]) + (y[point] - ty[pair]) * (y[point] - ty[pair]))
            order = np.lexsort((rank[point], d, pair))
            first = order[np.r_[True, pair[order][1:] != pair[order][:-1]]]
            t, p, d = pair[first], point[first], d[first]
            better = (d < least[t]) | ((d == least[t]) & (rank[p] < rank[np.maximum(found[t], 0)]))
            found[t[better]], least[t[better]] = p[better], d[better]
        # Whatever lies beyond ring r is at least r sides away.
        reach = r * side[active] * (1 - _SLACK)
        going = (r < last[active]) & (least[active] >= reach) & (reach <= bound)
        active = active[going]
        ring[active] += 1
    if within is not None:
        beyond = least > within
        found[beyond], least[beyond] = -1, np.inf
    return found, least, compared


def closest(owner: np.ndarray, rank: np.ndarray, x: np.ndarray, y: np.ndarray, to: np.ndarray, tx: np.ndarray, ty: np.ndarray, n_sets: int, within: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of nearest(), for sets that follow one another in both: small ones are compared whole."""
    found, least = np.full(len(to), -1), np.full(len(to), np.inf)
    points, targets = (np.searchsorted(v, np.arange(n_sets + 1)) for v in (owner, to))
    n = np.diff(points)
    order = np.lexsort((rank, owner))
    for s in np.flatnonzero((n > 0) & (n <= FEW_POINTS) & (np.diff(targets) > 0)):
        own, at = order[points[s] : points[s + 1]], slice(targets[s], targets[s + 1])
        dx, dy = tx[at, None] - x[own], ty[at, None] - y[own]
        d = np.sqrt(dx * dx + dy * dy)
        # Of equal ones argmin takes the first, which has the least rank.
        best = d.argmin(axis=1)
        d = d[np.arange(len(best)), best]
        ok = np.isfinite(d) if within is None else d <= within
        found[at], least[at] = np.where(ok, own[best], -1), np.where(ok, d, np.inf)
    many, wanted = (n > FEW_POINTS)[owner], (n > FEW_POINTS)[to]
    if wanted.any():
        places = np.flatnonzero(many)
        f, d, _ = nearest(owner[many], rank[many], x[many], y[many], to[wanted], tx[wanted], ty[wanted], n_sets, within)
        found[wanted], least[wanted] = np.where(f >= 0, places[np.maximum(f, 0)], -1), d
    return found, least
