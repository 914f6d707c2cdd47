"""Exact nearest center for large models (JOI1, ORD2 at size).

The centers are dealt into blocks of about `BLOCK_ROWS` by median cuts along the widest
dimension; a block keeps its bounding box. A point looks at blocks by ascending distance to their
boxes and stops when the next box is farther than the best center so far. Work per point
is a few blocks instead of all centers, and no array of points x centers exists: distances to
boxes are held for `BOX_CELLS` pairs at a time, distances to centers for one block at a time.

The box distance adds up per dimension in the order of the point distance, so rounding cannot put
a box behind a center that it holds: results equal the full scan bit for bit, ties to the first
center included.
"""

from __future__ import annotations

import numpy as np

BLOCK_ROWS = 512
BOX_CELLS = 4_000_000       # points x boxes held at once
FIRST = 2                   # boxes that every point looks at before the others are weighed


class CenterBlocks:
    """Centers (rows x dims) in position order, searchable."""

    def __init__(self, centers: np.ndarray, block_rows: int = BLOCK_ROWS):
        self.centers = np.ascontiguousarray(centers, dtype=np.float64)
        finite = np.flatnonzero(~np.isnan(self.centers).any(axis=1))    # no distance reaches the others
        self.blocks = self._cut(finite, block_rows) if len(finite) else []
        self.lo = np.array([self.centers[b].min(axis=0) for b in self.blocks]).reshape(len(self.blocks), centers.shape[1])
        self.hi = np.array([self.centers[b].max(axis=0) for b in self.blocks]).reshape(len(self.blocks), centers.shape[1])

    def _cut(self, rows: np.ndarray, most: int) -> list[np.ndarray]:
        out, todo = [], [rows]
        while todo:
            part = todo.pop()
            if len(part) <= most:
                out.append(np.sort(part))
                continue
            c = self.centers[part]
            d = int(np.argmax(c.max(axis=0) - c.min(axis=0)))
            half = len(part) // 2
            order = part[np.argpartition(c[:, d], half)]
            todo += [order[:half], order[half:]]
        return out

    def _box_distances(self, x: np.ndarray) -> np.ndarray:
        acc = None
        for d in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.lo[None, :, d] - x[:, None, d], x[:, None, d] - self.hi[None, :, d]), 0.0)
            sq = gap * gap
            acc = sq if acc is None else acc + sq
        return acc

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and squared distance of each point's nearest center, the first position among equals."""
        pos, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        rows = max(256, BOX_CELLS // max(1, len(self.blocks)))
        for at in range(0, len(x), rows):
            pos[at:at + rows], best[at:at + rows] = self._some(x[at:at + rows])
        return pos, best

    def _some(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos, best = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.inf)
        if not self.blocks:
            return np.zeros(len(x), dtype=np.int64), best
        bound = self._box_distances(x)
        bound[np.isnan(bound)] = 0.0
        near = min(FIRST, len(self.blocks))
        order = np.argpartition(bound, near - 1, axis=1)[:, :near]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(bound, order, axis=1), axis=1), axis=1)
        for k in range(near):                        # the nearest boxes first: they close most points
            self._visit(x, np.arange(len(x)), order[:, k], bound, pos, best)
        bound[np.arange(len(x))[:, None], order] = np.inf
        rows, blocks = np.nonzero(bound <= best[:, None])
        rows, blocks = rows[np.isfinite(bound[rows, blocks])], blocks[np.isfinite(bound[rows, blocks])]
        self._visit(x, rows, blocks, bound, pos, best)
        pos[pos == np.iinfo(np.int64).max] = 0
        return pos, best

    def _visit(self, x, rows, blocks, bound, pos, best) -> None:
        """Compare points `rows` with the centers of `blocks` (one block a row), where the box is near enough."""
        fine = bound[rows, blocks] <= best[rows]
        rows, blocks = rows[fine], blocks[fine]
        by = np.argsort(blocks, kind="stable")
        rows, blocks = rows[by], blocks[by]
        edges = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)] if len(blocks) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            r, block = rows[lo:hi], self.blocks[blocks[lo]]
            acc = None
            for d in range(x.shape[1]):
                diff = x[r, d][:, None] - self.centers[block, d][None, :]
                sq = diff * diff
                acc = sq if acc is None else acc + sq
            at = np.argmin(acc, axis=1)              # blocks hold positions in order: the first minimum
            d2, p = acc[np.arange(len(r)), at], block[at]
            won = (d2 < best[r]) | ((d2 == best[r]) & (p < pos[r]))
            best[r[won]], pos[r[won]] = d2[won], p[won]
