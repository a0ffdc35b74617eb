"""Exact nearest entries under squared Euclidean distance of integer points: a vantage-point tree, searched for many points at once.

Each node keeps a vantage entry and, for its nearer and farther half, the smallest and largest distance to it.  A search
visits the likelier half first and the other unless the triangle inequality shows that every entry there is strictly
farther than the best found.  Roots are rounded away from a wrong exclusion and equal bounds are visited, so that what
decides is the integer distance, then the lower index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 8
#: Relative margin by which roots are rounded down or up; a root, a conversion and a difference err by less.
MARGIN = 1e-14


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(points, entries) of exact squared distances of int64 rows."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < 1 << 53:  # every sum is a whole number that a double holds
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(1)[:, None] + (e * e).sum(1) - 2 * (p @ e.T)).astype(np.int64)
    if 4 * most * most * points.shape[1] >= 1 << 63:
        raise ValueError("components are too large for squared distances of 64 bits")
    apart = points[:, None, :] - entries[None, :, :]
    return (apart * apart).sum(2)


def low(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 - MARGIN)


def high(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 + MARGIN)


@dataclass
class Half:
    node: Node | np.ndarray
    nearest: float
    farthest: float

    def may_hold(self, to_vantage: np.ndarray, best: np.ndarray) -> np.ndarray:
        """For which points, by their squared distance to the vantage entry, this half may hold an entry as near as ``best``."""
        bound = high(best)
        return (low(to_vantage) - self.farthest <= bound) & (self.nearest - high(to_vantage) <= bound)


@dataclass
class Node:
    vantage: int
    near: Half
    far: Half


class VantageTree:
    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        """``entries``: one int64 row each, at least one."""
        self.entries, self.leaf, self.measured = entries, leaf, 0
        self.root = self._make(np.arange(len(entries)))

    def _make(self, mine: np.ndarray) -> Node | np.ndarray:
        if len(mine) <= self.leaf:
            return mine
        start = squared(self.entries[mine], self.entries[mine[:1]])[:, 0]
        vantage = mine[int(start.argmax())]
        rest = mine[mine != vantage]
        away = squared(self.entries[rest], self.entries[[vantage]])[:, 0]
        order = np.argsort(away, kind="stable")
        halves = []
        for part in (order[: len(order) // 2], order[len(order) // 2 :]):
            halves.append(Half(self._make(np.sort(rest[part])), float(low(away[part].min())), float(high(away[part].max()))))
        return Node(int(vantage), *halves)

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, ties to the lower index, and the squared distance to it."""
        which, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        self._visit(self.root, points, np.arange(len(points)), which, best)
        return which, best

    def _measure(self, points: np.ndarray, rows: np.ndarray, entries: np.ndarray, which: np.ndarray, best: np.ndarray) -> np.ndarray:
        found = squared(points[rows], self.entries[entries])
        self.measured += found.size
        place = found.argmin(1)  # the first, and entries ascend
        least, index = found[np.arange(len(rows)), place], entries[place]
        better = (least < best[rows]) | (least == best[rows]) & (index < which[rows])
        which[rows[better]], best[rows[better]] = index[better], least[better]
        return found

    def _visit(self, node: Node | np.ndarray, points: np.ndarray, rows: np.ndarray, which: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self._measure(points, rows, node, which, best)
            return
        away = self._measure(points, rows, np.array([node.vantage]), which, best)[:, 0]
        inside = low(away) <= (node.near.farthest + node.far.nearest) / 2
        for likely in (True, False):
            for half, mine in ((node.near, inside == likely), (node.far, inside != likely)):
                mine = mine & half.may_hold(away, best[rows])
                self._visit(half.node, points, rows[mine], which, best)
