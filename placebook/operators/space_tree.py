"""A k-d tree of bounded size over places, and which of its leaves can hold a point's nearest ones.

The tree is cut on a bounded sample of places, so its leaves hold about the same number of places wherever they lie:
a town's are small and the sea's are large.  Leaves know how many places they hold and the least box around them.
A point goes down the tree a level at a time, together with all points of its batch.  At each level, the nodes whose
farthest corner is nearest to it and that hold k places between them bound its k-th distance, and nodes whose box
begins beyond that bound are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 1 << 13  # points that go down the tree together


@dataclass
class SpaceTree:
    """Nodes in levels, node n has children 2n + 1 and 2n + 2; the last ``2**depth`` are leaves."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    box: np.ndarray  # (4, nodes): least and greatest lon, least and greatest lat
    count: np.ndarray

    @staticmethod
    def cut_on(lon: np.ndarray, lat: np.ndarray, depth: int) -> SpaceTree:
        """Cut at medians of a sample along the longer side of each node."""
        place = np.stack([lon, lat])
        node = np.zeros(len(lon), np.int64)
        inner = (1 << depth) - 1
        axis, cut = np.zeros(inner, np.int8), np.zeros(inner)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
            for a in (0, 1):
                np.minimum.at(low[a], node, place[a])
                np.maximum.at(high[a], node, place[a])
            longer = (high[1] - low[1] > high[0] - low[0]).astype(np.int8)
            value = place[longer[node], np.arange(len(node))]
            order = np.lexsort((value, node))
            begins = np.searchsorted(node[order], np.arange(n + 1))
            middle = np.minimum((begins[:-1] + begins[1:]) // 2, max(len(node) - 1, 0))
            own = np.where(begins[1:] > begins[:-1], value[order][middle] if len(node) else 0.0, 0.0)
            axis[first : first + n], cut[first : first + n] = longer, own
            node = 2 * node + (value >= own[node])
        nodes = (2 << depth) - 1
        box = np.repeat(np.array([[np.inf], [-np.inf], [np.inf], [-np.inf]]), nodes, axis=1)
        return SpaceTree(depth, axis, cut, box, np.zeros(nodes, np.int64))

    def leaf_of(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The leaf (from 0) that each place lies in."""
        place, node = np.stack([lon, lat]), np.zeros(len(lon), np.int64)
        for level in range(self.depth):
            at = node + (1 << level) - 1
            node = 2 * node + (place[self.axis[at], np.arange(len(lon))] >= self.cut[at])
        return node

    def filled(self, leaf: np.ndarray, count: np.ndarray, box: np.ndarray) -> SpaceTree:
        """With what each leaf holds; inner nodes hold what their children do."""
        first = (1 << self.depth) - 1
        self.count[first + leaf], self.box[:, first + leaf] = count, box
        for level in range(self.depth - 1, -1, -1):
            at = np.arange((1 << level) - 1, (2 << level) - 1)
            a, b = 2 * at + 1, 2 * at + 2
            self.count[at] = self.count[a] + self.count[b]
            for side, pick in ((0, np.minimum), (1, np.maximum), (2, np.minimum), (3, np.maximum)):
                self.box[side, at] = pick(self.box[side, a], self.box[side, b])
        return self

    def near(self, lon: np.ndarray, lat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf): the leaves that may hold one of the k places nearest to each point, those at equal distance included."""
        found = [self._near(lon[a : a + STEP], lat[a : a + STEP], k) for a in range(0, len(lon), STEP)]
        return np.concatenate([p + a * STEP for a, (p, _) in enumerate(found)] or [np.zeros(0, np.int64)]), np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)])

    def _near(self, lon: np.ndarray, lat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        point, node = np.arange(len(lon)), np.zeros(len(lon), np.int64)
        for _ in range(self.depth):
            point, node = np.repeat(point, 2), (2 * node[:, None] + np.array([1, 2])).ravel()
            some = self.count[node] > 0
            point, node = point[some], node[some]
            x, y = lon[point], lat[point]
            x0, x1, y0, y1 = self.box[:, node]
            # in the order of operations of the distances themselves, so that rounding keeps the bounds
            dx, dy = np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
            least = dx * dx + dy * dy
            dx, dy = np.maximum(np.abs(x0 - x), np.abs(x1 - x)), np.maximum(np.abs(y0 - y), np.abs(y1 - y))
            most = dx * dx + dy * dy
            order = np.lexsort((most, point))
            held = np.cumsum(self.count[node[order]])
            begins = np.flatnonzero(np.r_[True, point[order][1:] != point[order][:-1]]) if len(order) else order
            before = np.repeat(np.r_[0, held][begins], np.diff(np.r_[begins, len(order)]))
            enough = held - before >= k
            bound = np.full(len(lon), np.inf)
            np.minimum.at(bound, point[order][enough], most[order][enough])
            keep = least <= bound[point]
            point, node = point[keep], node[keep]
        return point, node - ((1 << self.depth) - 1)


def nearest_of(lon: np.ndarray, lat: np.ndarray, rec_id: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, rec_id, squared distance) of the k places nearest to each point, ties to the smaller id; places come in order of rec_id."""
    step, out = max(1, (1 << 20) // max(len(lon), 1)), []
    for a in range(0, len(x), step):
        dx, dy = lon[None, :] - x[a : a + step, None], lat[None, :] - y[a : a + step, None]
        d2 = dx * dx + dy * dy
        row, col = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]) if k < len(lon) else np.divmod(np.arange(d2.size), len(lon))
        order = np.lexsort((col, d2[row, col], row))
        row, col = row[order], col[order]
        begins = np.searchsorted(row, np.arange(len(d2)))
        first = np.arange(len(row)) - begins[row] < k
        out.append((row[first] + a, rec_id[col[first]], d2[row[first], col[first]]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
