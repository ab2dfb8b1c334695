"""Cover trees over integer points, and the assignment of whole subtrees to their nearest entry.

A node stands for a ball: a point, the points below it, and the distance to the farthest of them. Its
children lie within half of the node's scale (a power of two) of their own points, the points of two
children are farther apart than that, and the first child repeats the node's point. Points are stored so that a node's
are consecutive; running sums over them then give the sum and number of any subtree.

Distances are squared and exact: products of doubles while they stay whole, 64-bit integers beyond.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Points of a node that is not divided further.
LEAF = 16
_WHOLE = 2.0**53


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points (rows) to all entries (columns)."""
    largest = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if 4 * largest * largest * max(1, points.shape[1]) < _WHOLE:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(axis=1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(axis=1)
    return np.stack([((points - one) ** 2).sum(axis=1) for one in entries], axis=1)


@dataclass
class CoverTree:
    points: np.ndarray  # different points, in tree order
    weight: np.ndarray  # how many rows have this point
    place: np.ndarray  # of each row, the place of its point
    nodes: np.ndarray  # first point, last point + 1, first child, last child + 1; top node first
    radius: np.ndarray

    def __post_init__(self) -> None:
        zero = np.zeros((1, self.points.shape[1]), dtype=np.int64)
        self.below = np.concatenate([zero, np.cumsum(self.points * self.weight[:, None], axis=0)])
        self.rows_below = np.concatenate([[0], np.cumsum(self.weight)])

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> CoverTree:
        points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        place = place.reshape(-1)
        order = np.arange(len(points))
        nodes, radius = ([[0, len(points), 0, 0]] if len(points) else []), []
        at = 0
        while at < len(nodes):
            low, high = nodes[at][:2]
            mine = order[low:high].copy()
            far = np.sqrt(squared(points[mine], points[mine[:1]])[:, 0].astype(np.float64))
            radius.append(far.max())
            nodes[at][2:] = len(nodes), len(nodes)
            if high - low > leaf and radius[-1] > 0:
                cover = 2.0 ** (np.ceil(np.log2(radius[-1])) - 1)
                start = low
                while len(mine):
                    inside = far <= cover
                    inside[0] = True
                    order[start : start + inside.sum()] = mine[inside]
                    nodes.append([start, start + int(inside.sum()), 0, 0])
                    start, mine = nodes[-1][1], mine[~inside]
                    if len(mine):
                        far = np.sqrt(squared(points[mine], points[mine[:1]])[:, 0].astype(np.float64))
                nodes[at][3] = len(nodes)
            at += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return cls(points[order], weight[order], back[place], np.array(nodes, dtype=np.int64).reshape(-1, 4), np.array(radius))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, weight=self.weight, place=self.place, nodes=self.nodes, radius=self.radius)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            return cls(*(held[name] for name in ("points", "weight", "place", "nodes", "radius")))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Subtrees (first point, last + 1, entry) that are assigned whole, and single points with their entries.

        Below a node all points have the nearest entry of the node's point if the second nearest is
        farther by more than twice the radius. Equal entries count as the first of them.
        """
        different, first = np.unique(entries, axis=0, return_index=True)
        rank = np.argsort(first)
        different, first = different[rank], first[rank]  # the least index wins a tie
        whole, exact = [], []
        active = np.arange(min(1, len(self.nodes)))
        while len(active):
            node, radius = self.nodes[active], self.radius[active]
            away = squared(self.points[node[:, 0]], different)
            best = away.argmin(axis=1)
            near = np.sqrt(away[np.arange(len(best)), best].astype(np.float64))
            if len(different) > 1:
                second = np.sqrt(np.partition(away, 1, axis=1)[:, 1].astype(np.float64))
                sure = second - near > 2 * radius + 1e-9 * (near + radius + 1)
            else:
                sure = np.ones(len(best), dtype=bool)
            whole.append(np.column_stack([node[sure, :2], first[best[sure]]]))
            split = node[~sure]
            leaves = split[split[:, 2] == split[:, 3]]
            exact.extend(np.arange(low, high) for low, high in leaves[:, :2].tolist())
            inner = split[split[:, 2] < split[:, 3]]
            active = np.concatenate([np.arange(low, high) for low, high in inner[:, 2:].tolist()]) if len(inner) else active[:0]
        single = np.concatenate(exact) if exact else np.zeros(0, dtype=np.int64)
        nearest = first[squared(self.points[single], different).argmin(axis=1)] if len(single) else single
        subtrees = np.concatenate(whole) if whole else np.zeros((0, 3), dtype=np.int64)
        return subtrees, single, nearest

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the number of its rows and the sum of their points."""
        count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
        subtrees, single, nearest = self.assign(entries)
        low, high, entry = subtrees.T
        np.add.at(count, entry, self.rows_below[high] - self.rows_below[low])
        np.add.at(total, entry, self.below[high] - self.below[low])
        np.add.at(count, nearest, self.weight[single])
        np.add.at(total, nearest, self.points[single] * self.weight[single][:, None])
        return count, total

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the nearest entry and the squared distance to it."""
        entry = np.zeros(len(self.points), dtype=np.int64)
        subtrees, single, nearest = self.assign(entries)
        for low, high, best in subtrees.tolist():
            entry[low:high] = best
        entry[single] = nearest
        away = ((self.points - entries[entry]) ** 2).sum(axis=1)
        return entry[self.place], away[self.place]
