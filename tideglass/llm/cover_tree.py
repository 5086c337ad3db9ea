"""Cover trees over integer vectors for searches by inner product.

Every vector gets one more component that lifts it to the sphere of radius ``reach``. A node has a centre and covers its
points within a radius that at least halves from level to level; kept is the radius it really needs. For a query, centre
and radius are angles on the sphere, and bound the inner products of all points of the node from both sides. Points are
verified by their integer inner products.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Nodes of at most so many points are not divided.
LEAF = 24
#: Inner products up to here are exact in double precision.
EXACT = 2**53


def exact_products(x: np.ndarray, y: np.ndarray, reach_x: float, reach_y: float) -> np.ndarray:
    """``x @ y`` of integer-valued doubles as integers; the lengths tell whether doubles hold every partial sum."""
    if reach_x * reach_y < EXACT:
        return np.rint(x @ y).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64)


@dataclass
class CoverTree:
    """Points in the order of the leaves; node ``i`` has the points ``own[i]`` of its own and the nodes ``below[i]``."""

    points: np.ndarray
    centre: np.ndarray  # vectors of the nodes, without the added component
    angle: np.ndarray  # covering angle of the nodes
    own: np.ndarray
    below: np.ndarray
    reach: float


def build(x: np.ndarray, reach: float) -> tuple[CoverTree, np.ndarray]:
    """A tree over the rows of ``x`` (integers as doubles, none longer than ``reach``), and the row of each point."""
    lift = np.sqrt(np.maximum(0.0, reach * reach - (x * x).sum(axis=1)))
    y = np.column_stack((x, lift))
    distance = lambda rows, c: np.sqrt(np.maximum(0.0, ((y[rows] - y[c]) ** 2).sum(axis=1)))
    order: list[int] = []
    centre, radius, own, below = [0], [0.0], [(0, 0)], [(0, 0)]
    todo = [(0, np.arange(len(x)), 0, None)]
    while todo:
        node, rows, c, scale = todo.pop()
        far = distance(rows, c)
        centre[node], radius[node] = c, float(far.max(initial=0.0))
        if len(rows) <= LEAF or radius[node] == 0:
            own[node] = (len(order), len(order) + len(rows))
            order.extend(rows.tolist())
            continue
        scale = min(radius[node], scale or radius[node]) / 2
        # The centre covers first; then the first point left opens the next node of this level.
        left, parts, pick, nearest = rows, [], c, far
        while len(left):
            near = (nearest <= scale) | (left == pick)
            parts.append((pick, left[near]))
            left = left[~near]
            if len(left):
                pick = int(left[0])
                nearest = distance(left, pick)
        single = [part for part in parts if len(part[1]) == 1]
        own[node] = (len(order), len(order) + len(single))
        order.extend(int(part[1][0]) for part in single)
        several = [part for part in parts if len(part[1]) > 1]
        below[node] = (len(centre), len(centre) + len(several))
        for pick, part in several:
            todo.append((len(centre), part, pick, scale))
            for column, value in ((centre, 0), (radius, 0.0), (own, (0, 0)), (below, (0, 0))):
                column.append(value)
    size = np.array(radius) * (1 + 1e-9) + 1e-6 * max(1.0, reach) ** 0.5
    angle = 2 * np.arcsin(np.minimum(1.0, size / max(2 * reach, 1e-12)))
    at = np.array(order, np.int64)
    return CoverTree(x[at], x[np.array(centre)], angle, np.array(own), np.array(below), reach), at


def bounds(tree: CoverTree, nodes: np.ndarray, query: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that points of the nodes can have with the query, of ``length`` above 0."""
    whole = length * tree.reach
    if whole == 0:
        return np.zeros(len(nodes)), np.zeros(len(nodes))
    theta = np.arccos(np.clip(tree.centre[nodes] @ query / whole, -1.0, 1.0))
    slack = 1e-7 * whole + 1e-6
    high = whole * np.cos(np.maximum(0.0, theta - tree.angle[nodes])) + slack
    low = whole * np.cos(np.minimum(np.pi, theta + tree.angle[nodes])) - slack
    return low, high


def descend(tree: CoverTree, query: np.ndarray, wanted, visit) -> int:
    """Best-first descent: ``wanted(low, high)`` says which nodes may still matter, ``visit(places, scores)`` takes
    verified points, by their places in ``points``. Returns how many points were verified."""
    if not len(tree.points):
        return 0
    length = float(np.sqrt(query @ query))
    low, high = bounds(tree, np.zeros(1, np.int64), query, length)
    heap, verified = [(-high[0], low[0], 0)], 0
    while heap:
        high, low, node = heapq.heappop(heap)
        if not wanted(np.array([low]), np.array([-high]))[0]:
            continue
        a, b = tree.own[node]
        if b > a:
            verified += b - a
            visit(np.arange(a, b), exact_products(tree.points[a:b], query, tree.reach, length))
        a, b = tree.below[node]
        if b > a:
            nodes = np.arange(a, b)
            low, high = bounds(tree, nodes, query, length)
            for i in np.flatnonzero(wanted(low, high)):
                heapq.heappush(heap, (-high[i], low[i], int(nodes[i])))
    return verified
