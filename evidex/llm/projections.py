"""Approximate nearest neighbours over low-dimensional stable projections.

Inner products become distances by one added component (the largest norm's complement).  Rows are
projected by a fixed 2-stable (Gaussian) matrix; a shard indexes its projected rows in a kd-tree.
A query takes leaves by their distance to its projection and verifies the rows in order of
projected distance, a few at a time, with the original vectors.  The squared projected distance of
a row at distance d is d^2 times a chi-square variable, so the search stops once a row as near as
the k-th found would have shown itself already with probability ``sure``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evidex.llm.vectors import rows_of, search, top_rows

DIMS, LEAF, SURE, SEED = 12, 64, 0.97, 20


def chi_square(x: float, dims: int) -> float:
    """Distribution function of the chi-square with an even number of dimensions."""
    half = x / 2
    if half > 700:
        return 1.0
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def needed_ratio(sure: float, dims: int) -> float:
    """Where the distribution function reaches ``sure``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < sure else (low, mid)
    return high


def projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED + width).normal(size=(width + 1, dims))


class Tree:
    """kd-tree with boxes of its leaves; rows are kept in leaf order."""

    def __init__(self, points: np.ndarray):
        order, bounds = np.arange(len(points)), []
        todo = [(0, len(points))]
        while todo:
            a, z = todo.pop()
            if z - a <= LEAF:
                bounds.append((a, z))
                continue
            own = points[order[a:z]]
            axis, mid = int(np.argmax(own.max(0) - own.min(0))), (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, z)]
        bounds.sort()
        self.order, self.points, self.starts = order, points[order], np.array([a for a, _ in bounds] + [len(points)])
        self.low = np.array([self.points[a:z].min(0) for a, z in bounds])
        self.high = np.array([self.points[a:z].max(0) for a, z in bounds])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


class Shard:
    def __init__(self, ids: np.ndarray, matrix: np.ndarray, norm: float, dims: int):
        rest = np.sqrt(np.maximum(norm**2 - (matrix**2).sum(1), 0))
        self.lift = projection(matrix.shape[1], dims)
        self.tree = Tree(np.hstack([matrix, rest[:, None]]) @ self.lift)
        self.ids, self.matrix, self.norm = ids[self.tree.order], matrix[self.tree.order], norm


def search_shard(shard: Shard, query_id: int, query: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in leaf order) and scores of the k nearest rows found."""
    tree = shard.tree
    # The query has the largest norm too, so that distance orders as the inner product.
    size = math.sqrt(float(query @ query))
    q = query * (shard.norm / size)
    low = np.append(q, 0.0) @ shard.lift
    leaves = tree.leaf_distances(low)
    order = np.argsort(leaves, kind="stable")
    near, scores = np.empty(0, np.int64), np.empty(0)
    waiting_rows, waiting_gaps = np.empty(0, np.int64), np.empty(0)
    at, group = 0, max(4, len(order) // 16)
    while at < len(order) or len(waiting_rows):
        end = min(len(order), at + group)
        if at < end:
            rows = np.concatenate([np.arange(tree.starts[j], tree.starts[j + 1]) for j in order[at:end]])
            gaps = ((tree.points[rows] - low) ** 2).sum(1)
            waiting_rows, waiting_gaps = np.concatenate([waiting_rows, rows]), np.concatenate([waiting_gaps, gaps])
            at = end
        radius = leaves[order[at]] if at < len(order) else np.inf
        ready = waiting_gaps <= radius  # every row up to this projected distance has been met
        if len(scores) >= k:  # only those that the test still asks for
            ready &= waiting_gaps <= bound
        rows = waiting_rows[ready]
        waiting_rows, waiting_gaps = waiting_rows[~ready], waiting_gaps[~ready]
        rows = rows[shard.ids[rows] != query_id]
        got = shard.matrix[rows] @ q
        near, scores = np.concatenate([near, rows]), np.concatenate([scores, got])
        if len(scores) > 4 * k:
            keep = np.argpartition(-scores, 2 * k)[: 2 * k]
            edge = np.partition(-scores, k - 1)[k - 1]
            keep = np.union1d(keep, np.flatnonzero(-scores <= edge + 1e-9))
            near, scores = near[keep], scores[keep]
        if len(scores) >= k:
            kth = np.partition(-scores, k - 1)[k - 1]
            bound = ratio * max(0.0, 2 * shard.norm**2 + 2 * kth)
            if radius >= bound:
                late = waiting_gaps <= bound
                rows = waiting_rows[late]
                rows = rows[shard.ids[rows] != query_id]
                near, scores = np.concatenate([near, rows]), np.concatenate([scores, shard.matrix[rows] @ q])
                break
    if len(scores) > k:
        edge = np.partition(-scores, k - 1)[k - 1]
        near = near[-scores <= edge + 1e-9 * max(1.0, shard.norm**2)]
    # The stated measure, added up alike for equal rows.
    exact = (shard.matrix[near] * query).sum(1)
    best = top_rows(exact, shard.ids[near], k)
    return near[best], exact[best]


def nearest(table: DataFrame, every: int = 20, k: int = 20, dims: int = DIMS, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, in double precision.

    Vectors null, empty, zero or holding null or non-finite components take no part, and rows
    without an id neither."""
    rows = rows_of(table).where(F.exists("embedding", lambda x: x != 0))
    norm = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    norm *= 1 + 1e-12
    ratio = needed_ratio(sure, dims)

    def start():
        def step(shard, queries):
            index = Shard(*shard, norm, dims)
            found = [[], [], []]
            for q, vector in zip(*queries):
                places, scores = search_shard(index, q, vector, k, ratio)
                found[0].append(np.full(len(places), q, np.int64))
                found[1].append(index.ids[places])
                found[2].append(scores)
            return [np.concatenate(f) if f else np.empty(0) for f in found]

        return step

    return search(rows, every, k, start, "double")
