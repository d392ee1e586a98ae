"""Bottom-up clustering: leaves of alike points gathered by the tasks, joined by Ward's criterion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.blocks import to_matrix
from gapweave.operators.lineage import checkpointed

#: Leaves that a task keeps, and that are joined at the end.
LEAVES = 2_048
#: Leaves that are merged in one task, as a multiple of LEAVES.
FAN_IN = 8
#: Rows whose distances to all leaves are held at once.
ROWS = 1_024


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one matrix to all of the other; never below zero."""
    found = (points**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * points @ centers.T
    return np.maximum(found, 0)


class Leaves:
    """At most ``limit`` sums of near points; the radius in which points are near grows when they become too many.

    While the points fit, only equal ones are summed.
    """

    def __init__(self, limit: int):
        self.limit, self.reach = limit, 0.0
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.total = None

    def add(self, first: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        for low in range(0, len(first), ROWS):
            part = slice(low, low + ROWS)
            self._add(first[part], count[part], total[part])

    def _add(self, first, count, total) -> None:
        if self.total is None:
            self.total = np.zeros((0, total.shape[1]))
        if len(self.first) and self.reach:  # those near a leaf join the nearest one
            distance = squared(total / count[:, None], self.total / self.count[:, None])
            nearest = distance.argmin(axis=1)
            near = distance[np.arange(len(nearest)), nearest] <= self.reach
            np.add.at(self.total, nearest[near], total[near])
            np.add.at(self.count, nearest[near], count[near])
            np.minimum.at(self.first, nearest[near], first[near])
            first, count, total = first[~near], count[~near], total[~near]
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])
        self.total = np.concatenate([self.total, total])
        while len(self.first) > self.limit:
            self._condense()

    def _condense(self) -> None:
        """Sum equal leaves, and then, until half of them or fewer are left, near ones within a growing radius."""
        self._sum(np.unique(self.total / self.count[:, None], axis=0, return_inverse=True)[1].ravel())
        if len(self.first) <= self.limit:
            return
        while len(self.first) > max(self.limit // 2, 1):
            middle = self.total / self.count[:, None]
            some = squared(middle[:: -(-len(middle) // 256)], middle)
            gaps = np.sort(some, axis=1)[:, 1]
            self.reach = max(1.1 * self.reach, float(np.median(gaps)), 1e-12 * float((middle**2).max()))
            group = np.full(len(middle), -1)
            for r in range(len(middle)):
                if group[r] < 0:
                    free = np.flatnonzero(group < 0)
                    group[free[squared(middle[r : r + 1], middle[free])[0] <= self.reach]] = r
                    group[r] = r
            self._sum(np.unique(group, return_inverse=True)[1])

    def _sum(self, group: np.ndarray) -> None:
        parts = int(group.max()) + 1
        total, count = np.zeros((parts, self.total.shape[1])), np.zeros(parts, np.int64)
        first = np.full(parts, np.iinfo(np.int64).max)
        np.add.at(total, group, self.total)
        np.add.at(count, group, self.count)
        np.minimum.at(first, group, self.first)
        self.first, self.count, self.total = first, count, total

    def batch(self) -> pa.RecordBatch:
        total = np.zeros((0, 0)) if self.total is None else self.total
        return pa.RecordBatch.from_arrays(
            [pa.array(self.first), pa.array(self.count), pa.array(list(total), pa.list_(pa.float64()))], names=["first", "count", "total"]
        )


LEAF = "first long, count long, total array<double>"


def join_leaves(count: np.ndarray, middle: np.ndarray, k: int) -> np.ndarray:
    """The cluster (0 to k - 1) of every leaf, by Ward's criterion along chains of nearest neighbours.

    Joining clusters of a and b points costs a b / (a + b) times the squared distance of their means.
    Of equally near ones the one before in the chain is taken, then the first.
    """
    size, mean = count.astype(float).copy(), middle.copy()
    norm = (mean**2).sum(axis=1)
    alive = np.ones(len(size), bool)
    merges, chain, links = [], [], []
    for _ in range(len(size) - 1):
        while True:
            if not chain:
                chain = [int(np.flatnonzero(alive)[0])]
            a = chain[-1]
            cost = np.maximum(norm + norm[a] - 2 * mean @ mean[a], 0) * (size * size[a] / (size + size[a]))
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            if links and cost[b] >= links[-1]:  # costs fall along the chain, so it ends whatever is rounded
                b = chain[-2]
                break
            chain.append(b)
            links.append(cost[b])
        height = links[-1]
        chain = chain[:-2]
        links = links[: max(len(chain) - 1, 0)]
        low, high = min(a, b), max(a, b)
        merges.append((float(height), len(merges), low, high))
        mean[low] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[low] += size[high]
        norm[low] = mean[low] @ mean[low]
        alive[high] = False
    # the cheapest joins are those of the tree below its k highest branches
    parent = np.arange(len(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, _, a, b in sorted(merges)[: max(len(size) - k, 0)]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.unique([root(x) for x in range(len(size))], return_inverse=True)[1]


def _gathered(table: pa.Table, limit: int) -> Leaves:
    leaves = Leaves(limit)
    if table.num_rows:
        order = np.argsort(table["first"].to_numpy(), kind="stable")
        total = np.array(table["total"].to_pylist(), float)
        leaves.add(table["first"].to_numpy()[order], table["count"].to_numpy()[order], total[order])
    return leaves


def leaves_of(points: DataFrame, limit: int = LEAVES) -> DataFrame:
    """``first`` (smallest id), ``count`` and ``total`` of at most limit groups of near points of (id, vector)."""

    def gather(batches):
        leaves = Leaves(limit)
        for batch in batches:
            if batch.num_rows:
                leaves.add(batch.column(0).to_numpy(), np.ones(batch.num_rows, np.int64), to_matrix(batch.column(1)).astype(float))
        if len(leaves.first):
            yield leaves.batch()

    found = checkpointed(points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(gather, LEAF))
    while (rows := found.count()) > limit:
        groups = -(-rows // (FAN_IN * limit))
        part = F.pmod(F.xxhash64("first"), F.lit(groups))
        merge = lambda table: pa.Table.from_batches([_gathered(table, limit).batch()])
        found = checkpointed(found.groupBy(part.alias("part")).applyInArrow(merge, LEAF))
    return found


def ward(points: DataFrame, k: int = 5, limit: int = LEAVES) -> DataFrame:
    """(id, cluster) of the points of (id, vector) in k clusters, or fewer if there are fewer points.

    Every task sums near points to leaves, leaves of several tasks are summed again until at
    most limit are left, and one task joins these by Ward's criterion. Each point gets the
    cluster of the nearest leaf. Up to limit different points every one is a leaf, and the
    result is plain Ward clustering; beyond that it depends on how the points lie in tasks.
    Clusters are numbered by their smallest id. Points without an id or with
    a vector that is null or holds nulls or NaN take no part.
    """
    points = points.where(F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))

    def join(table: pa.Table) -> pa.Table:
        leaves = _gathered(table, limit)
        middle = leaves.total / leaves.count[:, None]
        cluster = join_leaves(leaves.count, middle, max(k, 1))
        return pa.table({"cluster": pa.array(cluster.astype(np.int32)), "middle": pa.array(list(middle), pa.list_(pa.float64()))})

    joined = leaves_of(points, limit).groupBy(F.lit(0).alias("all")).applyInArrow(join, "cluster int, middle array<double>").collect()
    label = np.array([r.cluster for r in joined], np.int32)
    middle = np.array([r.middle for r in joined], float)

    def place(batches):
        for batch in batches:
            rows = to_matrix(batch.column(1)).astype(float) if batch.num_rows else np.zeros((0, 1))
            nearest = [squared(rows[low : low + ROWS], middle).argmin(axis=1) for low in range(0, len(rows), ROWS)]
            found = label[np.concatenate(nearest)] if nearest else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["id", "cluster"])

    if not joined:
        return points.select(F.col("id").cast("long"), F.lit(0).alias("cluster"))
    placed = points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(place, "id long, cluster int")
    placed = checkpointed(placed)
    firsts = placed.groupBy("cluster").agg(F.min("id").alias("least"))
    number = {r.cluster: i for i, r in enumerate(sorted(firsts.collect(), key=lambda r: r.least))}
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    return placed.select("id", numbers[F.col("cluster")].alias("cluster"))
