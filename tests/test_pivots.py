"""Density clusters over blocks of points that can hold neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import blocks, clustering, pivots


def clustered(rows, width=16, groups=24, seed=3):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(groups, width))
    points = middle[random.integers(0, groups, rows)] + 0.12 * random.normal(size=(rows, width))
    points[5] = 0.0
    points[100:140] = points[99]  # copies
    return points


def frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")


def test_few_pairs_are_compared_and_no_neighbour_is_lost(spark):
    points = clustered(3_000)
    theta = pivots.radius(0.05, 9)
    found = pivots.blocked(frame(spark, points), theta, len(points), block_rows=64)
    assert found.compared() <= 0.2 * len(points) ** 2
    block = {r.id: r.block for r in found.members.collect()}
    unit = blocks.unit_rows(points)
    near = np.round(1.0 - unit @ unit.T, 9) <= 0.05
    pairs = set(found.pairs)
    assert all((block[i], block[j]) in pairs for i, j in zip(*np.nonzero(near), strict=True))
    assert max(found.sizes.values()) <= 3 * 64


@pytest.mark.parametrize("eps", [0.02, 0.05])
def test_same_clusters_as_all_pairs(spark, monkeypatch, eps):
    points = frame(spark, clustered(700))
    plain = {r.id: r.cluster for r in clustering.dbscan(points, eps, 3).collect()}
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 100)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 100)
    pruned = {r.id: r.cluster for r in clustering.dbscan(points, eps, 3).collect()}
    assert pruned == plain and len(set(plain.values())) > 5


def test_points_without_a_direction(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 2)
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, vector array<double>")
    assert {r.id: r.cluster for r in clustering.dbscan(points, 0.5, 2).collect()} == {1: -1, 2: -1, 3: -1, 4: -1}
    mixed = points.unionByName(spark.createDataFrame([(5, [1.0, 0.0]), (6, [1.0, 0.01])], "id long, vector array<double>"))
    assert {r.id: r.cluster for r in clustering.dbscan(mixed, 0.5, 2).collect()} == {1: -1, 2: -1, 3: -1, 4: -1, 5: 0, 6: 0}
    assert clustering.dbscan(points.limit(0)).count() == 0


def test_a_row_is_sent_once_for_a_group_of_blocks(spark):
    import pyarrow as pa

    points = np.random.default_rng(4).normal(size=(1_500, 5))
    rows = frame(spark, points)
    found = pivots.blocked(rows, 0.9, len(points), block_rows=64)

    def seen(batches, right):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([right.num_rows] * batch.num_rows, pa.int64())], names=["id", "near"])

    met = pivots.against_near(rows, rows, seen, "id bigint, near bigint", found).collect()
    assert sum(r.near for r in met) == found.compared()  # partners only
    assert len(met) <= 16 * len(points) < sum(found.sizes[a] for a, _ in found.pairs)
