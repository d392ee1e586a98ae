"""Bottom-up clustering against plain Ward joining of all pairs."""

import numpy as np
import pytest

from gapweave.operators import ward
from tests.test_clustering import blobs, frame


def plain(rows, k):
    """Joins the two clusters with the least rise of the sum of squares until k are left."""
    parts = [[i] for i in range(len(rows))]
    x = np.array([r[1] for r in rows], np.float32).astype(float)

    def spread(part):
        return ((x[part] - x[part].mean(axis=0)) ** 2).sum()

    while len(parts) > k:
        rise = [(spread(p + q) - spread(p) - spread(q), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j]
        _, i, j = min(rise)
        parts[i] += parts.pop(j)
    return {frozenset(rows[i][0] for i in part) for part in parts}


def parted(found):
    return {frozenset(r.id for r in found if r.cluster == c) for c in {r.cluster for r in found}}


@pytest.mark.parametrize("k", [1, 3, 6])
def test_plain_ward_where_every_point_is_a_leaf(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in rng.permutation(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    found = ward.ward(frame(spark, rows).repartition(3), k).collect()
    assert len(found) == 45 and parted(found) == plain(rows, k)
    order = sorted({r.cluster: min(s.id for s in found if s.cluster == r.cluster) for r in found}.items())
    assert [c for c, _ in order] == list(range(k)) and [i for _, i in order] == sorted(i for _, i in order)


def test_more_points_than_leaves(spark):
    rows = blobs(3, 2_000, 4)
    leaves = ward.leaves_of(frame(spark, rows).repartition(5), 32).collect()
    assert 4 <= len(leaves) <= 32 and sum(r["count"] for r in leaves) == 2_000
    total = np.sum([r.total for r in leaves], axis=0)
    assert np.allclose(total, np.sum([np.array(r[1], np.float32) for r in rows], axis=0), atol=1e-3)
    found = ward.ward(frame(spark, rows).repartition(5), 4, limit=32).collect()
    assert len(found) == 2_000 and parted(found) == {frozenset(range(c, 2_000, 4)) for c in range(4)}


def test_few_equal_and_unusable_points(spark):
    assert ward.ward(frame(spark, []), 3).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0])]
    found = {r.id: r.cluster for r in ward.ward(frame(spark, rows), 1).collect()}
    assert found == {1: 0, 2: 0}
    # equal points beyond the limit are one leaf
    same = frame(spark, [(i, [3.0, 4.0]) for i in range(200)])
    assert {r.cluster for r in ward.ward(same, 5, limit=8).collect()} == {0}


def test_chains_end_on_ties():
    grid = np.array([(x, y) for x in range(12) for y in range(12)], float)
    found = ward.join_leaves(np.ones(len(grid), int), grid, 7)
    assert set(found.tolist()) == set(range(7))
