import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import blocks, clustering, lloyd
from tests.test_clustering import blobs, frame


def brute_linear(x, labels):
    gaps = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        others = [gaps[i][labels == c].mean() for c in set(labels) if c != labels[i]]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = gaps[i][own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b))
    return out


@pytest.mark.parametrize("most", [8192, 3])
def test_linear_silhouettes_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", most)
    monkeypatch.setattr(lloyd, "HELD", 4)
    rows = [(i, v, [i % 3 if i < 59 else 9, i // 20, 0]) for i, v in blobs()]
    points = frame(spark, [*rows, (99, None, None)], ", labels array<int>").repartition(3)
    got = {(r.id, r.clustering): r.silhouette for r in lloyd.linear_silhouettes(points).collect()}
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    assert len(got) == 3 * 60
    for c in range(3):
        want = brute_linear(x, np.array([r[2][c] for r in rows]))
        assert [got[i, c] for i in range(60)] == pytest.approx(want, abs=1e-9)


def test_fits_find_the_blobs_in_any_partitioning(spark):
    points = frame(spark, blobs(1, 400, 7))
    one = lloyd.fits(points.coalesce(1), [2, 5, 7], 3)
    many = lloyd.fits(points.repartition(5), [2, 5, 7], 3)
    assert all(np.array_equal(one[k], many[k]) for k in one) and [len(one[k]) for k in one] == [2, 5, 7]
    found = lloyd.labelled(points, [one[7]]).select("id", F.col("labels")[0].alias("c")).collect()
    assert len({(r.id % 7, r.c) for r in found}) == 7


def test_fits_are_no_worse_than_restarted_lloyd(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(600, 4)).round(3)
    centres = lloyd.fits(frame(spark, [(i, v) for i, v in enumerate(x.tolist())]), [6])[6]
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1).min(axis=1).sum()
    costs = []
    for _ in range(10):
        c = x[random.choice(600, 6, replace=False)]
        for _ in range(100):
            near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) for j in range(6)])
        costs.append(cost(c))
    assert cost(centres) <= 1.05 * np.median(costs)


def test_nearest_decides_ties_alike_in_any_batch():
    random = np.random.default_rng(0)
    centres = random.normal(size=(6, 9))
    points = np.vstack([(centres[i] + centres[j]) / 2 for i in range(6) for j in range(6)] * 3)
    whole = lloyd.nearest(points, centres)
    assert whole.tolist() == [lloyd.nearest(p[None], centres)[0] for p in points]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(i, [1.0, 1.0]) for i in range(12)]])
def test_awkward_points(spark, rows):
    points = frame(spark, rows)
    centres = lloyd.fits(points, [2, 3])
    assert {len(c) for c in centres.values()} == {1 if len(rows) > 1 else 0}
    assert {s for _, s in clustering.sweep(points, 3)} <= {0.0}


def test_jobs_do_not_grow_with_the_clusterings(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "ROUNDS", 3)
    monkeypatch.setattr(lloyd, "TOLERANCE", -1.0)
    points, context = frame(spark, blobs(3, 200, 5)), spark.sparkContext
    jobs = []
    for most in (3, 10):
        context.setJobGroup(f"sweep-{most}", "")
        with pytest.warns(UserWarning, match="still moved"):
            clustering.sweep(points, most)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"sweep-{most}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
