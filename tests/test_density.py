"""Density clusters without comparing all pairs: exact against plain numpy, on every way the comparison takes."""

import numpy as np
import pytest

from gapweave.operators import blocks, clustering, forests, pivots

SCHEMA = "id long, vector array<double>"


def plain(rows, eps, least):
    """Sorted (id, cluster) of rows (id, vector) by a search over all pairs; a row without a vector is noise."""
    held = [(i, v) for i, v in rows if v is not None]
    unit = blocks.unit_rows(np.array([v for _, v in held], np.float64))
    near = np.round(1.0 - unit @ unit.T, 9) <= eps
    ids = [i for i, _ in held]
    core = near.sum(axis=1) >= least
    core &= np.array([i is not None for i in ids])
    label = {}
    for start in sorted(np.flatnonzero(core), key=lambda n: ids[n]):
        if start not in label:
            stack = [start]
            while stack:
                at = stack.pop()
                if at not in label:
                    label[at] = ids[start]
                    stack += [n for n in np.flatnonzero(near[at] & core) if n not in label]
    for n in np.flatnonzero(~core):
        met = [label[m] for m in np.flatnonzero(near[n] & core)]
        if met and ids[n] is not None:
            label[n] = min(met)
    number = {x: k for k, x in enumerate(sorted(set(label.values())))}
    cluster = {ids[n]: number[x] for n, x in label.items()}
    return sorted(((i, cluster.get(i, -1)) for i, _ in rows), key=str)


def found(spark, rows, eps, least):
    got = clustering.dbscan(spark.createDataFrame(rows, SCHEMA).repartition(3), eps, least).collect()
    return sorted(((r.id, r.cluster) for r in got), key=str)


def mixed(seed=1):
    """One large cluster, some small ones, scattered points, copies, and rows without id, vector or direction."""
    random = np.random.default_rng(seed)
    middle = np.eye(12)[:8]
    groups = random.choice(8, 500, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
    points = np.concatenate([middle[groups] + 0.09 * random.normal(size=(500, 12)), random.normal(size=(150, 12))])
    points[20:30] = points[19]
    points[40] = 0.0
    rows = [(int(i), p.tolist()) for i, p in zip(random.permutation(900)[: len(points)], points, strict=True)]
    return [*rows, (901, None), (None, rows[0][1]), (None, None)]


@pytest.mark.parametrize("eps, least", [(0.05, 2), (0.08, 6), (0.25, 4), (1.1, 3)])
@pytest.mark.parametrize("most", [40, 250, None])
def test_equals_a_search_over_all_pairs(spark, monkeypatch, eps, least, most):
    if most:
        monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", most)
        monkeypatch.setattr(pivots, "BLOCK_ROWS", most)
        monkeypatch.setattr(forests, "FEW_EDGES", 30)
    rows = mixed()
    assert found(spark, rows, eps, least) == plain(rows, eps, least)


def test_few_pairs_are_compared_where_pivots_cannot_tell_blocks_apart(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 100)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 100)
    compared = []

    def counted(real):
        def run(left, right, *args, **named):
            compared.append(left.count() * right.num_rows if hasattr(right, "num_rows") else left.count() * right.count())
            return real(left, right, *args, **named)

        return run

    for name in ("against_all", "against_near"):
        monkeypatch.setattr(clustering, name, counted(getattr(clustering, name)))
    points = np.random.default_rng(2).normal(size=(1_500, 24))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    assert found(spark, rows, 0.6, 2) == plain(rows, 0.6, 2)
    assert 0 < sum(compared) <= 0.5 * len(rows) ** 2


def test_repeated_keys_give_the_same_rows_on_both_ways(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(int(i), p.tolist()) for i, p in zip(random.integers(0, 150, 200), np.repeat(random.normal(size=(100, 6)), 2, axis=0), strict=True)]
    want = found(spark, rows, 0.1, 3)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 30)
    assert found(spark, rows, 0.1, 3) == want and len({c for _, c in want}) > 3


@pytest.mark.parametrize("few", [4, 1 << 18])
def test_roots_of_edges(spark, monkeypatch, few):
    monkeypatch.setattr(forests, "FEW_EDGES", few)
    random = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, 500)]
    parent = {n: n for e in edges for n in e}
    for _ in parent:  # the least label spreads along the edges
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.label: r.root for r in forests.roots(spark.createDataFrame(edges, "label long, other long")).collect()}
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert set(got) == set(parent) - alone
    classes = {}
    for n in got:
        classes.setdefault(parent[n], set()).add(got[n])
    assert all(len(c) == 1 for c in classes.values()) and len({*map(frozenset, classes.values())}) == len(classes)


@pytest.mark.parametrize("eps, digits", [(0.6, 9), (0.0, 9), (0.05, 3), (1.0, 9), (1.5, 6)])
def test_the_least_product_that_is_near(eps, digits):
    least = clustering._least_dot(eps, digits)
    near = lambda dot: np.round(1.0 - dot, digits) <= eps
    assert near(np.float64(least)) and not near(np.nextafter(least, -5.0))
    assert clustering._least_dot(9.0, 9) == -np.inf and clustering._least_dot(-9.0, 9) == np.inf
