import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import blocks, clustering, dedup
from gapweave.operators.ranking import best_per_group

FEW = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id bigint, vector array<float>" + extra)


def blobs(seed=0, n=60, centres=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 6)) * 5
    return [(i, [float(x) for x in (middle[i % centres] + rng.normal(size=6)).round(4)]) for i in range(n)]


@pytest.fixture(params=["broadcast", "grid"])
def way(request, monkeypatch):
    if request.param == "grid":
        monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 13)
        monkeypatch.setattr(blocks, "GRID_LEFT_ROWS", 17)
    monkeypatch.setattr(blocks, "CELLS_PER_STEP", 100)


def brute_silhouette(rows):
    x = np.array([r[1] for r in rows])
    labels = np.array([r[2] for r in rows])
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i][own].sum() / (own.sum() - 1)
        b = min(gaps[i][labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_equals_brute_force(spark, way):
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 59 else 9) for i, v in blobs()]
    got = clustering.silhouette_exact(frame(spark, rows, ", cluster int").repartition(3)).first()[0]
    assert got == pytest.approx(brute_silhouette(rows), abs=1e-7)


def test_sweep_equals_single_fits(spark):
    points = frame(spark, blobs(5, 24, 3))
    scores = clustering.sweep(points, 4, fast=False)
    assert [k for k, _ in scores] == [2, 3, 4] and clustering.best_k(scores) == 3
    for k, score in scores[:2]:
        alone = clustering.silhouette_exact(clustering.kmeans(points, k, 0)).first()[0]
        assert score == pytest.approx(alone, abs=1e-9)
    assert [k for k, _ in clustering.sweep(points, 3, fast=True)] == [2, 3]
    assert clustering.sweep(frame(spark, FEW[:2])) == []


def brute_dbscan(rows, eps, least):
    x = np.array([np.float32(r[1]).astype(float) for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(1 - unit @ unit.T, 9) <= eps
    core = near.sum(1) >= least
    labels, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] == -1:
                labels[j] = number
                if core[j]:
                    stack += [int(m) for m in np.nonzero(near[j])[0] if labels[m] == -1]
        number += 1
    return {r[0]: int(c) for r, c in zip(rows, labels)}


@pytest.mark.parametrize("eps, least", [(0.05, 3), (0.15, 2), (0.0001, 2)])
def test_dbscan_equals_brute_force(spark, eps, least):
    rows = blobs(3, 80, 5)
    got = {r.id: r.cluster for r in clustering.dbscan(frame(spark, rows).repartition(3), eps, least).collect()}
    assert got == brute_dbscan(rows, eps, least)


def test_dbscan_over_a_chain_in_blocks(spark, way):
    angles = np.linspace(0, 2.0, 40)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(np.random.default_rng(0).permutation(angles))]
    rows.append((99, [0.0, -1.0]))
    got = {r.id: r.cluster for r in clustering.dbscan(frame(spark, rows), 0.002, 2).collect()}
    assert got.pop(99) == -1 and set(got.values()) == {0}


def test_dbscan_needs_few_rounds_for_a_chain_in_order(spark, monkeypatch):
    passes = []
    work = clustering._smallest_near
    monkeypatch.setattr(clustering, "_smallest_near", lambda *a: passes.append(1) or work(*a))
    angles = np.linspace(0, 3.0, 200)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    got = clustering.dbscan(frame(spark, rows), 0.0002, 2).collect()
    # the last round finds nothing to merge, and the border takes one pass
    assert {r.cluster for r in got} == {0} and len(got) == 200 and len(passes) <= int(np.ceil(np.log2(200))) + 2


def test_dbscan_merges_by_the_smallest_other_cluster(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.cos(a)), float(np.sin(a)), 0.1]) for i, a in zip(rng.permutation(300), rng.uniform(0, 6, 300), strict=True)]
    got = {r.id: r.cluster for r in clustering.dbscan(frame(spark, rows), 0.0004, 3).collect()}
    assert got == brute_dbscan(sorted(rows), 0.0004, 3)


def test_spectral_labels_points_without_a_neighbour(spark):
    points = frame(spark, [*blobs(), (500, None)])
    labels = {r.id: r.cluster for r in clustering.spectral(points, 3, neighbors=5).collect()}
    assert len(labels) == 61 and labels[500] == -1


@pytest.mark.parametrize("n", [0, 1, 3])
def test_kmeans_with_fewer_points_than_clusters(spark, n):
    got = clustering.kmeans(frame(spark, FEW[:n]), 10).collect()
    assert len(got) == n and len({r.cluster for r in got}) == n


def test_kmeans_of_equal_rows_and_stable_labels(spark):
    same = frame(spark, [(i, [1.0, 1.0]) for i in range(20)])
    assert {r.cluster for r in clustering.kmeans(same, 5).collect()} == {0}
    a = clustering.kmeans(frame(spark, blobs()), 4).collect()
    assert len({r.cluster for r in a}) == 4 and min((r.id, r.cluster) for r in a)[1] == 0


def test_hierarchical_and_spectral_label_every_point(spark):
    points = frame(spark, blobs())
    assert len({r.cluster for r in clustering.hierarchical(points, 4).collect()}) == 4
    labels = clustering.spectral(points, 3, neighbors=5).collect()
    assert sorted(r.id for r in labels) == list(range(60)) and {r.cluster for r in labels} <= {0, 1, 2}


def test_best_k_takes_the_first_best():
    assert clustering.best_k([(2, 0.1), (3, 0.5), (4, 0.5)]) == 3
    assert clustering.best_k([]) == 1


def test_cluster_skills_finds_the_blobs(spark):
    skills = frame(spark, blobs(5, 24, 3)).withColumn("skill", F.concat(F.lit("s"), F.col("id").cast("string")))
    got = clustering.cluster_skills(skills, max_clusters=4).collect()
    assert sorted(sorted(r.members) for r in got) == sorted(sorted(f"s{i}" for i in range(c, 24, 3)) for c in range(3))
    assert got[0].members == sorted(got[0].members, key=lambda s: int(s[1:]))


def test_member_lists_are_cut(spark):
    df = spark.createDataFrame([(0, i, f"m{i}") for i in range(25)], "cluster int, id bigint, member string")
    got = {r.part: r.members for r in clustering.member_lists(df, "member", "id", rows=10).collect()}
    assert got == {p: [f"m{i}" for i in range(p * 10, min(25, p * 10 + 10))] for p in range(3)}


def test_best_per_group_ties_go_to_the_smallest_id(spark):
    df = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.5), ("a", 3, 0.1), ("b", 9, 0.0)], "g string, _id bigint, s double")
    assert sorted(tuple(r) for r in best_per_group(df, ["g"], "s", "_id").collect()) == [("a", 1, 0.5), ("b", 9, 0.0)]


# --- near-duplicate removal ---------------------------------------------------


def recommended(spark, rows):
    return spark.createDataFrame(rows, "request_id string, _id bigint, vector array<float>, weighted_score double")


def test_dedup_keeps_the_best_of_each_cluster(spark):
    rows = [("a", i, v, i / 100) for i, v in blobs(1, 40, 4)]
    rows += [("b", i, v, 0.5) for i, v in FEW] + [("c", 1, [1.0, 2.0], 0.3)]
    df = recommended(spark, rows)
    out = dedup.deduplicate(df, num_clusters=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.request_id, []).append(r._id)
    assert sorted(by["a"]) == [36, 37, 38, 39] and sorted(by["b"]) == [1, 2, 3] and by["c"] == [1]
    labelled = dedup.cluster_requests(df, 4)
    assert labelled.count() == len(rows)
    best = {}
    for r in labelled.collect():
        key = (r.request_id, r.cluster)
        best[key] = max(best.get(key, (-1, 0)), (r.weighted_score, -r._id))
    assert {(r.request_id, r.cluster): (r.weighted_score, -r._id) for r in out} == best


def test_dedup_of_nothing_and_of_equal_rows(spark):
    assert dedup.deduplicate(recommended(spark, [])).count() == 0
    same = recommended(spark, [("a", i, [1.0, 1.0], float(i)) for i in range(30)])
    assert [r._id for r in dedup.deduplicate(same).collect()] == [29]


def test_dedup_cuts_a_large_request_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 64)
    monkeypatch.setattr(dedup, "KEPT", 16)
    monkeypatch.setattr(dedup, "MERGE", 4)
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(4, 5)) * 20
    rows = [("hot", i, [float(x) for x in middle[i % 4] + rng.normal(size=5)], i / 2000) for i in range(2000)]
    rows += [("cold", i, v, 0.1) for i, v in blobs(2, 12, 3)]
    labelled = dedup.cluster_requests(recommended(spark, rows), 4).collect()
    assert len(labelled) == 2012
    groups = {}
    for r in labelled:
        if r.request_id == "hot":
            groups.setdefault(r.cluster, set()).add(r._id % 4)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,), (3,)]


def test_dedup_has_one_answer_below_and_above_the_piece_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(r, i, [float(x) for x in rng.normal(size=6)], float(rng.random())) for r in "ab" for i in range(400)]
    rows += [("c", i, v, 0.1) for i, v in blobs(2, 12, 3)]
    df = recommended(spark, rows).repartition(3)
    found = []
    for piece in (8192, 100):
        monkeypatch.setattr(dedup, "PIECE", piece)
        found.append({(r.request_id, r._id, r.cluster) for r in dedup.deduplicate(df).collect()})
    assert found[0] == found[1] and sum(r == "a" for r, _, _ in found[0]) == 10


def test_same_result_in_any_partitioning(spark):
    rows = [("a", i, v, i / 100) for i, v in blobs(7, 50, 6)]
    df = recommended(spark, rows)
    a = {(r._id, r.cluster) for r in dedup.deduplicate(df.repartition(7), 5).collect()}
    b = {(r._id, r.cluster) for r in dedup.deduplicate(df.coalesce(1), 5).collect()}
    assert a == b
