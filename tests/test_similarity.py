import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import blocks, similarity
from gapweave.plans import recommend


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    courses, skills = rng.normal(size=(300, 8)).round(3), rng.normal(size=(12, 8)).round(3)
    courses[7] = 0.0
    courses[200] = courses[100]
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(courses)], "_id bigint, vector array<float>")
    s = spark.createDataFrame(
        [(i, f"s{i}", [float(x) for x in v]) for i, v in enumerate(skills)], "skill_pos int, skill string, vector array<double>"
    )
    courses = courses.astype(np.float32).astype(np.float64)
    norms = np.linalg.norm(courses, axis=1, keepdims=True)
    unit = np.divide(courses, norms, out=np.zeros_like(courses), where=norms > 0)
    cos = unit @ (skills / np.linalg.norm(skills, axis=1, keepdims=True)).T
    return c.repartition(5), s, cos


@pytest.fixture(params=["broadcast", "grid"])
def way(request, monkeypatch):
    if request.param == "grid":
        monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 5)
        monkeypatch.setattr(blocks, "GRID_LEFT_ROWS", 64)
    monkeypatch.setattr(blocks, "CELLS_PER_STEP", 200)
    return request.param


def brute_top(cos, k):
    out = set()
    for j in range(cos.shape[1]):
        scores = np.round((1 + cos[:, j]) / 2, 6)
        for rank, i in enumerate(np.lexsort((np.arange(len(scores)), -scores))[:k], 1):
            out.add((f"s{j}", int(i), float(scores[i]), rank))
    return out


def test_knn_equals_brute_force(data, way):
    courses, skills, cos = data
    got = {(r.skill, r._id, r.score, r["rank"]) for r in similarity.knn(courses, skills, k=20).collect()}
    assert got == brute_top(cos, 20)


def test_approximate_search(data, way):
    courses, skills, cos = data
    indexed, centres = similarity.build_index(courses.where("_id <> 7"), lists=6)
    cos = np.delete(cos, 7, axis=0)
    ids = np.delete(np.arange(300), 7)
    exact = {(s, int(ids[i]), x, r) for s, i, x, r in brute_top(cos, 20)}
    everywhere = similarity.knn_approx(indexed, centres, skills, k=20, probes=6).collect()
    assert {(r.skill, r._id, r.score, r["rank"]) for r in everywhere} == exact
    some = {(r.skill, r._id) for r in similarity.knn_approx(indexed, centres, skills, k=20, probes=3).collect()}
    assert len(some & {e[:2] for e in exact}) > 0.8 * len(exact) and len(some) == len(exact)


def test_knn_with_few_courses_and_nulls(spark, data):
    few = spark.createDataFrame([(1, [1.0] * 8), (2, None)], "_id bigint, vector array<float>")
    assert similarity.knn(few, data[1], k=50).count() == 12
    assert similarity.knn(few.where("_id = 2"), data[1]).count() == 0
    assert similarity.knn(data[0], data[1].where("skill = 'none'")).count() == 0


def test_matrix_and_wide(spark, data, tmp_path):
    courses, skills, cos = data
    matrix = similarity.similarity_matrix(courses, skills)
    for r in matrix.collect():
        assert np.allclose(r.similarities, np.round(cos[r._id], 6), atol=1e-9)
    wide = similarity.similarity_wide(matrix, [f"s{i}" for i in range(12)])
    assert wide.columns == ["_id"] + [f"s{i}" for i in range(12)] and wide.count() == 300
    path = similarity.write_wide(wide, str(tmp_path / "wide"))
    assert spark.read.option("header", True).csv(path).columns == wide.columns


@pytest.mark.parametrize("tile", [2, 4096])
def test_wide_columns_keep_their_skill(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    courses = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "_id long, vector array<double>")
    skills = [(0, "a", [1.0, 0.0]), (1, "b", None), (2, "c", [0.0, 1.0]), (3, "d", [1.0, 0.0]), (4, "e", None)]
    matrix = similarity.similarity_matrix(courses, spark.createDataFrame(skills, "skill_pos long, skill string, vector array<double>"))
    wide = similarity.similarity_wide(matrix, ["a", "b", "c", "d", "e"]).orderBy("_id").collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, None, 0.0, 1.0, None), (2, 0.0, None, 1.0, 0.0, None)]


def test_right_side_is_computed_once(spark, data):
    courses, _, _ = data
    count = spark.sparkContext.accumulator(0)

    def encoded(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    skills = spark.createDataFrame([(f"s{i}", [float(i == k) for k in range(len(courses.first().vector))]) for i in range(3)], "skill string, vector array<double>")
    similarity.knn(courses, skills.mapInArrow(encoded, skills.schema), 2).collect()
    assert count.value == 3


def test_a_nan_score_does_not_win(spark):
    from gapweave.operators.ranking import best_per_group

    rows = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 0.5), (1, 3, None)], "g int, _id long, score double")
    assert [r._id for r in best_per_group(rows, ["g"], "score", "_id").collect()] == [2]


def test_matrix_in_tiles(data, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 5)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 6)
    courses, skills, cos = data
    rows = similarity.similarity_matrix(courses, skills).collect()
    assert len(rows) == 900
    for r in rows:
        assert np.allclose(r.similarities, np.round(cos[r._id], 6)[r.tile * 5 : r.tile * 5 + 5], atol=1e-9)


def test_threshold(data, way):
    courses, skills, cos = data
    got = {(r.skill, r._id) for r in similarity.above_threshold(courses, skills, 0.3).collect()}
    assert got == {(f"s{j}", i) for i, j in zip(*np.nonzero(np.round(cos, 6) > 0.3))}


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2**-0.5, 0.0])


def test_unknown_mode(data):
    with pytest.raises(ValueError):
        similarity.knn(data[0], data[1], score_mode="dot")


def test_search_plan_has_no_cross_join_and_limits_before_the_shuffle(data):
    plan = similarity.knn(data[0], data[1])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


CATALOG = "_id bigint, name string, provider string, duration_hrs double, avg_rating double, language string, level string, description string"


def course(i, hours=10.0, rating=4.5, language="English"):
    return (i, f"c{i}", "edX", hours, rating, language, "x", None)


def test_pref_filter_edges(spark):
    rows = [
        course(1, hours=1.0), course(2, hours=40.0), course(3, hours=0.0), course(4, hours=40.5), course(5, rating=4.0),
        course(6, rating=3.99), course(7, rating=None), course(8, language="ENGLISH"), course(9, language=None),
        course(10, language="French"), course(11, hours=None),
    ]
    got = recommend.pref_filter(spark.createDataFrame(rows, CATALOG))
    assert sorted(r._id for r in got.collect()) == [1, 2, 5, 8]


@pytest.mark.parametrize("small", [True, False])
def test_union_first_and_max(spark, small):
    requests = spark.createDataFrame([("a", 0, "s0"), ("a", 1, "s1"), ("b", 0, "s1")], "request_id string, skill_pos int, skill string")
    hits = spark.createDataFrame([("s0", 1, 0.6), ("s1", 1, 0.9), ("s1", 2, 0.7)], "skill string, _id bigint, score double")
    first = {(r.request_id, r._id): r.score for r in recommend.union_hits(requests, hits, small=small).collect()}
    assert first == {("a", 1): 0.6, ("a", 2): 0.7, ("b", 1): 0.9, ("b", 2): 0.7}
    best = {(r.request_id, r._id): r.score for r in recommend.union_hits(requests, hits, "max", small).collect()}
    assert best[("a", 1)] == 0.9
    with pytest.raises(ValueError):
        recommend.union_hits(requests, hits, "last")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_recommend(spark, limit, monkeypatch):
    monkeypatch.setattr(recommend, "MAX_BROADCAST_HITS", limit)
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.9, 0.1])], "_id bigint, vector array<float>"
    )
    skills = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "skill string, vector array<float>")
    requests = spark.createDataFrame([("r", 0, "x"), ("r", 1, "y"), ("q", 0, "y")], "request_id string, skill_pos int, skill string")
    catalog = spark.createDataFrame([course(1), course(2), course(3), course(4, hours=100.0)], CATALOG)

    def ids(**options):
        out = recommend.best_first(recommend.recommend(requests, skills, catalog, vectors, **options))
        return [(r.request_id, r._id, r.score, r.weighted_score) for r in out.collect()]

    # Course 2 is at exactly .5 for skill x, the first to hit it, so request r loses it.
    assert ids() == [("q", 2, 1.0, 0.5), ("r", 1, 1.0, 0.5)]
    assert ids(on_duplicate="max") == [("q", 2, 1.0, 0.5), ("r", 1, 1.0, 0.5), ("r", 2, 1.0, 0.5)]
    # Preferences come after the search: course 4 takes the only place and then fails them.
    assert [r[:2] for r in ids(k=1, preferences={"max_duration": 5.0})] == []
    assert ids(k=1, prefilter=True, preferences={"language": "english"}) == [("q", 2, 1.0, 0.5), ("r", 1, 1.0, 0.5), ("r", 2, 1.0, 0.5)]
    top = recommend.recommend(requests, skills, catalog, vectors, on_duplicate="max", top_n=1).collect()
    assert sorted((r.request_id, r._id, r["rank"]) for r in top) == [("q", 2, 1), ("r", 1, 1)]


def test_vectors_of_unequal_length_are_an_error():
    import pyarrow as pa

    from gapweave.operators.blocks import to_matrix

    with pytest.raises(ValueError):
        to_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]))
