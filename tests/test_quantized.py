"""Searches that read or send less: short codes with a second look, and score floors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import blocks, quantized, similarity
from tests.test_similarity import brute_top, data  # noqa: F401  a fixture


def clustered(spark, rows, width=64, skills=10, groups=120, seed=2):
    """Vectors around random directions, and skills near some of them."""
    random = np.random.default_rng(seed)
    middle = random.normal(size=(groups, width))
    courses = middle[random.integers(0, groups, rows)] + 0.5 * random.normal(size=(rows, width))
    wanted = middle[random.permutation(groups)[:skills]] + 0.2 * random.normal(size=(skills, width))
    import pandas as pd

    c = spark.createDataFrame(pd.DataFrame({"_id": np.arange(rows), "vector": list(courses.astype(np.float32))}), "_id bigint, vector array<float>")
    s = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(wanted)], "skill string, vector array<double>")
    return c.repartition(8, "_id"), s


@pytest.mark.parametrize("rows", [8_000, 16_000, 32_000])
def test_recall_and_bytes_read(spark, tmp_path, rows):
    courses, skills = clustered(spark, rows, skills=3, groups=rows // 250)
    codes = quantized.fit_codes(courses, lists=rows // 250)
    indexed = quantized.write_index(quantized.index(courses, codes), str(tmp_path / "index"))
    assert indexed.count() == rows
    found = quantized.search(indexed, codes, skills, probes=5).collect()
    exact = {(r.skill, r._id): r.score for r in similarity.knn(courses, skills).collect()}
    both = [r for r in found if (r.skill, r._id) in exact]
    assert len(found) == 150 and len(both) >= 0.95 * 150
    assert all(abs(exact[r.skill, r._id] - r.score) < 2e-6 for r in both)
    # 32 bytes of every row of the probed cells, and 256 of every row in cells that hold some of a short list
    known = spark.sparkContext.broadcast(codes)
    probed = quantized._lists_in(quantized._probed(known, skills, 5), F.explode("probes"))
    listed, _ = quantized.short_lists(indexed, codes, skills, 100, 5)
    count = lambda cells: indexed.where(F.col("list").isin(cells)).count()
    read = 32 * count(probed) + 256 * count(quantized._lists_in(listed, "list"))
    assert read <= 0.25 * 256 * rows


def test_first_look_reads_no_vectors(spark, tmp_path, monkeypatch):
    courses, skills = clustered(spark, 2_000)
    codes = quantized.fit_codes(courses, lists=8)
    indexed = quantized.write_index(quantized.index(courses, codes), str(tmp_path / "index"))
    plans = []
    real = quantized.against_all

    def seen(left, *rest):
        plans.append(left._jdf.queryExecution().executedPlan().toString())
        return real(left, *rest)

    monkeypatch.setattr(quantized, "against_all", seen)
    quantized.search(indexed, codes, skills, probes=3).collect()
    assert len(plans) == 1 and "ReadSchema: struct<_id:bigint,code:binary>" in plans[0] and "PartitionFilters" in plans[0]


def test_all_cells_and_a_long_list_are_the_exact_search(data, tmp_path, monkeypatch):  # noqa: F811
    courses, skills, cos = data
    codes = quantized.fit_codes(courses, lists=6, parts=3)  # 8 numbers do not divide by 3
    indexed = quantized.write_index(quantized.index(courses, codes), str(tmp_path / "index"))
    for rows in (500_000, 0):
        monkeypatch.setattr(quantized, "MAX_BROADCAST_ROWS", rows)
        found = quantized.search(indexed, codes, skills, k=20, probes=6, short=300).collect()
        got = {(r.skill, r._id): (r.score, r["rank"]) for r in found}
        want = {(s, i): (x, n) for s, i, x, n in brute_top(cos, 20)}
        assert {p: n for p, (_, n) in got.items()} == {p: n for p, (_, n) in want.items()}
        assert all(abs(got[p][0] - want[p][0]) < 2e-6 for p in want)


def test_index_of_awkward_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 2.0, 0.0])]
    courses = spark.createDataFrame(rows, "_id bigint, vector array<float>")
    skills = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("none", None)], "skill string, vector array<double>")
    codes = quantized.fit_codes(courses, lists=2, parts=2)
    indexed = quantized.write_index(quantized.index(courses, codes), str(tmp_path / "index"))
    found = quantized.search(indexed, codes, skills, k=9, probes=9)
    assert [(r.skill, r._id, r.score) for r in found.orderBy("rank").collect()] == [("x", 1, 1.0), ("x", 4, 1.0), ("x", 3, 0.5), ("x", 5, 0.5)]
    with pytest.raises(ValueError, match="no vectors"):
        quantized.fit_codes(courses.where("_id = 2"))


@pytest.mark.parametrize("block_rows", [8192, 5])
def test_floors_change_nothing(data, monkeypatch, block_rows):  # noqa: F811
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", block_rows)
    courses, skills, cos = data
    got = {(r.skill, r._id, r.score, r["rank"]) for r in similarity.knn(courses, skills, k=20, floors=True).collect()}
    assert got == brute_top(cos, 20)
    few = {(r.skill, r._id) for r in similarity.knn(courses.where("_id < 15"), skills, k=20, floors=True).collect()}
    assert len(few) == 12 * 15


def test_floors_cut_what_tasks_send(spark):
    courses, skills = clustered(spark, 20_000, width=16)
    spread = courses.repartition(40, "_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        sent = {way: similarity.local_hits(spread, skills, floors=way).count() for way in (False, True)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sent[False] == 40 * 10 * 50
    # a fifth of the rows set the floors, so about five times the 50 best of each skill reach them
    assert 10 * 50 <= sent[True] <= 0.25 * sent[False]
