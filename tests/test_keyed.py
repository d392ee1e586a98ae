import pytest
from pyspark.sql import functions as F

from gapweave.operators import keyed, ranking
from gapweave.operators.ranking import rank_within, top_k_per_group
from gapweave.plans import interactions


def at():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture
def old(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "_id bigint, s string, x double")


def test_get_and_find(spark, old):
    ids = spark.createDataFrame([(1,), (1,), (9,)], "_id bigint")
    assert rows(keyed.get_rows(old, ids), "_id") == [(1,)]
    assert keyed.get_row(old, 2).first().s == "b" and keyed.get_row(old, 7).count() == 0
    assert rows(keyed.find_rows(old, "s", "a"), "_id") == [(1,)]
    tags = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "_id int, tags array<string>")
    assert rows(keyed.find_rows(tags, "tags", "y"), "_id") == [(1,)]


def test_insert_absent_first_wins(spark, old):
    new = spark.createDataFrame(
        [(1, "no", 0.0, 0), (4, "second", 2.0, 2), (4, "first", 1.0, 1)], "_id bigint, s string, x double, at int"
    )
    out = keyed.insert_absent(old, new, "at", at())
    assert {r._id: (r.s, r.timestamp) for r in out.collect()} == {
        1: ("a", None), 2: ("b", None), 3: (None, None), 4: ("first", "1717243200"),
    }
    assert out.where("_id = 4").first().datetime == "2024-06-01 12:00:00.000000"


def test_generated_ids(spark):
    df = spark.createDataFrame([(i, i) for i in range(500)], "_id bigint, key bigint")
    a = keyed.insert_generated(df, "key", "run")
    b = keyed.insert_generated(df.repartition(7), "key", "run")
    assert rows(a) == rows(b)
    ids = [r._id for r in a.collect()]
    assert len(set(ids)) == 500 and all(len(i) == 10 and i.isalnum() and i == i.lower() for i in ids)
    assert keyed.id_collisions(a).count() == 0
    assert keyed.id_collisions(keyed.insert_generated(df, "key", "run", length=1)).count() > 0
    with pytest.raises(ValueError):
        keyed.generated_id(F.col("key"), "run", 17)


def test_update(spark, old):
    changes = spark.createDataFrame(
        [(1, "z", None, 0), (1, "y", None, 1), (2, "b", None, 0), (9, "q", None, 0)], "_id bigint, s string, x double, at int"
    )
    out = {r._id: r for r in keyed.update_rows(old, changes, "at", at()).collect()}
    assert (out[1].s, out[1].x, out[1].changed, out[1].last_modified) == ("y", 1.0, True, "1717243200")
    assert (out[2].s, out[2].changed, out[2].last_modified) == ("b", False, "1717243200")
    assert (out[3].changed, out[3].last_modified) == (False, None)
    assert rows(keyed.not_found(old, changes)) == [(9,)]


def test_update_with_a_new_field_keeps_the_old_stamp(spark, old):
    stamped = old.withColumn("last_modified", F.lit("5"))
    changes = spark.createDataFrame([(1, "n")], "_id bigint, extra string")
    out = {r._id: r for r in keyed.update_rows(stamped, changes).collect()}
    assert (out[1].extra, out[1].changed, out[1].last_modified) == ("n", True, "5")
    assert (out[2].extra, out[2].changed) == (None, False)


def test_upsert(spark, old):
    new = spark.createDataFrame([(3, "c", [1.0]), (8, "h", [2.0])], "_id bigint, s string, vector array<double>")
    out = {r._id: r for r in keyed.upsert_rows(old, new).collect()}
    assert (out[3].s, out[3].x, out[3].vector) == ("c", 3.0, [1.0])
    assert (out[8].s, out[8].x) == ("h", None) and (out[1].s, out[1].vector) == ("a", None)


def test_delete(spark, old):
    ids = spark.createDataFrame([(1,), (1,), (7,)], "_id bigint")
    assert rows(keyed.delete_rows(old, ids), "_id") == [(2,), (3,)]
    assert rows(keyed.deleted_ids(old, ids)) == [(1,)]


def test_swap_in_over_its_own_input(spark, old, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.swap_in(old, path, "r1") == 3
    table = spark.read.parquet(path)
    assert keyed.swap_in(table.where("_id > 1"), path, "r2") == 2
    assert rows(spark.read.parquet(path), "_id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        keyed.swap_in(old, path, "r2")


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_rank_within(spark, limit, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", limit)
    data = [("hot", (i * 37) % 100) for i in range(100)] + [("b", 2), ("b", 1), (None, 5)]
    df = spark.createDataFrame(data, "g string, x int").repartition(4)
    got = {(r.g, r.x): r["rank"] for r in rank_within(df, ["g"], [F.desc("x")]).collect()}
    want = {("hot", x): 100 - x for x in range(100)}
    assert got == {**want, ("b", 2): 1, ("b", 1): 2, (None, 5): 1}
    whole = {r.x: r["rank"] for r in rank_within(df.where("g = 'hot'"), [], [F.asc("x")]).collect()}
    assert whole == {x: x + 1 for x in range(100)}


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, x int").repartition(6)
    got = rows(top_k_per_group(df, ["g"], [F.desc("x")], 3), "g", "x", "rank")
    assert got == [("a", 47, 3), ("a", 48, 2), ("a", 49, 1), ("b", 1, 1)]


def test_interactions(spark, tmp_path):
    gap = spark.createDataFrame(
        [("a", i, f"s{i}", 1.0 - i / 100) for i in range(25)] + [("b", 0, "t", 0.5)],
        "request_id string, row_no int, skill string, gap_score double",
    )
    gains = spark.createDataFrame([("b", "e", 0.1), ("b", "f", 0.2)], "request_id string, evidence string, gain double")
    texts = spark.createDataFrame([("a", "{}", "{}", "u", "v"), ("z", "{}", None, None, None)],
                                  "request_id string, parsed_jd string, parsed_resume string, jd_url string, resume_url string")
    records = interactions.interaction_records(
        {"initial_knowledge": gap, "courses_filtered_after_dedup": gains}, texts, part_rows=10
    )
    path = interactions.write_interactions(records, str(tmp_path / "i"))
    got = {(r.request_id, r.part): r for r in spark.read.parquet(path).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("z", 0)}
    assert [x.skill for x in got[("a", 1)].initial_knowledge] == [f"s{i}" for i in range(14, 4, -1)]
    assert [x.evidence for x in got[("b", 0)].courses_filtered_after_dedup] == ["f", "e"]
    assert got[("a", 0)].jd_url == "u" and got[("a", 1)].jd_url is None
    json_path = interactions.write_interactions(records, str(tmp_path / "j"), "json")
    assert spark.read.json(json_path).count() == 5


def test_changes_of_a_key_are_merged_field_by_field(spark, old):
    changes = spark.createDataFrame([(1, "A", None, 0), (1, None, 5.0, 1)], "_id bigint, s string, x double, at int")
    for apply in (keyed.update_rows, keyed.upsert_rows):
        got = {r._id: (r.s, r.x) for r in apply(old, changes, "at").collect()}
        assert got == {1: ("A", 5.0), 2: ("b", None), 3: (None, 3.0)}
    given = spark.createDataFrame([(1, None, None, 0, ["s"]), (1, "no", 7.0, 1, ["x"])], "_id bigint, s string, x double, at int, has array<string>")
    for apply in (keyed.update_rows, keyed.upsert_rows):
        assert {r._id: (r.s, r.x) for r in apply(old, given, "at", carried="has").collect()}[1] == (None, 7.0)


def test_repeated_keys_without_a_position_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "_id long, name string, size int")
    changes = spark.createDataFrame([(1, "x", None), (1, None, 9), (3, "z", None), (3, None, 4)], "_id long, name string, size int")
    updated = {r._id: (r["name"], r["size"], r.changed) for r in keyed.update_rows(old, changes).collect()}
    assert updated == {1: ("x", 9, True), 2: ("b", 2, False)} and keyed.update_rows(old, changes).count() == 2
    rows = keyed.upsert_rows(old, changes).collect()
    assert sorted((r._id, r["name"], r["size"]) for r in rows) == [(1, "x", 9), (2, "b", 2), (3, "z", 4)]


def test_the_number_of_rows_inserted(spark, tmp_path):
    path = str(tmp_path / "table")
    old = spark.createDataFrame([(1, "a")], "_id long, name string")
    new = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (2, "z", 2), (3, "w", 3)], "_id long, name string, position long")
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp")
    assert keyed.insert_run(old, new, "position", run_at, path, "r1") == 2
    stored = spark.read.parquet(path)
    assert sorted((r._id, r["name"]) for r in stored.collect()) == [(1, "a"), (2, "y"), (3, "w")]
    assert keyed.insert_run(stored, new, "position", run_at, path, "r2") == 0


def test_colliding_generated_ids_replace_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    new = spark.range(200).withColumnRenamed("id", "key")
    old = spark.createDataFrame([], "_id string, key long")
    assert keyed.insert_generated_run(old, new, "key", "r1", path) == 200
    with pytest.raises(ValueError, match="held by"):
        keyed.insert_generated_run(spark.read.parquet(path), new, "key", "r2", path, length=1)
    with pytest.raises(ValueError, match="held by"):
        keyed.insert_generated_run(spark.read.parquet(path), new, "key", "r1", path)
    assert spark.read.parquet(path).count() == 200
