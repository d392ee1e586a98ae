"""Every query against DuckDB, and the plans it must not have."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows
from gapweave.operators import similarity
from workload import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(FOLDER, name)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["kmeans_fixed", "hierarchical_clusters", "agglomerative_clusters"])
def test_every_vector_gets_one_label(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).collect()
    n = con.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert len({r.id for r in got}) == len(got) == n and {r.cluster for r in got} <= set(range(5))


def test_dedup_is_a_subset_with_at_most_ten_clusters(spark):
    found = {(r.request_id, r._id) for r in entry.queries()["recommend_all"](spark, FOLDER).collect()}
    kept = entry.queries()["dedup_recommendations"](spark, FOLDER).collect()
    assert {(r.request_id, r._id) for r in kept} <= found
    assert {r.request_id for r in kept} == {r for r, _ in found}
    assert len({(r.request_id, r.cluster) for r in kept}) == len(kept) and {r.cluster for r in kept} <= set(range(10))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Queries whose work must stay in the JVM.
JVM_ONLY = ["catalog_load", "gap_score", "course_gain", "record_parse", "prompt_render", "store_update", "argmax_per_group"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "InArrow", "InPandas", "Cartesian", "NestedLoop"):
        assert bad not in plan


def test_scan_reads_only_used_columns(spark):
    plan = entry.queries()["pref_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "p_retailprice" not in plan


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_approximate_search_finds_nine_tenths_of_the_exact(spark, folder):
    folder = f"/root/testdata/{folder}"
    exact = similarity.knn(tables.vectors(spark, folder), tables.skills(spark, folder))
    found, exact = ({(r.skill, r._id) for r in df.collect()} for df in (entry.queries()["knn_approx"](spark, folder), exact))
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
