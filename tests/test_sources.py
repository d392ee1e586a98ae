import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.plans.ingest import embed_and_store
from gapweave.schemas import CATALOG_COLUMNS
from gapweave.sources import catalog, documents, vectors

HEADER = ",".join(CATALOG_COLUMNS)
LINES = [
    '1,Intro,"Line one\nline ""two""",4 weeks,Free,Beginner,edX,10,4.5,r,English,yes,CS,online',
    "2,Cours,,2 hours,Free,,Udemy,,,r,French,no,CS,online",
    "3,Other,text,,Free,nan,edX,5,NaN,r,English,no,CS,online",
]


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "courses.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return catalog.read_courses(spark, str(path))


def test_read_and_normalize(raw):
    got = {r._id: r for r in catalog.normalize(raw).collect()}
    assert set(got) == {1, 3}
    assert got[1].description == 'Line one\nline "two"' and got[1].duration_hrs == 672.0
    assert got[3].duration_hrs is None and got[3].avg_rating is None
    assert list(got[1].asDict()) == [*CATALOG_COLUMNS.values(), "duration_hrs"]
    assert catalog.normalize(raw, language=None).count() == 3


def test_tsv(spark, tmp_path):
    path = tmp_path / "courses.tsv"
    path.write_text("\t".join(CATALOG_COLUMNS) + "\n" + "\t".join(LINES[1].split(",")) + "\n")
    assert catalog.read_courses(spark, str(path), sep="\t", multi_line=False).first().course_provider == "Udemy"


def test_profile_providers_and_empty_rows(spark, raw):
    got = [tuple(r) for r in catalog.profile(raw.select("course_id", "course_level")).collect()]
    assert got == [(0, "course_id", "bigint", 3, 3), (1, "course_level", "string", 2, 3)]
    assert sorted(r.provider for r in catalog.providers(catalog.normalize(raw, None)).collect()) == ["Udemy", "edX"]
    df = spark.createDataFrame([(None, None), (1, None)], "a int, b int")
    assert catalog.drop_empty_rows(df).count() == 1


def test_documents_round_trip(spark, tmp_path):
    folder = tmp_path / "job_description"
    folder.mkdir()
    (folder / "one.txt").write_text("first line\nsecond")
    (folder / "two.txt").write_text(" \n")
    listed = documents.list_files(spark, str(folder), "*.txt").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in listed) == [("one.txt", 17), ("two.txt", 2)]
    read = documents.read_texts(spark, str(folder), "job_description")
    ingested = documents.ingest(read, F.col("doc_id"), F.col("kind"), F.col("text"))
    stored = spark.read.parquet(documents.write_texts(ingested, str(tmp_path / "store")))
    got = {r.doc_id.rsplit("/", 1)[1]: (r.kind, r.text, r.n_chars) for r in stored.collect()}
    assert got == {"one.txt": ("job_description", "first line\nsecond", 17), "two.txt": ("job_description", None, None)}


def test_hash_encoder(spark):
    df = spark.createDataFrame([("Python and SQL",), ("python AND sql",), ("",)], "text string")
    a, b, empty = [np.array(r.vector) for r in vectors.hash_encoder(df).collect()]
    assert (a == b).all() and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not empty.any() and len(a) == 384


def test_model_encoder_and_distinct_texts(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "id int, text string")
    got = {r.id: r.vector for r in vectors.encode_distinct(df, vectors.model_encoder(make)).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0]}


def test_cache_encodes_only_what_is_missing(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def encoder(texts):
        seen.append(sorted(r._id for r in texts.select("_id").collect()))
        return vectors.hash_encoder(texts)

    def rows(*names):
        return spark.createDataFrame([(i, n, "d") for i, n in enumerate(names)], "_id bigint, name string, description string")

    first = {r._id: r.vector for r in vectors.cached_vectors(rows("a", "b"), path, encoder=encoder).collect()}
    again = {r._id: r.vector for r in vectors.cached_vectors(rows("a", "b"), path, encoder=encoder).collect()}
    changed = {r._id: r.vector for r in vectors.cached_vectors(rows("a", "x", "c"), path, encoder=encoder).collect()}
    other = vectors.cached_vectors(rows("a", "b"), path, columns=("name",), encoder=encoder)
    assert other.first().embedding_keys == ["name"] and other.count() == 2
    assert seen == [[0, 1], [], [1, 2], [0, 1]]
    assert first == again and changed[0] == first[0] and changed[1] != first[1] and set(changed) == {0, 1, 2}


def courses(spark, ids, word="text"):
    return spark.createDataFrame([(i, f"{word} {i}", "d") for i in ids], "_id bigint, name string, description string")


def test_cache_reads_only_its_own_model_and_aggregates_no_vectors(spark, tmp_path):
    path = str(tmp_path / "cache")
    for model in ("one model", "another/model"):
        vectors.cached_vectors(courses(spark, range(20)), path, model=model).count()
    found = vectors.cached_vectors(courses(spark, range(30)), path, model="one model")
    assert found.count() == 30
    folder = vectors.cache_folder(path, ("name", "description"), "one model")
    assert len(vectors.committed_runs(spark, folder)) == 2
    assert all(folder in f for f in found.inputFiles() if path in f)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "vector" in line for line in plan.splitlines())
    # nothing new: no run is added
    assert vectors.cached_vectors(courses(spark, range(30)), path, model="one model").count() == 30
    assert len(vectors.committed_runs(spark, folder)) == 2


def test_cache_skips_runs_that_were_not_committed_and_repeats(spark, tmp_path):
    path = str(tmp_path / "cache")
    vectors.cached_vectors(courses(spark, [1, 2, 2]), path).count()
    folder = vectors.cache_folder(path, ("name", "description"), vectors.HASH_MODEL)
    (run,) = vectors.committed_runs(spark, folder)
    # a run that failed, and one that added the same keys at the same time
    spark.createDataFrame([(9, "x", [1.0])], "_id bigint, text_hash string, vector array<float>").write.parquet(f"{folder}/run=broken")
    spark.read.parquet(run).write.parquet(f"{folder}/run=zz")
    (tmp_path / "cache").joinpath(*folder[len(path) + 1 :].split("/"), "_committed", "zz").touch()
    assert len(vectors.committed_runs(spark, folder)) == 2
    found = vectors.cached_vectors(courses(spark, [1, 2, 3]), path)
    assert sorted(r._id for r in found.collect()) == [1, 2, 3]


def test_cache_of_an_empty_catalogue(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert vectors.cached_vectors(courses(spark, [1]).limit(0), path).count() == 0
    assert vectors.cached_vectors(courses(spark, [1]), path).count() == 1


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_filter_loses_no_missing_row(spark, monkeypatch, bits):
    monkeypatch.setattr(vectors, "FILTER_BITS", bits)  # 64: full, so that every key goes through the join
    held = spark.range(0, 3_000).selectExpr("id AS _id", "cast(id AS string) AS text_hash")
    wanted = spark.range(2_000, 5_000).selectExpr("id AS _id", "cast(id AS string) AS text_hash", "'t' AS text")
    found = vectors.missing_rows(wanted, held, "_id", "text_hash").collect()
    assert sorted(r._id for r in found) == list(range(3_000, 5_000))
    assert vectors.bloom_words(held, "_id", "text_hash").count() <= bits // 64


def test_embed_and_store(spark, raw, tmp_path):
    table = spark.createDataFrame([(1, "kept"), (50, "other")], "_id bigint, note string")
    out = {r._id: r for r in embed_and_store(catalog.normalize(raw), table, str(tmp_path / "c")).collect()}
    assert set(out) == {1, 3, 50} and out[1].note == "kept" and len(out[1].vector) == 384 and out[50].vector is None
    assert out[3].embedding_keys == ["name", "description"]


def test_record_of_json_sink_is_readable(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame([(1, [("a", 0.5)])], "_id int, rows array<struct<s:string,x:double>>").write.json(path)
    assert json.loads(spark.read.text(path).first()[0]) == {"_id": 1, "rows": [{"s": "a", "x": 0.5}]}


def test_columns_are_found_by_name(spark, tmp_path):
    from gapweave.schemas import RAW_COURSE_SCHEMA
    from gapweave.sources import catalog

    names = [f.name for f in RAW_COURSE_SCHEMA]
    cells = {f.name: f"v {f.name}" if f.dataType.simpleString() == "string" else "12.0" for f in RAW_COURSE_SCHEMA}
    numbers = [f.name for f in RAW_COURSE_SCHEMA if f.dataType.simpleString() != "string"]
    order = names[::-1] + ["other"]
    lines = [",".join(order), ",".join([cells.get(n, "?") for n in order]), ",".join(["bad" if n == numbers[0] else cells.get(n, "?") for n in order])]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    good, bad = sorted(catalog.read_courses(spark, str(tmp_path / "c.csv")).collect(), key=lambda r: r[numbers[0]] is None)
    assert all(good[n] == (12 if n in numbers else cells[n]) for n in names) and bad[numbers[0]] is None
    assert catalog.bad_cells(catalog.read_course_texts(spark, str(tmp_path / "c.csv"))).collect() == [(numbers[0], "bad")]
