import json

import pytest
from pyspark.sql import functions as F

from gapweave.operators import records

JOB = {
    "job_title": "Clerk", "employment_type": "full-time", "must_have_skills": ["x", "y"],
    "education_requirements": [{"degree": "BSc", "field_of_study": None}],
}
RESUME = {
    "skills": ["sql"], "certifications": [{"name": "c", "organization": None}],
    "projects": [{"title": "t", "description": None}],
    "publications": [{"title": "p", "journal": None, "year": 2001}],
    "academic_awards": [{"title": "a", "related_skills": None}],
}


def parse(spark, raw, kind):
    raw = raw if isinstance(raw, str) else json.dumps(raw)
    return records.parse_records(spark.createDataFrame([(1, raw)], "doc_id int, raw string"), kind).first()


def without(record, key):
    return {k: v for k, v in record.items() if k != key}


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, []),
        ({"employment_type": None}, []),
        ({"job_title": None}, []),
        ({"employment_type": "gig"}, ["employment_type"]),
        ({"job_title": 5}, ["job_title"]),
        ({"must_have_skills": [{"skill": "z"}]}, []),
        ({"must_have_skills": [{"skill": "z"}, "y"]}, ["must_have_skills"]),
        ({"must_have_skills": "z"}, ["must_have_skills"]),
        ({"must_have_skills": None}, []),
        ({"qualifications": [{"qualification": None}]}, ["qualifications"]),
        ({"key_responsibilities": [{}]}, ["key_responsibilities"]),
        ({"education_requirements": [{"field_of_study": None}]}, []),
        ({"education_requirements": [{"degree": None, "field_of_study": None}]}, ["education_requirements"]),
        ({"education_requirements": [{"degree": "BSc"}]}, ["education_requirements"]),
    ],
)
def test_job_rules(spark, change, errors):
    row = parse(spark, {**JOB, **change}, "job")
    assert row.errors == errors
    assert (row.record is None) == bool(errors)


@pytest.mark.parametrize("key", ["job_title", "employment_type"])
def test_job_keys_are_required(spark, key):
    assert parse(spark, without(JOB, key), "job").errors == [key]


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, []),
        ({"publications": [{"title": "p", "journal": None, "year": 1800}]}, ["publications"]),
        ({"publications": [{"title": "p", "journal": None, "year": None}]}, []),
        ({"publications": [{"title": "p", "journal": None}]}, ["publications"]),
        ({"publications": [{"title": "p", "journal": None, "year": 2001.5}]}, ["publications"]),
        ({"projects": [{"title": "t", "description": None, "type": "own"}]}, ["projects"]),
        ({"projects": None}, []),
        ({"skills": None}, ["skills"]),
        ({"certifications": [{"name": None, "organization": "o"}]}, ["certifications"]),
        ({"academic_awards": [{"title": "a", "related_skills": [1]}]}, ["academic_awards"]),
    ],
)
def test_resume_rules(spark, change, errors):
    assert parse(spark, {**RESUME, **change}, "resume").errors == errors


def test_resume_keys(spark):
    assert parse(spark, without(RESUME, "skills"), "resume").errors == []
    assert parse(spark, without(RESUME, "projects"), "resume").errors == ["projects"]


def test_record_values(spark):
    record = parse(spark, {**JOB, "must_have_skills": [{"skill": "z"}]}, "job").record
    assert record.must_have_skills == ["z"] and record.bonus_skills == []
    assert record.education_requirements[0].degree == "BSc"
    assert parse(spark, RESUME, "resume").record.projects[0].type == "no-mention"


@pytest.mark.parametrize("raw", ["not JSON", "", "[1, 2]", "```json\n{broken\n```"])
def test_not_json(spark, raw):
    assert parse(spark, raw, "job").errors == ["not json"]


def test_fenced_json(spark):
    assert parse(spark, "Sure:\n```json\n" + json.dumps(JOB) + "\n```\nBye", "job").errors == []


def test_split_into_valid_and_quarantine(spark):
    raws = [(1, json.dumps(JOB)), (2, "junk")]
    parsed = records.parse_records(spark.createDataFrame(raws, "doc_id int, raw string"), "job")
    assert [r.doc_id for r in records.valid_records(parsed).collect()] == [1]
    bad = records.quarantine(parsed).collect()
    assert [(r.doc_id, r.raw) for r in bad] == [(2, "junk")]


def test_json_keeps_nulls(spark):
    parsed = records.parse_records(
        spark.createDataFrame([(1, json.dumps({**JOB, "job_title": None}))], "doc_id int, raw string"), "job"
    )
    out = json.loads(parsed.select(records.record_json(F.col("record"))).first()[0])
    assert out["job_title"] is None and out["must_have_skills"] == ["x", "y"] and out["bonus_skills"] == []


def test_normalize_skills(spark):
    raws = ['{"must_have_skills": ["a", {"skill": "b"}]}', "junk", "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "doc_id int, raw string")
    got = {r.doc_id: r.skills for r in records.normalize_skills(df).collect()}
    assert got == {0: ["a", "b"], 1: [], 2: []}


def test_loose_parse_keeps_raw(spark):
    df = spark.createDataFrame([("junk",), ('{"a": 1}',)], "raw string")
    got = records.loose_parse(df).select("raw", F.col("parsed").isNull().alias("n")).collect()
    assert [tuple(r) for r in got] == [("junk", True), ('{"a": 1}', False)]
