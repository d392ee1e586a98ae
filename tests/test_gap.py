import pytest
from pyspark.sql import functions as F

from gapweave.functions.scores import provider_tier, weighted_score
from gapweave.operators import gap, markdown
from gapweave.plans import improve

TABLE = """Intro text
| Must-Have Skill | X (Award) | Y (Project) | Z (Certificate) |
|---|---|---|---|
| Python | 1 | 0.5 | 1 |
| SQL | 0 | n/a | 0.2 |
Closing words."""


def docs(spark, *texts):
    return spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "request_id string, markdown string")


def cells(spark, text):
    rows = markdown.parse_tables(docs(spark, text)).orderBy("row_no", "col_no").collect()
    return [(r.row_no, r.skill, r.col_no, r.evidence, r.score) for r in rows]


def test_parse_table(spark):
    assert cells(spark, TABLE) == [
        (0, "Python", 1, "X (Award)", 1.0), (0, "Python", 2, "Y (Project)", 0.5), (0, "Python", 3, "Z (Certificate)", 1.0),
        (1, "SQL", 1, "X (Award)", 0.0), (1, "SQL", 2, "Y (Project)", None), (1, "SQL", 3, "Z (Certificate)", 0.2),
    ]


def test_blank_cell_shifts_left_and_short_rows_are_padded(spark):
    got = cells(spark, "| S | a | b |\n|-|-|-|\n| p | | 2 |\n| q | 1 | 2 |")
    assert got == [(0, "p", 1, "a", 2.0), (0, "p", 2, "b", None), (1, "q", 1, "a", 1.0), (1, "q", 2, "b", 2.0)]


def test_pipe_in_prose_is_a_row(spark):
    got = cells(spark, "| S | a |\n|-|-|\n| p | 1 |\nread this | or that")
    assert (1, "read this", 1, "a", None) in got


def test_header_only(spark):
    assert cells(spark, "| S | a |\n|-|-|") == []


@pytest.mark.parametrize(
    "text, error",
    [
        ("no table here", "no table"),
        (None, "no table"),
        ("| S | a |\n|-|-|\n| p | 1 | 2 |", "row width differs from header"),
        ("| S | a | b |\n|-|-|-|\n| p | 1 |", "row width differs from header"),
        ("| S | a | a |\n|-|-|-|\n| p | 1 | 2 |", "duplicate column"),
    ],
)
def test_table_errors(spark, text, error):
    d = docs(spark, text, TABLE)
    assert [tuple(r) for r in markdown.table_errors(d).collect()] == [("r0", error)]
    assert {r.request_id for r in markdown.parse_tables(d).collect()} == {"r1"}


def test_missing_skill_column_is_reported(spark):
    d = docs(spark, "| Skill | a |\n|-|-|\n| p | 1 |", TABLE)
    assert [tuple(r) for r in improve.response_errors(d).collect()] == [("r0", "no skill column")]


def test_gap_scores(spark):
    scores = improve.score_responses(docs(spark, TABLE))
    got = [(r.skill, round(r.gap_score, 6)) for r in gap.weakest_first(scores).collect()]
    assert got == [("SQL", 0.1), ("Python", 0.5625)]


def test_certificates_are_penalised_only_on_request(spark):
    scores = improve.score_responses(docs(spark, TABLE), match_certificate=True)
    got = {r.skill: round(r.gap_score, 6) for r in scores.collect()}
    assert got == {"SQL": 0.06, "Python": round((0.9 + 0.35 + 0.6) / 4, 6)}


def test_all_null_row_scores_zero(spark):
    scores = improve.score_responses(docs(spark, "| Must-Have Skill | a |\n|-|-|\n| p | none |"))
    assert scores.first().gap_score == 0.0


def test_penalty_takes_the_first_kind_in_the_header(spark):
    rows = [("Award tracker (Project)", 1.0), ("My PUBLICATION project", 1.0), ("Cert certification", 1.0), ("x", 1.0)]
    got = gap.penalize(spark.createDataFrame(rows, "evidence string, score double"))
    assert [r.score for r in got.collect()] == [0.9, 0.8, 0.6, 1.0]


def test_course_gains(spark):
    text = (
        "| Must-Have Skill | Project Name X (Project) | A (Certificate) | A |\n|-|-|-|-|\n"
        "| p | 1 | 0.5 | 0.25 |\n| q | 1 | 1 | n/a |"
    )
    gains = gap.course_gains(improve.response_cells(docs(spark, text)))
    # Names that become equal are summed together; template columns are dropped.
    assert [tuple(r) for r in gains.collect()] == [("r0", "A", 1.75)]


def test_improvement_delta(spark):
    before = improve.response_cells(docs(spark, "| Must-Have Skill | a |\n|-|-|\n| p | 1 |\n| q | 0 |"))
    after = improve.response_cells(docs(spark, "| Must-Have Skill | a |\n|-|-|\n| p | 1 |\n| q | 1 |"))
    delta = improve.improvement(before, after)["delta"].orderBy("skill").collect()
    assert [(r.skill, r.delta) for r in delta] == [("p", 0.0), ("q", 0.5)]


def test_prompts(spark):
    job = "struct<job_title:string,must_have_skills:array<string>>"
    resume = (
        "struct<projects:array<struct<title:string,description:string,type:string>>,"
        "certifications:array<struct<name:string,organization:string>>,"
        "publications:array<struct<title:string,journal:string,year:int>>,"
        "academic_awards:array<struct<title:string,related_skills:array<string>>>>"
    )
    row = ("r", ("Clerk", ["sql", "r"]), ([("P", None, "personal")], [], None, []))
    df = spark.createDataFrame([row], f"request_id string, job {job}, resume {resume}")
    text = improve.render_prompts(df).first().prompt
    assert "work of a Clerk" in text and "Skills: sql, r\n" in text
    assert "title: P, description: None, type: personal" in text

    courses = spark.createDataFrame(
        [("r", 2, "B", "text", "x", 0), ("r", 1, "A", None, "y", 1)],
        "request_id string, _id bigint, name string, description string, level string, cluster int",
    )
    certificates = gap.certificate_texts(courses)
    assert certificates.first().certifications == (
        "name: A, description: None, level: y; name: B, description: text, level: x"
    )
    assert "name: A, description: None" in improve.render_course_prompts(df, certificates).first().prompt


def test_provider_tier(spark):
    df = spark.createDataFrame([("edX",), ("Udemy",), ("Kadenze",), ("YouTube",), ("edx",), (None,)], "p string")
    assert [r[0] for r in df.select(provider_tier(F.col("p"))).collect()] == [4, 3, 2, 1, 0, 0]


def test_weighted_score_terms(spark):
    df = spark.createDataFrame([(0.8, 4.0, 3.0, 0.5)], "s double, r double, d double, q double")
    args = [F.col(c) for c in "srdq"]
    assert df.select(weighted_score(*args)).first()[0] == 0.4
    assert df.select(weighted_score(*args, terms="all")).first()[0] == pytest.approx(0.4 + 1.2 + 0.05 + 0.1)


def test_tables_without_evidence_or_skill_column(spark):
    from gapweave.plans.improve import response_errors, score_responses
    from gapweave.schemas import SKILL_HEADER

    bare = f"| {SKILL_HEADER} |\n|---|\n| a |\n| b |"
    nohead = "| x | p |\n|---|---|\n| a | 0.7 |"
    answers = spark.createDataFrame([("bare", bare), ("nohead", nohead)], "request_id string, markdown string")
    assert {(r.request_id, r.skill, r.gap_score) for r in score_responses(answers).collect()} == {("bare", "a", 0.0), ("bare", "b", 0.0)}
    assert [r.request_id for r in response_errors(answers).collect()] == ["nohead"]
