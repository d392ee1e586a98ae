"""From raw responses to the stored record, through every job of a run."""

import json

from pyspark.sql import functions as F

from gapweave.operators import dedup, gap, records
from gapweave.plans import improve, ingest, interactions, recommend
from gapweave.schemas import RAW_COURSE_SCHEMA
from gapweave.sources import catalog as catalogs

JOB = {"job_title": "Analyst", "employment_type": None, "must_have_skills": ["python programming", "sql databases"]}
RESUME = {
    "skills": [], "certifications": [], "publications": [],
    "projects": [{"title": "Shop", "description": None}], "academic_awards": [],
}


def course(i, name, text, hours="10 hours", rating=4.5):
    return (i, name, text, hours, "Free", "Beginner", "edX", 5, rating, "r", "English", "yes", "CS", "online")


COURSES = [
    course(1, "Python programming", "learn python programming"),
    course(2, "Python programming", "learn python programming", rating=4.2),
    course(3, "SQL databases", "sql databases for all"),
    course(4, "Cooking", "soup and bread"),
    course(5, "Python programming long", "python programming", hours="9 weeks"),
]


def test_whole_run(spark, tmp_path):
    raw = spark.createDataFrame([("r1", json.dumps(JOB), json.dumps(RESUME)), ("r2", "sorry", json.dumps(RESUME))],
                                "request_id string, jd string, cv string")
    jobs = records.parse_records(raw.select("request_id", F.col("jd").alias("raw")), "job")
    resumes = records.parse_records(raw.select("request_id", F.col("cv").alias("raw")), "resume")
    assert [r.request_id for r in records.quarantine(jobs).collect()] == ["r2"]
    pairs = records.valid_records(jobs).select("request_id", F.col("record").alias("job")).join(
        records.valid_records(resumes).select("request_id", F.col("record").alias("resume")), "request_id"
    )
    assert "title: Shop" in improve.render_prompts(pairs).first().prompt

    catalog = catalogs.normalize(spark.createDataFrame(COURSES, RAW_COURSE_SCHEMA))
    stored = ingest.embed_and_store(catalog, catalog, str(tmp_path / "cache"))
    vectors = stored.select("_id", "vector")
    requests = recommend.wanted_skills(pairs)
    # A course found by two skills keeps the first score, so few places keep the skills apart.
    found = recommend.recommend(requests, recommend.encode_skills(requests), catalog, vectors, k=2)
    assert {r._id for r in found.collect()} == {1, 2, 3}
    kept = dedup.deduplicate(found.join(vectors, "_id"), num_clusters=2)
    # Courses 1 and 2 have one text, so they share a cluster and the tie goes to course 1.
    assert sorted(r._id for r in kept.collect()) == [1, 3]

    second = improve.render_course_prompts(pairs, gap.certificate_texts(kept)).first().prompt
    assert "name: SQL databases" in second and "title: Shop" not in second

    def answer(rows, evidence):
        table = f"| Must-Have Skill | {evidence} |\n|---|---|\n" + "\n".join(f"| {s} | {x} |" for s, x in rows)
        return spark.createDataFrame([("r1", table)], "request_id string, markdown string")

    before = improve.response_cells(answer([("python programming", 1), ("sql databases", 0)], "Shop (Project)"))
    after = improve.response_cells(answer([("python programming", 1), ("sql databases", 1)], "SQL databases (Certificate)"))
    rounds = improve.improvement(before, after)
    delta = {r.skill: round(r.delta, 6) for r in rounds["delta"].collect()}
    assert delta == {"python programming": 0.15, "sql databases": 0.5}

    texts = pairs.select(
        "request_id", records.record_json(F.col("job")).alias("parsed_jd"), records.record_json(F.col("resume")).alias("parsed_resume")
    )
    sections = {"all_recommendations": found, "dedup_recommendations": kept, "df_gap": before}
    sections.update({name: rounds[name] for name in ("initial_knowledge", "score_can_be_improved", "courses_filtered_after_dedup")})
    path = interactions.write_interactions(interactions.interaction_records(sections, texts), str(tmp_path / "i"))
    row = spark.read.parquet(path).collect()
    assert len(row) == 1 and len(row[0].all_recommendations) == 3 and len(row[0].dedup_recommendations) == 2
    assert json.loads(row[0].parsed_jd)["job_title"] == "Analyst"
    assert row[0].courses_filtered_after_dedup[0].evidence == "SQL databases"
