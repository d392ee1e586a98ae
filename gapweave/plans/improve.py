"""The two batch jobs around an external language model, and the improvement.

``render_prompts`` makes one request text per row; the model's answers come back
as a table (request_id, markdown), and ``score_responses`` turns them into gap
scores. ``improvement`` compares two such rounds.
"""

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.functions.text import record_text
from gapweave.operators.gap import certificate_texts, course_gains, gap_delta, gap_scores, penalize
from gapweave.operators.lineage import checkpointed
from gapweave.operators.markdown import parse_tables, table_errors, without_skill_column
from gapweave.operators.records import record_json
from gapweave.plans.interactions import interaction_records
from gapweave.schemas import RESUME_SCHEMA, SKILL_HEADER

PROMPT_PARTS = [
    "You know the work of a {role} well. Compare the skills below with the evidence "
    "and rate, for every skill, how far each piece of evidence shows it.\n\nSkills: {must_have_skills}\n",
    "\nProjects:\n{projects}\n",
    "\nCertifications:\n{certifications}\n",
    "\nPublications:\n{publications}\n",
    "\nAwards:\n{awards}\n",
    "\nRate 0 (not shown) to 1 (fully shown). Leave out kinds of evidence that are not given. "
    "Answer with one Markdown table: first column \"" + SKILL_HEADER + "\", then one column per piece of "
    "evidence, its kind in brackets behind its name - (Award), (Publication), (Project) or (Certificate).\n",
]


def _fill(part: str, values: dict[str, Column]) -> list[Column]:
    pieces, rest = [], part
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(text), F.coalesce(values[name], F.lit(""))]
    return pieces + [F.lit(rest)]


def prompt(values: dict[str, Column]) -> Column:
    """The request text; a value that is not given is left empty."""
    return F.concat(*[piece for part in PROMPT_PARTS for piece in _fill(part, values)])


def _skill_list(skills: Column) -> Column:
    return F.array_join(skills, ", ")


def render_prompts(requests: DataFrame) -> DataFrame:
    """(request_id, prompt) from rows of (request_id, job, resume) records."""

    def text(name):
        return record_text(F.col(f"resume.{name}"), RESUME_SCHEMA[name].dataType)

    values = {
        "role": F.col("job.job_title"),
        "must_have_skills": _skill_list(F.col("job.must_have_skills")),
        "projects": text("projects"),
        "certifications": text("certifications"),
        "publications": text("publications"),
        "awards": text("academic_awards"),
    }
    return requests.select("request_id", prompt(values).alias("prompt"))


def render_course_prompts(requests: DataFrame, certifications: DataFrame) -> DataFrame:
    """Second round: the recommended courses are the only evidence."""
    none = F.lit("")
    values = {
        "role": F.col("job.job_title"),
        "must_have_skills": _skill_list(F.col("job.must_have_skills")),
        "certifications": F.col("certifications"),
        "projects": none,
        "publications": none,
        "awards": none,
    }
    joined = requests.join(certifications, "request_id", "left")
    return joined.select("request_id", prompt(values).alias("prompt"))


def response_cells(responses: DataFrame, match_certificate: bool = False) -> DataFrame:
    """Weighted cells of all valid answers (request_id, markdown)."""
    return penalize(parse_tables(responses, first_column=SKILL_HEADER), match_certificate)


def response_errors(responses: DataFrame) -> DataFrame:
    return table_errors(responses).unionByName(without_skill_column(responses))


def score_responses(responses: DataFrame, match_certificate: bool = False) -> DataFrame:
    return gap_scores(response_cells(responses, match_certificate))


def improvement(initial_cells: DataFrame, improved_cells: DataFrame) -> dict[str, DataFrame]:
    """Scores of both rounds, their difference, and the gain of each course.

    Takes weighted cells (request_id, row_no, skill, col_no, evidence, score).
    """
    initial, improved = gap_scores(initial_cells), gap_scores(improved_cells)
    return {
        "initial_knowledge": initial,
        "score_can_be_improved": improved,
        "delta": gap_delta(initial, improved),
        "courses_filtered_after_dedup": course_gains(improved_cells),
    }


def improvement_run(
    pairs: DataFrame,
    found: DataFrame,
    kept: DataFrame,
    initial: DataFrame,
    improved: DataFrame,
    texts: DataFrame | None = None,
    digits: int = 6,
) -> dict[str, DataFrame]:
    """From recommendations to the stored record: second prompts, scores of both rounds, their difference, the record.

    pairs: (request_id, job, resume) records; found: all recommendations; kept: those left by the
    near-duplicate removal; initial, improved: the answers (request_id, markdown) to the
    first and the second prompt; texts: as for ``interaction_records``, by default the JSON of the pairs.
    Scores are rounded before the records are sorted by them.
    """
    before, after = checkpointed(response_cells(initial)), checkpointed(response_cells(improved))
    rounds = improvement(before, after)
    if texts is None:
        texts = pairs.select("request_id", record_json(F.col("job")).alias("parsed_jd"), record_json(F.col("resume")).alias("parsed_resume"))
    sections = {"all_recommendations": found, "dedup_recommendations": kept, "df_gap": before}
    scores = {"courses_filtered_after_dedup": "gain", "initial_knowledge": "gap_score", "score_can_be_improved": "gap_score"}
    sections |= {c: rounds[c].withColumn(score, F.round(score, digits)) for c, score in scores.items()}
    return {
        "prompts": render_course_prompts(pairs, certificate_texts(kept)),
        "delta": rounds["delta"],
        "records": interaction_records(sections, texts),
    }
