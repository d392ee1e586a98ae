"""Gap matrices: weights, gap scores, gains of recommended courses."""

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.scores import penalty_weight
from gapweave.functions.text import record_text, strip

CERTIFICATE_MARK = "(Certificate)"
TEMPLATE_PREFIX = "Project Name"


def penalize(cells: DataFrame, match_certificate: bool = False) -> DataFrame:
    """Scale each cell by the weight of its evidence column."""
    return cells.withColumn("score", F.col("score") * penalty_weight(F.col("evidence"), match_certificate))


def gap_scores(cells: DataFrame) -> DataFrame:
    """Gap score per skill row: sum of its cells / (number of positive cells + 1)."""
    total = F.coalesce(F.sum("score"), F.lit(0.0))
    positive = F.count_if(F.col("score") > 0)
    return cells.groupBy("request_id", "row_no", "skill").agg((total / (positive + 1)).alias("gap_score"))


def weakest_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy("request_id", "gap_score", "row_no")


def clean_evidence(cells: DataFrame) -> DataFrame:
    """Drop template columns, strip the certificate mark from the others."""
    name = strip(F.replace(F.col("evidence"), F.lit(CERTIFICATE_MARK), F.lit("")))
    return cells.where(~F.col("evidence").startswith(TEMPLATE_PREFIX)).withColumn("evidence", name)


def course_gains(cells: DataFrame) -> DataFrame:
    """Sum of each evidence column over all skills: what a course adds."""
    total = F.coalesce(F.sum("score"), F.lit(0.0))
    return clean_evidence(cells).groupBy("request_id", "evidence").agg(total.alias("gain"))


def largest_gain_first(gains: DataFrame) -> DataFrame:
    return gains.orderBy("request_id", F.desc("gain"), "evidence")


def certificate_records(recommended: DataFrame) -> DataFrame:
    """Each recommended course as a (name, description, level) record and its text."""
    record = F.struct("name", "description", "level")
    typed = recommended.select("request_id", "_id", record.alias("record"))
    return typed.withColumn("text", record_text(F.col("record"), typed.schema["record"].dataType))


def certificate_texts(deduplicated: DataFrame) -> DataFrame:
    """Certification text of each request, for the second prompt.

    Takes de-duplicated courses: at most one per cluster, so at most the chosen
    number of clusters (10) per request.
    """
    records = certificate_records(deduplicated)
    ordered = F.sort_array(F.collect_list(F.struct("_id", "text")))
    return records.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda r: r.getField("text")), "; ").alias("certifications")
    )


def gap_delta(initial: DataFrame, improved: DataFrame) -> DataFrame:
    """Gap score per skill before and after the recommended courses, and the change.

    A skill named twice in one matrix counts with its mean score.
    """

    def per_skill(scores, name):
        return scores.groupBy("request_id", "skill").agg(F.avg("gap_score").alias(name))

    both = per_skill(initial, "initial").join(per_skill(improved, "improved"), ["request_id", "skill"], "full")
    return both.withColumn("delta", F.col("improved") - F.col("initial"))
