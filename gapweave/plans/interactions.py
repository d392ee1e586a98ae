"""The stored record of each request, put together from the tables of a run."""

from pyspark.sql import DataFrame, functions as F

from gapweave.operators.ranking import rank_within

PART_ROWS = 1000

# Section -> columns kept of each row, and its sort keys: a number, a whole number, a text.
SECTIONS = {
    "all_recommendations": (["_id", "name", "score", "weighted_score"], ("-weighted_score", "_id", "''")),
    "dedup_recommendations": (["_id", "name", "cluster", "weighted_score"], ("cluster", "_id", "''")),
    "courses_filtered_after_dedup": (["evidence", "gain"], ("-gain", "0", "evidence")),
    "initial_knowledge": (["row_no", "skill", "gap_score"], ("gap_score", "row_no", "skill")),
    "score_can_be_improved": (["row_no", "skill", "gap_score"], ("gap_score", "row_no", "skill")),
    "df_gap": (["row_no", "skill", "col_no", "evidence", "score"], ("row_no", "col_no", "evidence")),
}


def _section_rows(name: str, df: DataFrame) -> DataFrame:
    columns, (number, whole, text) = SECTIONS[name]
    return df.select(
        "request_id",
        F.lit(name).alias("section"),
        F.expr(f"cast({number} AS double)").alias("_number"),
        F.expr(f"cast({whole} AS bigint)").alias("_whole"),
        F.expr(f"cast({text} AS string)").alias("_text"),
        F.struct(*columns).alias(name),
    )


def interaction_records(sections: dict[str, DataFrame], texts: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """One record per request: an array of structs for each section, plus texts.

    A request with more than ``part_rows`` rows in a section goes on in further
    records (``part`` 1, 2, ...), so no record grows without bound; most requests
    have part 0 only. ``texts`` is (request_id, parsed_jd, parsed_resume, jd_url,
    resume_url), stored in part 0.
    """
    rows = None
    for name, df in sections.items():
        more = _section_rows(name, df)
        rows = more if rows is None else rows.unionByName(more, allowMissingColumns=True)
    order = [F.asc("_number"), F.asc("_whole"), F.asc("_text")]
    ranked = rank_within(rows, ["request_id", "section"], order)

    def listed(name):
        item = F.struct("rank", *[F.col(f"{name}.{column}") for column in SECTIONS[name][0]])
        return F.sort_array(F.collect_list(F.when(F.col("section") == name, item))).alias(name)

    part = F.floor((F.col("rank") - 1) / part_rows).cast("bigint").alias("part")
    records = ranked.groupBy("request_id", part).agg(*[listed(name) for name in sections])
    if texts is None:
        return records
    first = texts.withColumn("part", F.lit(0).cast("bigint"))
    return records.join(first, ["request_id", "part"], "full")


def write_interactions(records: DataFrame, path: str, form: str = "parquet") -> str:
    records.write.mode("append").format(form).save(path)
    return path
