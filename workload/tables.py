"""Engine inputs derived from the given tables, whole tables only.

The SQL texts below are written once, in the dialect Spark and DuckDB share, and
used by the Spark side here and by the checking SQL in ``workload.oracle``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Provider of a part, by brand number; the last five brands have an unlisted name.
BRAND_PROVIDERS = [
    "edX", "Udemy", "Skillshare", "OpenLearn", "Coursera", "DataCamp", "Kadenze", "Cybrary", "Kaggle", "Brilliant",
    "openSAP", "YouTube", "Udacity", "Jovian", "Designlab", "Edureka", "Swayam", "Scrimba", "Wolfram U", "openHPI",
]
BRAND_NO = "CAST(replace(p_brand, 'Brand#', '') AS INT)"
PROVIDER = (
    f"CASE WHEN {BRAND_NO} <= {len(BRAND_PROVIDERS)} THEN split_part('{'|'.join(BRAND_PROVIDERS)}', '|', {BRAND_NO}) "
    "ELSE p_brand END"
)
SIZE = "CAST(p_size AS STRING)"
DURATION = (
    "CASE p_type WHEN 'ECONOMY' THEN 'On-Demand' "
    f"WHEN 'LARGE' THEN {SIZE} || ' weeks, 5-' || {SIZE} || ' hours a week' "
    f"WHEN 'MEDIUM' THEN {SIZE} || '-' || CAST(p_size + 3 AS STRING) || ' hours' "
    f"WHEN 'PROMO' THEN {SIZE} || ' hours ' || {SIZE} || ' minutes' "
    f"WHEN 'SMALL' THEN {SIZE} || '0 minutes' "
    f"ELSE {SIZE} || ' days' END"
)
RAW_COURSE = {
    "course_id": "p_partkey",
    "course_name": "p_name",
    "description": "text",
    "duration": DURATION,
    "cost": f"{SIZE} || ' EUR'",
    "course_level": "p_type",
    "course_provider": PROVIDER,
    "course_num_rating": "n_chars",
    "course_avg_rating": "CASE WHEN p_size = 50 THEN CAST('NaN' AS DOUBLE) ELSE 3e0 + CAST(p_size AS DOUBLE) / 25e0 END",
    "rating": "source",
    "language": "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' "
    "WHEN 'es' THEN 'Spanish' END",
    "course_certificate": "CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END",
    "course_subject": "p_brand",
    "course_type": "source",
}

# Evidence headers of the two gap matrices, by event type.
INITIAL_HEADERS = {
    "error": "Prize (Award)",
    "signup": "Paper (Publication)",
    "view": "Web shop (Project)",
    "click": "Cloud Certification",
    "purchase": "Data course (Certificate)",
}
IMPROVED_HEADERS = {
    "error": "Safety (Certificate)",
    "signup": "Project Name X (Project)",
    "view": "Statistics (Certificate)",
    "click": "Cloud Certification (Certificate)",
    "purchase": "Python (Certificate)",
}

JOB_BODY = (
    "'{' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' "
    "ELSE '\"job_title\": \"' || o_orderpriority || ' clerk\", ' END"
    " || '\"employment_type\": ' || CASE o_orderstatus WHEN 'F' THEN '\"full-time\"' WHEN 'O' THEN 'null' "
    "ELSE '\"gig\"' END"
    " || ', \"must_have_skills\": ' || CASE WHEN o_orderpriority = '2-HIGH' "
    "THEN '[{\"skill\": \"s' || CAST(o_custkey AS STRING) || '\"}, {\"skill\": \"t\"}]' "
    "ELSE '[\"s' || CAST(o_custkey AS STRING) || '\", \"t\"]' END"
    " || ', \"education_requirements\": [{\"degree\": \"BSc\", \"field_of_study\": null}]}'"
)
JOB_RAW = (
    "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' "
    "THEN 'Sorry, nothing found for ' || CAST(o_orderkey AS STRING) "
    f"WHEN o_orderpriority = '1-URGENT' THEN 'Here it is:' || chr(10) || '```json' || chr(10) || {JOB_BODY} "
    "|| chr(10) || '```' || chr(10) || 'Done.' "
    f"ELSE {JOB_BODY} END"
)
RESUME_YEAR = "(1840 + c_nationkey * 12)"
RESUME_RAW = (
    "'{\"skills\": [\"sql\", \"' || lower(c_mktsegment) || '\"], '"
    " || '\"certifications\": [{\"name\": \"Cert ' || CAST(c_nationkey AS STRING) || '\", \"organization\": null}], '"
    " || '\"projects\": [{\"title\": \"' || c_name || '\", \"description\": \"in ' || lower(c_mktsegment) || '\"}, "
    "{\"title\": \"Side\", \"description\": null, \"type\": \"personal\"}], '"
    " || '\"publications\": [{\"title\": \"On sales\", \"journal\": \"J\", \"year\": ' || "
    f"CAST({RESUME_YEAR} AS STRING) || '}}], '"
    " || '\"academic_awards\": [{\"title\": \"Prize\", \"related_skills\": [\"sql\", \"python\"]}]}'"
)


# Declared, so that opening a table reads no footers. Only columns in use.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "events": "user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that comes as one small file.

    The given tables are single files, hence single tasks. A table with at least
    as many files as cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_courses(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "part").join(
        table(spark, sf_dir, "documents"), F.col("p_partkey") == F.col("doc_id"), "left"
    )
    return joined.selectExpr(*[f"{text} AS {name}" for name, text in RAW_COURSE.items()])


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))


def skills(spark, sf_dir) -> DataFrame:
    """One skill per label: the mean of its vectors. (skill_pos, skill, vector)"""
    items = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding"))
    means = items.groupBy("label", "pos").agg(F.avg("col").alias("mean"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("label").agg(ordered.alias("parts")).select(
        F.col("label").alias("skill_pos"),
        F.concat(F.lit("skill_"), F.col("label").cast("string")).alias("skill"),
        F.transform("parts", lambda p: p.getField("mean")).alias("vector"),
    )


def requests(spark, sf_dir) -> DataFrame:
    """One request per document source; it asks for the labels of its documents."""
    joined = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("vec_id") == F.col("doc_id")
    )
    return joined.groupBy(F.col("source").alias("request_id"), "label").agg(F.min("vec_id").alias("skill_pos")).select(
        "request_id", "skill_pos", F.concat(F.lit("skill_"), F.col("label").cast("string")).alias("skill")
    )


def preferences(spark, sf_dir) -> DataFrame:
    """Limits of each request; the lower hours and the language are left to the defaults."""
    first = F.min("doc_id")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("request_id")).agg(
        F.when(first % 2 == 0, 3.5).otherwise(4.0).alias("min_rating"),
        (first % 40 + 10).cast("double").alias("max_duration"),
        F.lit(None).cast("string").alias("language"),
    )


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster")
    )


def points(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).drop("cluster")


def job_responses(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey"), F.expr(JOB_RAW).alias("raw")
    )


def resume_responses(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("doc_id"), F.expr(RESUME_RAW).alias("raw")
    )


def _matrices(spark, sf_dir, headers: dict, pick) -> DataFrame:
    """One Markdown matrix per user: skills are the values of ``k``, in order."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("request_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
        "value",
    )

    def cell(kind):
        score = F.floor(pick(F.when(F.col("event_type") == kind, F.col("value"))))
        return F.coalesce(score.cast("string"), F.lit("n/a")).alias(kind)

    rows = events.groupBy("request_id", "k").agg(*[cell(kind) for kind in headers])
    bar = F.lit(" | ")
    cells = [part for kind in headers for part in (bar, F.col(kind))]
    line = F.concat(F.lit("| Skill "), F.col("k").cast("string"), *cells, F.lit(" |"))
    lines = F.sort_array(F.collect_list(F.struct("k", line.alias("line"))))
    head = "| Must-Have Skill | " + " | ".join(headers.values()) + " |\n|---" + "|---" * len(headers) + "|\n"
    return rows.groupBy("request_id").agg(
        F.concat(
            F.lit("The matrix:\n" + head),
            F.array_join(F.transform(lines, lambda r: r.getField("line")), "\n"),
            F.lit("\nEnd of the matrix."),
        ).alias("markdown")
    )


def initial_responses(spark, sf_dir) -> DataFrame:
    return _matrices(spark, sf_dir, INITIAL_HEADERS, F.max)


def improved_responses(spark, sf_dir) -> DataFrame:
    return _matrices(spark, sf_dir, IMPROVED_HEADERS, F.min)
