"""Reading and normalising course catalogues."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.functions.text import duration_hours, encode_text, nan_to_null
from gapweave.operators.lineage import once
from gapweave.schemas import CATALOG_COLUMNS, RAW_COURSE_SCHEMA
from gapweave.sources.csv_chunks import read_wide_csv


def read_course_texts(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """The declared columns of a CSV (or TSV with ``sep``), found by their header names, as text.

    A missing column and files whose headers differ are errors; other columns are ignored.
    ``multi_line`` allows line breaks inside quoted cells; a file is read by many tasks
    either way, but twice, so turn it off for exports without such breaks.
    """
    if multi_line:
        found = read_wide_csv(spark, path, sep)
    else:
        read = spark.read.options(header=True, sep=sep, quote='"', escape='"')
        found = read.schema(read.csv(path).schema).option("enforceSchema", False).csv(path)
    return found.select(*[F.col(f"`{f.name}`") for f in RAW_COURSE_SCHEMA])


def _typed(field):
    value = F.trim(F.col(field.name))
    if field.dataType.simpleString() in ("bigint", "int"):
        value = value.try_cast("double")  # 12.0 is a whole number
    return value.try_cast(field.dataType) if field.dataType.simpleString() != "string" else F.col(field.name)


def read_courses(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Courses with the declared schema; a cell that is not of its type is null (see ``bad_cells``)."""
    texts = read_course_texts(spark, path, sep, multi_line)
    return texts.select(*[_typed(f).alias(f.name) for f in RAW_COURSE_SCHEMA])


def bad_cells(texts: DataFrame) -> DataFrame:
    """``column`` and ``value`` of the cells of ``read_course_texts`` that are not of their declared type."""
    checks = [
        F.when(F.col(f.name).isNotNull() & _typed(f).isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("value")))
        for f in RAW_COURSE_SCHEMA
        if f.dataType.simpleString() != "string"
    ]
    return texts.select(F.inline(F.array_compact(F.array(*checks))))


def normalize(raw: DataFrame, language: str | None = "English") -> DataFrame:
    """Catalogue columns under their own names, one language, with ``duration_hrs``."""
    catalog = raw.select(*[F.col(old).alias(new) for old, new in CATALOG_COLUMNS.items()])
    if language is not None:
        catalog = catalog.where(F.col("language") == language)
    rated = catalog.withColumn("avg_rating", nan_to_null(F.col("avg_rating")))
    # A dozen patterns per row: computed once, however many filters use the hours.
    return once(rated, "duration_hrs", duration_hours(F.col("duration")))


def texts_to_encode(catalog: DataFrame, columns=("name", "description")) -> DataFrame:
    return catalog.select("_id", encode_text(*[F.col(c) for c in columns]).alias("text"))


def providers(catalog: DataFrame) -> DataFrame:
    return catalog.select("provider").distinct()


def profile(table: DataFrame) -> DataFrame:
    """Type, non-null count and row count of every column, in one pass."""
    names = table.columns
    counts = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(table.schema[c].dataType.simpleString()).alias("type"),
                F.col(f"_{i}").alias("non_null"),
                F.col("_rows").alias("rows"),
            )
            for i, c in enumerate(names)
        ]
    )
    return counts.select(F.inline(lines))


def drop_empty_rows(table: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return table.na.drop(how="all")
