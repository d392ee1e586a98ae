"""Markdown score tables to long rows, without a join or a shuffle."""

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.text import bare_number, strip
from gapweave.operators.lineage import once
from gapweave.schemas import SKILL_HEADER


def _grids(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_header``, ``_body`` and ``_error`` for the table in each document."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.contains("|"))

    def cells(line):
        return F.filter(F.transform(F.split(line, r"\|"), lambda c: strip(c)), lambda c: c != "")

    widest = F.array_max(F.transform("_body", lambda row: F.size(row)))
    error = (
        F.when(F.col(text).isNull() | (F.size("_rows") == 0), F.lit("no table"))
        .when(F.size(F.array_distinct("_header")) != F.size("_header"), F.lit("duplicate column"))
        .when((F.size("_body") > 0) & (widest != F.size("_header")), F.lit("row width differs from header"))
    )
    # The second row is the |---| separator, whatever it holds.
    parsed = once(docs, "_rows", F.transform(lines, cells)).select(
        *docs.columns,
        "_rows",
        F.get("_rows", F.lit(0)).alias("_header"),
        F.filter("_rows", lambda row, i: i >= 2).alias("_body"),
    )
    return once(parsed, "_error", error)


def parse_tables(docs: DataFrame, key: str = "request_id", text: str = "markdown", first_column: str | None = None) -> DataFrame:
    """One row per cell right of the skill: (key, row_no, skill, col_no, evidence, score).

    Blank cells are dropped, so later cells of that row shift left; missing cells
    at the end of a row and cells that are not numbers have a null score. A table
    with the skill column only gives one row per skill, without evidence or score.
    With ``first_column`` tables whose first column has another name give no rows.
    Documents without a valid table give no rows; see ``table_errors``.
    """
    grid = _grids(docs.select(key, text), text).where(F.col("_error").isNull())
    if first_column is not None:
        grid = grid.where(F.get("_header", F.lit(0)).eqNullSafe(first_column))
    rows = grid.select(key, "_header", F.posexplode("_body").alias("row_no", "_cells"))
    columns = F.filter("_header", lambda name, i: i >= 1)
    cells = rows.select(
        key,
        "row_no",
        F.get("_cells", F.lit(0)).alias("skill"),
        "_cells",
        F.posexplode_outer(columns).alias("_at", "evidence"),
    )
    return cells.select(
        key,
        "row_no",
        "skill",
        (F.col("_at") + 1).alias("col_no"),
        "evidence",
        bare_number(F.get("_cells", F.col("_at") + 1)).alias("score"),
    )


def table_errors(docs: DataFrame, key: str = "request_id", text: str = "markdown") -> DataFrame:
    """Documents whose table cannot be used, with the reason."""
    return _grids(docs, text).where(F.col("_error").isNotNull()).select(key, F.col("_error").alias("error"))


def without_skill_column(docs: DataFrame, key: str = "request_id", text: str = "markdown") -> DataFrame:
    """Documents whose first column is not the skill column; they cannot be scored."""
    grid = _grids(docs, text).where(F.col("_error").isNull())
    return grid.where(~F.get("_header", F.lit(0)).eqNullSafe(SKILL_HEADER)).select(
        key, F.lit("no skill column").alias("error")
    )
