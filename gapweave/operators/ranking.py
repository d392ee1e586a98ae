"""Ranking inside groups that may be very large."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.operators.lineage import checkpointed

MERGE_FAN_IN = 64
WINDOW_ROWS = 1_000_000


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, with their ``rank``.

    Two rounds: groups are first cut to ``k`` rows inside 64 salted pieces, so
    the last round sees at most 64 * k rows of any group however hot it is.
    Spark adds a per-task limit (WindowGroupLimit) in front of each shuffle.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN_IN))
    pieces = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("rank", F.row_number().over(pieces))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= k)
        .drop("_salt")
    )


def best_per_group(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Row with the highest score per group, the smallest ``tie`` among equals.

    A max_by aggregate, so each task sends one row per group to the shuffle. A NaN
    score counts as none: it loses to every number.
    """
    rest = [c for c in df.columns if c not in keys]
    number = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    order = F.struct(number, -F.col(tie))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def first_per_group(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Row with the smallest ``position`` per group, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def last_per_group(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Row with the greatest ``position`` per group, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row inside its group.

    The rows are written to the checkpoint folder and the groups counted. When no
    group exceeds ``WINDOW_ROWS``, a window numbers them. Otherwise the rows are
    range-sorted by (keys, order) into slices, so no group sits in one task: a
    row's rank is its place in its slice plus its group's rows in earlier slices.
    """
    held = checkpointed(df)
    largest = held.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        return held.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    # The checkpoint fixes which row is in which slice.
    ranges = held.repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = checkpointed(ranges.withColumn("_slice", F.spark_partition_id()))
    here = Window.partitionBy("_slice", *keys).orderBy(*order)
    # One row per slice and group, so this window is as small as the slice count.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice", *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col("_slice").alias("_at"),
            *[F.col(k).alias(f"_at_{k}") for k in keys],
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        )
    )
    same = F.col("_slice") == F.col("_at")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_at_{key}"))
    numbered = sliced.withColumn("_local", F.row_number().over(here)).join(offsets, same)
    return numbered.select(*df.columns, (F.col("_local") + F.col("_offset")).cast("int").alias(name))
