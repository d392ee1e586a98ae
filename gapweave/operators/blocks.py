"""Comparing every row of one table with every row of another, block by block.

Similarity search, silhouettes and density clustering all need "each row against
all others", but none of them needs the pairs themselves: each keeps a small
summary (best k, sums, counts, a minimum). The comparison therefore runs as
matrix products on Arrow batches, and only the summary leaves a task.

* The right side is small (at most ``MAX_BLOCK_ROWS`` rows, checked): it is
  shipped to every task once and the left side streams past it with no shuffle.
* Otherwise both sides are cut into hashed blocks of bounded size, and each pair
  of blocks is one task's work.

Both ways give the same summaries; callers merge them with an aggregate.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.lineage import checkpointed

MAX_BLOCK_ROWS = 8192
GRID_LEFT_ROWS = 65536
CELLS_PER_STEP = 4_000_000


def to_matrix(column) -> np.ndarray:
    """An Arrow list<float|double> column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    sizes = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(sizes) != 1 or np.isnan(float(sizes[0])):
        raise ValueError(f"vectors of unequal lengths: {sizes.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero, so its cosine is 0."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def bounded_table(df: DataFrame, max_rows: int | None = None, rows: int | None = None) -> pa.Table | None:
    """The rows of a small table, or None when it has more than ``max_rows``.

    Counted first, unless the caller knows the number of ``rows``: a limit would
    send that many rows of every task to one task.
    """
    max_rows = MAX_BLOCK_ROWS if max_rows is None else max_rows
    rows = df.count() if rows is None else rows
    return df.toArrow() if rows <= max_rows else None


def steps(batches, right_rows: int):
    """Cut batches so that one step compares at most ``CELLS_PER_STEP`` pairs."""
    rows = max(1, CELLS_PER_STEP // max(1, right_rows))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def against_all(
    left: DataFrame, right: DataFrame, work, schema: str, held: pa.Table | None = None, rows: int | None = None
) -> DataFrame:
    """Run ``work(left batches, right table)`` for all left rows and all right rows.

    ``work`` is a generator over Arrow record batches. Rows of both sides need a
    non-null array column ``vector`` and a key to hash, their first column.
    ``held`` is the right side when the caller has already fetched it, ``rows`` its
    row count when that is known; otherwise the right side is stored first, so that
    counting, fetching and copying it does not compute (or encode) it again.
    """
    if held is None:
        if rows is None:
            right = checkpointed(right)
            rows = right.count()
        held = bounded_table(right, rows=rows)
    if held is not None:
        shared = left.sparkSession.sparkContext.broadcast(held)
        return left.mapInArrow(lambda batches: work(batches, shared.value), schema)
    return _grid(left, right, rows, work, schema)


def _grid(left: DataFrame, right: DataFrame, rows: int, work, schema: str) -> DataFrame:
    left_blocks = -(-left.count() // GRID_LEFT_ROWS) or 1
    right_blocks = -(-rows // MAX_BLOCK_ROWS) or 1

    def spread(df, own, own_blocks, other, other_blocks):
        return df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(own_blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_blocks - 1).cast("bigint")))
        )

    lefts = spread(left, "_left", left_blocks, "_right", right_blocks)
    # Fresh column identities: both sides are often the same table.
    fresh = right.select(*[F.col(c).alias(c) for c in right.columns])
    rights = spread(fresh, "_right", right_blocks, "_left", left_blocks)
    out_schema = left.sparkSession.createDataFrame([], schema).schema

    def pair(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        batches = list(work(iter(left_table.drop_columns(["_left", "_right"]).to_batches()),
                            right_table.drop_columns(["_left", "_right"])))
        return pa.Table.from_batches(batches, to_arrow_schema(out_schema))

    return (
        lefts.groupBy("_left", "_right")
        .cogroup(rights.groupBy("_left", "_right"))
        .applyInArrow(pair, schema)
    )
