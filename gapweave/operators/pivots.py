"""Comparing only blocks of points that can hold neighbours, told by their angles to pivots.

The angle between directions is a metric. If all points of one block are at angles 10 to 20
degrees from a pivot and those of another at 50 to 60, no two of them are nearer than 30. So
blocks whose ranges of angles to any pivot lie further apart than the search radius are never
compared. The rule is exact: it leaves out pairs that cannot be neighbours, and no others.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.blocks import to_matrix, unit_rows
from gapweave.operators.lineage import checkpointed

PIVOTS = 64
#: Rows that pivots are chosen from, by a hash of the id; the driver holds them.
SAMPLE_ROWS = 4096
#: Rows of a block, unless that makes more blocks than the driver lists.
BLOCK_ROWS = 4096
MAX_BLOCKS = 8192
#: Rows of the blocks that travel together, at most.
GROUP_ROWS = 1 << 16
#: Added to the radius against rounding, in radians.
SLACK = 1e-6


def radius(eps: float, digits: int) -> float:
    """The largest angle of two directions whose cosine distance, rounded, is at most eps."""
    return float(np.arccos(np.clip(1.0 - eps - 10.0**-digits, -1.0, 1.0))) + SLACK


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(matrix) @ pivots.T, -1.0, 1.0))


def fit_pivots(points: DataFrame, rows: int, count: int = PIVOTS) -> np.ndarray:
    """Directions of count points far from each other, out of a bounded sample of (id, vector)."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    some = points.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 20)) < share * (1 << 20)).select("id", "vector")
    sample = some.orderBy("id").limit(2 * SAMPLE_ROWS).toArrow()
    unit = unit_rows(to_matrix(sample.column("vector"))) if sample.num_rows else np.zeros((0, 1))
    unit = unit[np.abs(unit).sum(axis=1) > 0]
    if not len(unit):
        return unit
    chosen = [int((unit @ unit.mean(axis=0)).argmax())]
    nearest = unit @ unit[chosen[0]]
    while len(chosen) < min(count, len(unit)) and nearest.min() < 1.0 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


@dataclass
class Blocks:
    """Which block each point is in, and which blocks may hold neighbours of which."""

    members: DataFrame  # id, block
    sizes: dict[int, int]
    pairs: list[tuple[int, int]]

    def compared(self) -> int:
        """Pairs of points that are compared."""
        return sum(self.sizes[a] * self.sizes[b] for a, b in self.pairs)


def blocked(points: DataFrame, theta: float, rows: int, pivots: int = PIVOTS, block_rows: int | None = None) -> Blocks | None:
    """Blocks of (id, vector), by nearest pivot; a cell is cut by a hash of the id into blocks of about block_rows.

    None when no point has a direction.
    """
    spark = points.sparkSession
    centres = fit_pivots(points, rows, pivots)
    if not len(centres):
        return None
    most = max(block_rows or BLOCK_ROWS, 2 * rows // MAX_BLOCKS)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angles = _angles(to_matrix(batch.column("vector")), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, angles.size + 1, angles.shape[1]), pa.int32()), pa.array(angles.ravel()))
                cells = pa.array(angles.argmin(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), cells, lists], names=["id", "cell", "angles"])

    placed = checkpointed(points.select("id", "vector").mapInArrow(place, "id bigint, cell int, angles array<double>"))
    cells = {r.cell: -(-r["count"] // most) for r in placed.groupBy("cell").count().collect()}  # one row a pivot
    first = dict(zip(cells, np.concatenate([[0], np.cumsum(list(cells.values()))[:-1]]).tolist(), strict=True))
    known = spark.createDataFrame([(c, first[c], n) for c, n in cells.items()], "cell int, first long, pieces long")
    in_block = (F.col("first") + F.pmod(F.xxhash64("id", F.lit("block")), F.col("pieces"))).alias("block")
    members = checkpointed(placed.join(F.broadcast(known), "cell").select("id", in_block, "angles"))

    # the ranges of angles: at most MAX_BLOCKS * PIVOTS rows
    ranges = members.select("block", F.posexplode("angles").alias("pivot", "angle")).groupBy("block", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    sizes = {r.block: r["count"] for r in members.groupBy("block").count().collect()}
    names = sorted(sizes)
    line = {b: i for i, b in enumerate(names)}
    low, high = np.zeros((len(names), len(centres))), np.zeros((len(names), len(centres)))
    for r in ranges.toLocalIterator():
        low[line[r.block], r.pivot], high[line[r.block], r.pivot] = r.low, r.high
    pairs = []
    for i, block in enumerate(names):
        near = ((low[i] - high <= theta) & (low - high[i] <= theta)).all(axis=1)
        pairs += [(block, names[j]) for j in np.flatnonzero(near)]
    return Blocks(members.select("id", "block"), sizes, pairs)


def _gathered(sizes: dict[int, int], rows: int) -> dict[int, int]:
    """Block -> number of the group it goes with: neighbours by number, of about so many rows together."""
    group, out, held = 0, {}, 0
    for block in sorted(sizes):
        if held and held + sizes[block] > rows:
            group, held = group + 1, 0
        out[block] = group
        held += sizes[block]
    return out


def against_near(left: DataFrame, right: DataFrame, work, schema: str, blocks: Blocks) -> DataFrame:
    """``blocks.against_all`` over the pairs of blocks that may hold neighbours.

    Blocks travel in groups, so that a row is sent once for each group that holds a partner of its
    block, not for each partner; a pair of groups is one task's work, which compares partners only.
    left and right have a row at most for each id of the blocks; the two may be the same table.
    """
    from pyspark.sql.types import StructType

    out_schema = StructType.fromDDL(schema)
    spark = left.sparkSession
    total = sum(blocks.sizes.values())
    # groups enough for all cores, of GROUP_ROWS at most (or one block)
    fewest = int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))
    group = _gathered(blocks.sizes, min(GROUP_ROWS, -(-total // fewest)))
    partners: dict[int, list[int]] = {}
    for a, b in blocks.pairs:
        partners.setdefault(a, []).append(b)
    shared = spark.sparkContext.broadcast({a: np.array(b, np.int64) for a, b in partners.items()})
    met = {(a, group[b]) for a, found in partners.items() for b in found}  # block, group of a partner
    of_block = spark.createDataFrame(list(group.items()), "block long, own long")
    dealt_to = spark.createDataFrame(sorted(met), "block long, other long")

    def dealt(df, own, other):
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])
        placed = fresh.join(blocks.members.select(F.col("id").alias("_id"), F.col("block").alias("_block")), F.col("id") == F.col("_id")).drop("_id")
        where = of_block.join(dealt_to, "block").select(F.col("block").alias("_block"), F.col("own").alias(own), F.col("other").alias(other))
        return placed.join(F.broadcast(where), "_block")

    def pair(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        helpers = ["_left", "_right", "_block"]
        theirs, mine = (t.column("_block").to_numpy() for t in (right_table, left_table))
        left_table, right_table = left_table.drop_columns(helpers).combine_chunks(), right_table.drop_columns(helpers).combine_chunks()
        found = []
        for block in np.unique(mine).tolist():
            near = np.flatnonzero(np.isin(theirs, shared.value[block]))
            if len(near):
                some = right_table if len(near) == len(theirs) else right_table.take(pa.array(near))
                found += work(iter(left_table.take(pa.array(np.flatnonzero(mine == block))).to_batches()), some)
        return pa.Table.from_batches(found, to_arrow_schema(out_schema))

    lefts, rights = dealt(left, "_left", "_right"), dealt(right, "_right", "_left")
    return lefts.groupBy("_left", "_right").cogroup(rights.groupBy("_left", "_right")).applyInArrow(pair, schema)
