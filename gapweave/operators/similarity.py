"""Cosine similarity between skills and catalogue vectors."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.operators.blocks import against_all, bounded_table, steps, to_matrix, unit_rows
from gapweave.operators.lineage import checkpointed
from gapweave.operators.ranking import top_k_per_group

HITS = "skill string, _id bigint, score double"
DEFAULT_K = 50
DIGITS = 6
TILE = 4096
#: A catalogue whose plan is estimated at so many bytes is searched with score floors.
FLOOR_BYTES = 1 << 32


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; 0 when either is zero."""

    def dot(x, y):
        terms = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.when(norms.isNotNull(), F.lit(0.0)))


def _scores(matrix, others, mode, digits):
    """Rounded, so that equal work in another batch shape ranks the same way."""
    cos = unit_rows(matrix) @ others.T
    return np.round((1.0 + cos) / 2.0 if mode == "atlas_cosine" else cos, digits)


def check_mode(mode):
    if mode not in ("atlas_cosine", "cosine"):
        raise ValueError(f"unknown score mode {mode!r}")


def knn(
    vectors: DataFrame,
    skills: DataFrame,
    k: int = DEFAULT_K,
    score_mode: str = "atlas_cosine",
    digits: int = DIGITS,
    floors: bool | None = None,
) -> DataFrame:
    """Exact ``k`` nearest catalogue rows of every skill.

    ``vectors`` is (_id, vector), ``skills`` is (skill, vector) with one row per
    distinct skill: a skill asked for by many requests is searched once. Each
    task keeps its own best k per skill, so a task sends at most k rows a skill.
    With ``floors`` a first pass over the first batch of every task finds a score per skill
    that k rows reach, and tasks send only rows that reach it as well: then the rows sent
    hardly grow with the number of tasks. None: where the plan's size estimate is FLOOR_BYTES
    or more. The answer is the same.
    Returns (skill, _id, score, rank); equal scores go by _id.
    """
    local = local_hits(vectors, skills, k, score_mode, digits, floors)
    return top_k_per_group(local, ["skill"], [F.desc("score"), F.asc("_id")], k)


def local_hits(vectors, skills, k=DEFAULT_K, score_mode="atlas_cosine", digits=DIGITS, floors=None) -> DataFrame:
    """(skill, _id, score): what the tasks of ``knn`` send, the k nearest rows of every skill among them."""
    check_mode(score_mode)
    courses = vectors.select("_id", "vector").where(F.col("vector").isNotNull())
    wanted = skills.select("skill", "vector").where(F.col("vector").isNotNull())
    if floors is None:
        floors = _estimated_bytes(courses) >= FLOOR_BYTES
    if floors:
        wanted = checkpointed(wanted)
        first = against_all(courses.mapInArrow(_first_batch, courses.schema), wanted, _keep_best(k, score_mode, digits), HITS)
        reached = top_k_per_group(first, ["skill"], [F.desc("score"), F.asc("_id")], k).where(F.col("rank") == k)
        # one row per skill and side: as many as there are skills
        wanted = wanted.join(reached.select("skill", F.col("score").alias("floor")), "skill", "left").select("skill", "vector", "floor")
    return against_all(courses, wanted, _keep_best(k, score_mode, digits), HITS)


def _estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _first_batch(batches):
    """The first batch of a task; the rest of its rows is not read."""
    yield from itertools.islice(batches, 1)


class Best:
    """The k best (score, id) of each name among all rows added; equal scores go by id."""

    def __init__(self, names: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.names, self.k = names, k
        self.scores = [np.zeros(0)] * len(names)
        self.ids = [np.zeros(0, np.int64)] * len(names)
        self.notes = [np.zeros(0, np.int32)] * len(names)
        self.least = np.full(len(names), -np.inf) if floors is None else floors.copy()

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, notes: np.ndarray | None = None) -> None:
        """scores, allowed: rows x names. notes: a whole number that goes with each row."""
        better = scores >= self.least
        if allowed is not None:
            better &= allowed
        notes = np.zeros(len(ids), np.int32) if notes is None else notes
        for j in np.nonzero(better.any(axis=0))[0]:
            s = np.concatenate([self.scores[j], scores[better[:, j], j]])
            i = np.concatenate([self.ids[j], ids[better[:, j]]])
            n = np.concatenate([self.notes[j], notes[better[:, j]]])
            if len(s) > self.k:
                # Keep every row that ties with the k-th score, then cut by id.
                near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i, n = s[near], i[near], n[near]
            order = np.lexsort((i, -s))[: self.k]
            self.scores[j], self.ids[j], self.notes[j] = s[order], i[order], n[order]
            if len(order) == self.k:
                self.least[j] = max(self.least[j], self.scores[j][-1])

    def rows(self, note: str | None = None):
        """One batch: skill, _id, score, and the notes under that name."""
        sizes = [len(s) for s in self.scores]
        columns = {
            "skill": pa.array(np.repeat(self.names, sizes), pa.string()),
            "_id": pa.array(np.concatenate(self.ids), pa.int64()),
            "score": pa.array(np.concatenate(self.scores), pa.float64()),
        }
        if note is not None:
            columns[note] = pa.array(np.concatenate(self.notes), pa.int32())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _keep_best(k, score_mode, digits, lists=0):
    """Task work of a search: the best k rows of the task for each skill, none below the skill's floor if it has one.

    With ``lists`` cells, a row counts only for skills that probe its cell.
    """

    def local_best(batches, right):
        names = np.asarray(right.column("skill").to_pylist(), dtype=object)
        if len(names) == 0:
            return
        others = unit_rows(to_matrix(right.column("vector")))
        cells = None
        if lists:
            cells = np.zeros((len(names), lists), dtype=bool)
            for j, probes in enumerate(right.column("probes").to_pylist()):
                cells[j, probes] = True
        floors = None
        if "floor" in right.column_names:
            floors = np.array([-np.inf if x is None else x for x in right.column("floor").to_pylist()])
        best = Best(names, k, floors)
        for batch in steps(batches, len(names)):
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            scores = _scores(to_matrix(batch.column("vector")), others, score_mode, digits)
            best.add(scores, ids, None if cells is None else cells[:, batch.column("list").to_numpy()].T)
        yield from best.rows()

    return local_best


def build_index(vectors: DataFrame, lists: int = 256, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Cut the catalogue into ``lists`` cells of similar vectors (k-means on directions).

    Returns (_id, vector, list) and the cells' centres. Store the table partitioned
    by ``list``: an approximate search then reads the probed folders only.
    """
    unit = vectors.where(F.col("vector").isNotNull()).select("_id", F.col("vector").cast("array<double>").alias("vector"))
    features = unit.withColumn("_raw", array_to_vector("vector"))
    stages = [
        Normalizer(inputCol="_raw", outputCol="_unit"),
        KMeans(k=lists, seed=seed, featuresCol="_unit", predictionCol="list", solver="row"),
    ]
    held = features.persist()  # k-means reads it in every round
    model = Pipeline(stages=stages).fit(held)
    held.unpersist()
    centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    return model.transform(features).select("_id", "vector", "list"), centres


def knn_approx(
    indexed: DataFrame,
    centres: list[list[float]],
    skills: DataFrame,
    k: int = DEFAULT_K,
    probes: int = 8,
    score_mode: str = "atlas_cosine",
    digits: int = DIGITS,
) -> DataFrame:
    """Approximate ``k`` nearest rows: each skill looks into its ``probes`` best cells.

    Scores are exact; a row in another cell can be missed. With as many probes as
    cells this is ``knn``.
    """
    check_mode(score_mode)
    cells = F.array(*[F.struct(F.lit(i).alias("list"), F.array(*[F.lit(x) for x in c]).alias("c")) for i, c in enumerate(centres)])
    near = F.sort_array(
        F.transform(cells, lambda cell: F.struct(-cosine(cell.getField("c"), F.col("vector")), cell.getField("list").alias("list")))
    )
    wanted = skills.where(F.col("vector").isNotNull()).select(
        "skill", "vector", F.transform(F.slice(near, 1, probes), lambda cell: cell.getField("list")).alias("probes")
    )
    wanted = checkpointed(wanted)
    probed = [r[0] for r in wanted.select(F.explode("probes")).distinct().collect()]
    local = against_all(
        indexed.where(F.col("list").isin(probed)).select("_id", "vector", "list"),
        wanted,
        _keep_best(k, score_mode, digits, len(centres)),
        HITS,
    )
    return top_k_per_group(local, ["skill"], [F.desc("score"), F.asc("_id")], k)


def similarity_matrix(
    vectors: DataFrame, skills: DataFrame, score_mode: str = "cosine", digits: int = DIGITS
) -> DataFrame:
    """Cosine of every course with every skill, one row per course and tile.

    ``skills`` is (skill_pos, skill, vector) with positions 0, 1, ...; tile t holds
    positions t*4096 .. t*4096+4095 in order, so up to 4,096 skills are one row per
    course. A skill without a vector keeps its place, with null. The matrix is never
    spread into (skill, course) rows.
    """
    check_mode(score_mode)

    def rows(batches, right):
        if right.num_rows == 0:
            return
        pos = right.column("skill_pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        others = unit_rows(to_matrix(right.column("vector")))[order]
        tiles, places = np.divmod(pos[order], TILE)
        for batch in steps(batches, len(order)):
            scores = _scores(to_matrix(batch.column("vector")), others, score_mode, digits)
            for tile in np.unique(tiles):
                own = places[tiles == tile]
                n, width = len(scores), int(own.max()) + 1
                part = np.zeros((n, width))
                part[:, own] = scores[:, tiles == tile]
                absent = np.ones(width, dtype=bool)
                absent[own] = False
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * width + 1, width), pa.int32()),
                    pa.array(part.ravel(), mask=np.tile(absent, n)),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(np.full(n, tile), pa.int32()), lists],
                    names=["_id", "tile", "similarities"],
                )

    courses = vectors.select("_id", "vector").where(F.col("vector").isNotNull())
    wanted = skills.select("skill_pos", "vector").where(F.col("vector").isNotNull())
    schema = "_id bigint, tile int, similarities array<double>"
    held = bounded_table(wanted)
    if held is not None:
        return against_all(courses, wanted, rows, schema, held)
    # One pass a tile: every pass holds at most 4,096 skills.
    last = wanted.agg(F.max("skill_pos")).first()[0] // TILE
    passes = None
    for tile in range(last + 1):
        held = bounded_table(wanted.where(F.floor(F.col("skill_pos") / TILE) == tile), TILE)
        if held is None:
            raise ValueError("skill_pos repeats: a skill has one position")
        out = against_all(courses, wanted, rows, schema, held)
        passes = out if passes is None else passes.unionByName(out)
    return passes


def similarity_wide(matrix: DataFrame, skill_names: list[str]) -> DataFrame:
    """Export shape: one column per skill, named by position; null for a skill without a vector."""
    tiles = F.map_from_entries(F.collect_list(F.struct("tile", "similarities"))).alias("tiles")
    gathered = matrix.groupBy("_id").agg(tiles)
    return gathered.select(
        "_id",
        *[F.get(F.try_element_at("tiles", F.lit(i // TILE)), F.lit(i % TILE)).alias(name) for i, name in enumerate(skill_names)],
    )


def write_wide(wide: DataFrame, path: str) -> str:
    """The wide matrix as CSV files with a header."""
    wide.write.mode("error").option("header", True).csv(path)
    return path


def above_threshold(
    vectors: DataFrame,
    skills: DataFrame,
    threshold: float = 0.5,
    score_mode: str = "cosine",
    digits: int = DIGITS,
) -> DataFrame:
    """Courses whose similarity to a skill is above ``threshold`` (strict)."""
    check_mode(score_mode)

    def hits(batches, right):
        names = np.asarray(right.column("skill").to_pylist(), dtype=object)
        if len(names) == 0:
            return
        others = unit_rows(to_matrix(right.column("vector")))
        for batch in steps(batches, len(names)):
            scores = _scores(to_matrix(batch.column("vector")), others, score_mode, digits)
            row, col = np.nonzero(scores > threshold)
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[col], pa.string()), pa.array(ids[row]), pa.array(scores[row, col])],
                names=["skill", "_id", "similarity"],
            )

    return against_all(
        vectors.select("_id", "vector").where(F.col("vector").isNotNull()),
        skills.select("skill", "vector").where(F.col("vector").isNotNull()),
        hits,
        "skill string, _id bigint, similarity double",
    )


def with_course_facts(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name and hours of each hit, without the very short and very long courses."""
    facts = catalog.select("_id", "name", "duration_hrs").where(
        (F.col("duration_hrs") > 1) & (F.col("duration_hrs") < 60 * 240)
    )
    return hits.join(facts, "_id")
