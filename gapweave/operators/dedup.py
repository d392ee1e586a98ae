"""Near-duplicate removal: cluster each request's courses, keep the best of each.

K-means for many requests at once, with one answer whatever a request's size and
the partitioning. A k-means++ start takes, for each further centre, the course that
wins a race of hashed random numbers weighted by squared distance; Lloyd's rounds
follow until no centre moves. Both need of the courses only a minimum and sums, and
the sums are exact (whole multiples of a power of two), so they may be made in parts.
A request with up to ``PIECE`` courses is fitted in one task. For larger ones every
step is a pass over their rows, whose tasks send partial results; the centres of at
most ``KEPT`` such requests at a time are held by the driver and broadcast.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.blocks import to_matrix
from gapweave.operators.lineage import checkpointed
from gapweave.operators.ranking import best_per_group

PIECE = 8192
#: Large requests whose centres are broadcast at a time.
KEPT = 512
#: A piece's rows are compared in so many steps.
MERGE = PIECE // KEPT
SALTS = 32
SEED = 42
ROUNDS = 300


def _bits(rows: int, peak: float) -> int:
    """Values up to peak times 2 to this power, as whole numbers, have sums over rows that fit 64 bits."""
    if not math.isfinite(peak):
        raise ValueError("vectors with values that are not finite")
    return min(52, 62 - rows.bit_length()) - math.frexp(peak)[1]


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; each depends on its point and centre only, to the last bit."""
    out, step = np.empty((len(points), len(centres))), max(1, PIECE // MERGE)
    for low in range(0, len(points), step):
        for k, centre in enumerate(centres):
            apart = points[low : low + step] - centre
            out[low : low + step, k] = (apart * apart).sum(axis=1)
    return out


def _uniform(marks: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) from each mark and the turn (splitmix64)."""
    x = marks.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(12)) + 0.5) / 2.0**52


def _candidate(points: np.ndarray, marks: np.ndarray, centres: np.ndarray, turn: int):
    """(key, mark, point) of the smallest key, which wins with odds of its squared distance; None if all are centres."""
    weights = _gaps(points, centres).min(axis=1) if len(centres) else np.ones(len(points))
    some = np.flatnonzero(weights > 0)
    if not len(some):
        return None
    keys = -np.log(_uniform(marks[some], turn)) / weights[some]
    first = np.lexsort((marks[some], keys))[0]
    return float(keys[first]), int(marks[some[first]]), points[some[first]]


def _sums(points: np.ndarray, centres: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums, in units of 2 to the power -bits, and numbers of the points nearest to each centre."""
    labels = _gaps(points, centres).argmin(axis=1)
    total = np.zeros(centres.shape, np.int64)
    np.add.at(total, labels, np.rint(np.ldexp(points, bits)).astype(np.int64))
    return total, np.bincount(labels, minlength=len(centres))


def _rounds(bits: dict, k: int, best, sums) -> dict:
    """Centres of each request of bits; best and sums give a pass over the courses of those whose centres they get."""
    centres = {r: np.zeros((0, 0)) for r in bits}
    moving = set(bits)
    for turn in range(k):
        found = best({r: centres[r] for r in moving}, turn)
        moving &= set(found)
        if not moving:
            break
        for r in moving:
            centres[r] = np.vstack([*centres[r], found[r]])
    moving = set(bits)
    for _ in range(ROUNDS):
        for r, (total, count) in sums({r: centres[r] for r in moving}).items():
            fresh = np.ldexp(total[count > 0] / count[count > 0][:, None], -bits[r])
            if np.array_equal(fresh, centres[r]):
                moving.discard(r)
            centres[r] = fresh
        if not moving:
            break
    return centres


def _fit(points: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """Centres of one request, whose courses are all here."""
    bits = _bits(len(points), float(np.abs(points).max(initial=0.0)))

    def best(centres, turn):
        found = _candidate(points, marks, centres[0], turn)
        return {0: found[2]} if found else {}

    return _rounds({0: bits}, k, best, lambda centres: {0: _sums(points, centres[0], bits)})[0]


def _fit_spread(points: DataFrame, bits: dict, k: int) -> dict:
    """Centres of several requests, numbered by r; points: r, vector, mark."""
    context = points.sparkSession.sparkContext

    def each(batches, centres):
        """(r, its rows' points, marks) of every request in centres, batch by batch."""
        for batch in batches:
            number = batch.column("r").to_numpy()
            matrix, marks = to_matrix(batch.column("vector")), batch.column("mark").to_numpy()
            for r in np.unique(number).tolist():
                if r in centres:
                    rows = number == r
                    yield r, matrix[rows], marks[rows]

    def best(centres, turn):
        shared = context.broadcast(centres)

        def find(batches):
            held = {}
            for r, rows, marks in each(batches, shared.value):
                found = _candidate(rows, marks, shared.value[r], turn)
                if found and (r not in held or found[:2] < held[r][:2]):
                    held[r] = found
            yield pa.record_batch(
                {
                    "r": pa.array(list(held), pa.int32()),
                    "key": pa.array([x[0] for x in held.values()], pa.float64()),
                    "mark": pa.array([x[1] for x in held.values()], pa.int64()),
                    "vector": pa.array([x[2].tolist() for x in held.values()], pa.list_(pa.float64())),
                }
            )

        found = points.mapInArrow(find, "r int, key double, mark long, vector array<double>")
        found = found.groupBy("r").agg(F.min(F.struct("key", "mark", "vector")).alias("first")).collect()  # a row per request
        shared.unpersist()
        return {x.r: np.array(x["first"].vector) for x in found}

    def sums(centres):
        shared = context.broadcast(centres)

        def add(batches):
            held = {}
            for r, rows, _ in each(batches, shared.value):
                total, count = _sums(rows, shared.value[r], bits[r])
                held[r] = (held[r][0] + total, held[r][1] + count) if r in held else (total, count)
            for r, (total, count) in held.items():
                n = len(total)
                yield pa.record_batch(
                    {
                        "r": pa.array([r] * n, pa.int32()),
                        "cluster": pa.array(range(n), pa.int32()),
                        "total": _lists(total),
                        "n": pa.array(count, pa.int64()),
                    }
                )

        def merge(table: pa.Table) -> pa.Table:
            total = np.array(table.column("total").to_pylist(), np.int64).sum(axis=0)
            n = int(table.column("n").to_numpy().sum())
            return table.slice(0, 1).select(["r", "cluster"]).append_column("total", _lists(total[None])).append_column("n", pa.array([n], pa.int64()))

        schema = "r int, cluster int, total array<long>, n long"
        found = points.mapInArrow(add, schema).groupBy("r", "cluster").applyInArrow(merge, schema).collect()  # num_clusters rows per request
        shared.unpersist()
        out = {r: (np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)) for r, c in centres.items()}
        for x in found:
            out[x.r][0][x.cluster], out[x.r][1][x.cluster] = x.total, x.n
        return out

    return _rounds(bits, k, best, sums)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(matrix.ravel()))


def _sizes(recommended: DataFrame) -> DataFrame:
    return recommended.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))


def _with_pieces(recommended: DataFrame, sizes: DataFrame, largest: int) -> DataFrame:
    """Add ``_pieces`` of the request and the row's ``_piece``."""
    if largest <= PIECE:
        return recommended.withColumn("_pieces", F.lit(1).cast("bigint")).withColumn("_piece", F.lit(0).cast("bigint"))
    # Only requests above PIECE rows are listed; the salt spreads each over 32 tasks.
    large = sizes.where(F.col("_n") > PIECE).select(
        "request_id",
        F.ceil(F.col("_n") / PIECE).alias("_pieces"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    salted = recommended.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(large, ["request_id", "_salt"], "left")
        .drop("_salt")
        .withColumn("_pieces", F.coalesce("_pieces", F.lit(1).cast("bigint")))
        .withColumn("_piece", F.pmod(F.xxhash64("_id", F.lit(SEED)), F.col("_pieces")))
    )


def _spread_centres(marked: DataFrame, requests: list, k: int, schema: str) -> DataFrame:
    """request_id, centres of some large requests; marked: request_id, vector, mark of all."""
    spark = marked.sparkSession
    wave = spark.createDataFrame([(x, r) for r, x in enumerate(requests)], f"{schema.partition(',')[0]}, r int")
    points = checkpointed(marked.join(F.broadcast(wave), "request_id").select("r", "vector", "mark"))
    peak = F.array_max(F.transform("vector", F.abs))
    known = points.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.max(peak).alias("peak")).collect()
    found = _fit_spread(points, {x.r: _bits(x.n, x.peak or 0.0) for x in known}, k)
    return spark.createDataFrame([(requests[r], c.tolist()) for r, c in found.items()], schema)


def cluster_requests(recommended: DataFrame, num_clusters: int = 10, seed: int = SEED) -> DataFrame:
    """Add ``cluster``: k-means label of each course among its request's courses.

    Needs (request_id, _id, vector); uses min(rows, num_clusters) clusters.
    """
    sizes = _sizes(recommended)
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    placed = _with_pieces(recommended, sizes, largest)
    request_type = recommended.schema["request_id"].dataType.simpleString()
    marked = placed.select(
        "request_id",
        "_pieces",
        F.col("vector").cast("array<double>").alias("vector"),
        F.xxhash64("_id", F.col("vector").cast("array<double>"), F.lit(seed)).alias("mark"),
    )

    def fit(table: pa.Table) -> pa.Table:
        found = _fit(to_matrix(table.column("vector")), table.column("mark").to_numpy(), num_clusters)
        return pa.table(
            {
                "request_id": table.column("request_id").slice(0, 1),
                "centres": pa.array([found.tolist()], pa.list_(pa.list_(pa.float64()))),
            }
        )

    schema = f"request_id {request_type}, centres array<array<double>>"
    centres = marked.where("_pieces = 1").select("request_id", "vector", "mark").groupBy("request_id").applyInArrow(fit, schema)
    if largest > PIECE:
        # fewer than a row per PIECE courses
        large = [r.request_id for r in sizes.where(F.col("_n") > PIECE).select("request_id").orderBy("request_id").collect()]
        for low in range(0, len(large), KEPT):
            centres = centres.unionByName(_spread_centres(marked, large[low : low + KEPT], num_clusters, schema))

    if largest > PIECE:
        # A large request's centres go to as many tasks as it has pieces.
        pieces = sizes.select("request_id", F.ceil(F.col("_n") / PIECE).alias("_p"))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p") - 1)).alias("_piece")
        centres = centres.join(pieces, "request_id").select("request_id", "centres", copies)
        joined = placed.join(centres, ["request_id", "_piece"])
    else:
        joined = placed.join(centres, "request_id")

    def gap(centre):
        return F.aggregate(
            F.zip_with(centre, F.col("vector"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t
        )

    gaps = F.transform("centres", gap)
    return (
        joined.withColumn("_gaps", gaps)
        .withColumn("cluster", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int"))
        .drop("_pieces", "_piece", "centres", "_gaps")
    )


def deduplicate(recommended: DataFrame, num_clusters: int = 10, seed: int = SEED) -> DataFrame:
    """Best course by ``weighted_score`` of each cluster, per request.

    The input is stored first, as counting, clustering and the final pick read it.
    """
    held = checkpointed(recommended)
    narrow = held.select("request_id", "_id", "vector", "weighted_score")
    labelled = cluster_requests(narrow, num_clusters, seed).drop("vector")
    best = best_per_group(labelled, ["request_id", "cluster"], "weighted_score", "_id")
    return held.join(best.select("request_id", "_id", "cluster"), ["request_id", "_id"])
