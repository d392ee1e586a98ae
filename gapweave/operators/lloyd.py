"""K-means for several numbers of clusters at once, and the silhouettes of squared distances.

Every step is one pass over the points, whatever the number of clusterings: the start draws
candidates in a few rounds of oversampling (k-means||), and a round of Lloyd's updates the
centres of all clusterings that still move. A task sends sums per cluster, never points, and
the sums are exact, so the partitioning does not change the answer.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.blocks import _grid, bounded_table, steps, to_matrix
from gapweave.operators.dedup import _bits, _gaps, _lists, _uniform
from gapweave.operators.lineage import checkpointed

#: Candidates drawn in each of so many rounds of the start, or twice the clusters if that is more.
DRAWS = 32
DRAW_ROUNDS = 5
#: Rounds over the candidates, which the driver holds (at most 1 + DRAW_ROUNDS * max(DRAWS, 2k)).
LOCAL_ROUNDS = 30
#: Rounds over the points at most; a clustering stops once its centres move by less than TOLERANCE of the mean variance.
ROUNDS = 300
TOLERANCE = 1e-4
#: Sums that a task holds before it sends them.
HELD = 4096


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, the first of equal ones; the same in any batch.

    A matrix product finds it; where the two best are too near for its rounding they are compared exactly.
    """
    if len(centres) == 1 or not len(points):
        return np.zeros(len(points), np.int64)
    squares = (centres * centres).sum(axis=1)
    gaps = squares - 2.0 * points @ centres.T
    found = gaps.argmin(axis=1)
    two = np.partition(gaps, 1, axis=1)
    scale = np.abs(two).max(axis=1) + squares.max() + (points * points).sum(axis=1)
    close = np.flatnonzero(two[:, 1] - two[:, 0] <= 1e-11 * scale)
    if len(close):
        found[close] = _gaps(points[close], centres).argmin(axis=1)
    return found


def _drawn(points: DataFrame, chosen: np.ndarray, draws: int, turn: int) -> np.ndarray:
    """The vectors of ``draws`` points, drawn without replacement by squared distance to ``chosen``."""
    shared = points.sparkSession.sparkContext.broadcast(chosen)

    def draw(batches):
        best = None
        for batch in batches:
            rows, marks, held = to_matrix(batch.column("vector")), batch.column("mark").to_numpy(), shared.value
            weights = _gaps(rows, held).min(axis=1) if len(held) else np.ones(len(rows))
            some = np.flatnonzero(weights > 0)
            keys = -np.log(_uniform(marks[some], turn)) / weights[some]
            first = np.lexsort((marks[some], keys))[:draws]
            found = pa.table({"key": keys[first], "mark": marks[some][first], "vector": _lists(rows[some[first]])})
            best = found if best is None else pa.concat_tables([best, found]).sort_by([("key", "ascending"), ("mark", "ascending")]).slice(0, draws)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = points.mapInArrow(draw, "key double, mark long, vector array<double>").orderBy("key", "mark").limit(draws).collect()
    shared.unpersist()
    return np.array([r.vector for r in found]) if found else chosen[:0]


def _weights(points: DataFrame, candidates: np.ndarray) -> np.ndarray:
    """Points nearest to each candidate."""
    shared = points.sparkSession.sparkContext.broadcast(candidates)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            total += np.bincount(nearest(to_matrix(batch.column("vector")), shared.value), minlength=len(total))
        yield pa.record_batch({"place": np.arange(len(total)), "n": total})

    out = np.zeros(len(candidates))
    for row in points.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row.place] = row.n
    shared.unpersist()
    return out


def _among(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres of the weighted candidates: k-means++ and Lloyd's rounds."""
    marks = np.arange(1, len(candidates) + 1, dtype=np.int64) * 1_000_003 + seed
    centres = candidates[:0]
    for turn in range(k):
        far = weights * (_gaps(candidates, centres).min(axis=1) if len(centres) else 1.0)
        some = np.flatnonzero(far > 0)
        if not len(some):
            break
        winner = some[np.argmin(-np.log(_uniform(marks[some], turn)) / far[some])]
        centres = np.vstack([centres, candidates[winner : winner + 1]])
    for _ in range(LOCAL_ROUNDS):
        member = np.eye(len(centres))[nearest(candidates, centres)] * weights[:, None]
        size = member.sum(axis=0)
        fresh = (member.T @ candidates)[size > 0] / size[size > 0][:, None]
        if fresh.shape == centres.shape and np.allclose(fresh, centres, rtol=0, atol=1e-12):
            break
        centres = fresh
    return centres


def _starts(points: DataFrame, sizes: list[int], seed: int) -> dict[int, np.ndarray]:
    draws = max(DRAWS, 2 * max(sizes))
    chosen = _drawn(points, np.zeros((0, 0)), 1, 0)
    for turn in range(1, DRAW_ROUNDS + 1):
        found = _drawn(points, chosen, draws, turn)
        if not len(found):
            break
        chosen = np.vstack([chosen, found])
    weights = _weights(points, chosen)
    return {k: _among(chosen, weights, k, seed) for k in sizes}


def _sums(points: DataFrame, centres: dict[int, np.ndarray], bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each clustering, exact sums in units of 2 to the power -bits and numbers of the points nearest to each centre."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def add(batches):
        totals = {k: np.zeros(c.shape, np.int64) for k, c in shared.value.items()}
        counts = {k: np.zeros(len(c), np.int64) for k, c in shared.value.items()}
        for batch in batches:
            rows = to_matrix(batch.column("vector"))
            if not len(rows):
                continue
            whole = np.rint(np.ldexp(rows, bits)).astype(np.int64)
            for k, c in shared.value.items():
                labels = nearest(rows, c)
                order = np.argsort(labels, kind="stable")
                present, first = np.unique(labels[order], return_index=True)
                totals[k][present] += np.add.reduceat(whole[order], first)
                counts[k] += np.bincount(labels, minlength=len(c))
        for k, c in shared.value.items():
            some = np.flatnonzero(counts[k])
            yield pa.record_batch(
                {
                    "k": pa.array(np.full(len(some), k, np.int32)),
                    "cluster": pa.array(some.astype(np.int32)),
                    "total": _lists(totals[k][some]),
                    "n": pa.array(counts[k][some]),
                }
            )

    def merge(table: pa.Table) -> pa.Table:
        total = table.column("total").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        n = int(table.column("n").to_numpy().sum())
        return table.slice(0, 1).select(["k", "cluster"]).append_column("total", _lists(total[None])).append_column("n", pa.array([n], pa.int64()))

    schema = "k int, cluster int, total array<long>, n long"
    out = {k: (np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)) for k, c in centres.items()}
    for x in points.mapInArrow(add, schema).groupBy("k", "cluster").applyInArrow(merge, schema).collect():  # sum of sizes rows
        out[x.k][0][x.cluster], out[x.k][1][x.cluster] = x.total, x.n
    shared.unpersist()
    return out


def _extent(points: DataFrame) -> tuple[int, float, float]:
    """Rows, largest absolute value and mean variance of the vectors' places."""

    def measure(batches):
        for batch in batches:
            rows = to_matrix(batch.column("vector"))
            if len(rows):
                yield pa.record_batch(
                    {"n": [len(rows)], "peak": [float(np.abs(rows).max())], "total": _lists(rows.sum(axis=0)[None]), "squares": [float((rows * rows).sum())]}
                )

    def merge(table: pa.Table) -> pa.Table:
        n = int(table.column("n").to_numpy().sum())
        total = to_matrix(table.column("total"))
        spread = (table.column("squares").to_numpy().sum() - (total.sum(axis=0) ** 2).sum() / n) / n / total.shape[1]
        return pa.table({"n": pa.array([n], pa.int64()), "peak": [float(table.column("peak").to_numpy().max())], "spread": [float(max(spread, 0.0))]})

    parts = points.mapInArrow(measure, "n long, peak double, total array<double>, squares double")
    found = parts.groupBy().applyInArrow(merge, "n long, peak double, spread double").first()  # a row per batch
    return (found.n, found.peak, found.spread) if found else (0, 0.0, 0.0)


def fits(points: DataFrame, sizes: list[int], seed: int = 0) -> dict[int, np.ndarray]:
    """Centres of a k-means clustering of (id, vector) for each of ``sizes``; fewer than k where fewer vectors differ.

    Rows without a vector are left out. The table is read about DRAW_ROUNDS + rounds times: store it first.
    Clusterings that have not settled after ``ROUNDS`` rounds are named in a warning.
    """
    rows = points.where(F.col("vector").isNotNull()).select(
        F.xxhash64("id", F.lit(seed)).alias("mark"), F.col("vector").cast("array<double>").alias("vector")
    )
    n, peak, spread = _extent(rows)
    if not n or not sizes:
        return {k: np.zeros((0, 0)) for k in sizes}
    bits = _bits(n, peak)
    centres = _starts(rows, list(sizes), seed)
    moving = set(sizes)
    for _ in range(ROUNDS):
        for k, (total, count) in _sums(rows, {k: centres[k] for k in moving}, bits).items():
            fresh = np.ldexp(total[count > 0] / count[count > 0][:, None], -bits)
            if fresh.shape == centres[k].shape and ((fresh - centres[k]) ** 2).sum() <= TOLERANCE * spread:
                moving.discard(k)
            centres[k] = fresh
        if not moving:
            break
    if moving:
        import warnings

        warnings.warn(f"k-means for {sorted(moving)} clusters still moved after {ROUNDS} rounds", stacklevel=2)
    return centres


def labelled(points: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """points (id, vector, ...) with labels, the nearest centre under each clustering; null without a vector."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    names = points.columns
    schema = points.select("*", F.lit(None).cast("array<int>").alias("labels")).schema

    def label(batches):
        for batch in batches:
            column = batch.column(names.index("vector"))
            held = np.flatnonzero(np.asarray(column.is_valid()))
            out = [None] * batch.num_rows
            if len(held):
                rows = to_matrix(column.take(pa.array(held)))
                found = np.stack([nearest(rows, c) for c in shared.value], axis=1).tolist()
                for i, place in enumerate(held.tolist()):
                    out[place] = found[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*names, "labels"])

    return points.mapInArrow(label, schema)


def _cluster_sums(rows: DataFrame) -> DataFrame:
    """cluster key, vector (summed), n, squares (summed squared lengths) of each cluster of each clustering."""
    schema = "_key long, clustering int, cluster int, vector array<double>, n long, squares double"

    def sent(held):
        keys = list(held)
        return pa.record_batch(
            {
                "_key": pa.array([c << 32 | g & 0xFFFFFFFF for c, g in keys], pa.int64()),
                "clustering": pa.array([c for c, _ in keys], pa.int32()),
                "cluster": pa.array([g for _, g in keys], pa.int32()),
                "vector": _lists(np.array([held[x][0] for x in keys])),
                "n": pa.array([held[x][1] for x in keys], pa.int64()),
                "squares": pa.array([held[x][2] for x in keys], pa.float64()),
            }
        )

    def add(batches):
        held = {}
        for batch in batches:
            own, labels = to_matrix(batch.column("vector")), to_matrix(batch.column("labels")).astype(np.int64)
            if not len(own):
                continue
            lengths = (own * own).sum(axis=1)
            for c in range(labels.shape[1]):
                order = np.argsort(labels[:, c], kind="stable")
                present, first, sizes = np.unique(labels[order, c], return_index=True, return_counts=True)
                totals, squares = np.add.reduceat(own[order], first), np.add.reduceat(lengths[order], first)
                for i, g in enumerate(present.tolist()):
                    old = held.get((c, g), (0.0, 0, 0.0))
                    held[c, g] = (old[0] + totals[i], old[1] + int(sizes[i]), old[2] + float(squares[i]))
                if len(held) >= HELD:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    def merge(table: pa.Table) -> pa.Table:
        out = table.slice(0, 1).select(["_key", "clustering", "cluster"])
        out = out.append_column("vector", _lists(to_matrix(table.column("vector")).sum(axis=0)[None]))
        out = out.append_column("n", pa.array([int(table.column("n").to_numpy().sum())], pa.int64()))
        return out.append_column("squares", pa.array([float(table.column("squares").to_numpy().sum())], pa.float64()))

    return rows.mapInArrow(add, schema).groupBy("_key").applyInArrow(merge, schema)


def linear_silhouettes(points: DataFrame) -> DataFrame:
    """(id, clustering, cluster, silhouette) of (id, vector, labels), from squared distances in linear time.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum and summed squared
    length, so a point meets clusters, not points. One label per clustering; rows without a vector are left out,
    a cluster of one point counts 0, as does a clustering of one cluster. The clusters' sums go to every task while they are at
    most ``blocks.MAX_BLOCK_ROWS`` (counted), else points and clusters meet block by block.
    """
    rows = points.where(F.col("vector").isNotNull()).select(
        "id", F.col("vector").cast("array<double>").alias("vector"), F.col("labels").cast("array<int>").alias("labels")
    )
    sums = checkpointed(_cluster_sums(rows))
    count = sums.count()
    held = bounded_table(sums, rows=count)

    def compare(batches, right):
        if right.num_rows == 0:
            return
        total, n = to_matrix(right.column("vector")), right.column("n").to_numpy()
        squares, cluster, clustering = (right.column(x).to_numpy() for x in ("squares", "cluster", "clustering"))
        for batch in steps(batches, len(n)):
            own, labels = to_matrix(batch.column("vector")), to_matrix(batch.column("labels")).astype(np.int64)
            gaps = np.maximum((own * own).sum(axis=1)[:, None] * n + squares - 2.0 * own @ total.T, 0.0)
            for c in np.unique(clustering).tolist():
                at = np.flatnonzero(clustering == c)
                same = labels[:, c][:, None] == cluster[at]
                inside, place = same.any(axis=1), same.argmax(axis=1)
                size = np.where(inside, n[at][place], 0)
                a = np.where(size > 1, gaps[:, at][np.arange(len(own)), place] / np.maximum(size - 1, 1), np.nan)
                b = np.where(same, np.inf, gaps[:, at] / n[at]).min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(np.full(len(own), c, np.int32)),
                        pa.array(labels[:, c].astype(np.int32)),
                        pa.array(size.astype(np.int64), mask=~inside),
                        pa.array(a, mask=size <= 1),
                        pa.array(b, mask=np.isinf(b)),
                    ],
                    names=["id", "clustering", "cluster", "own_size", "a", "b"],
                )

    schema = "id bigint, clustering int, cluster int, own_size bigint, a double, b double"
    if held is not None:
        shared = points.sparkSession.sparkContext.broadcast(held)
        sides = rows.mapInArrow(lambda batches: compare(batches, shared.value), schema)
    else:
        parts = _grid(rows, sums, count, compare, schema)
        sides = parts.groupBy("id", "clustering", "cluster").agg(F.max("own_size").alias("own_size"), F.max("a").alias("a"), F.min("b").alias("b"))
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    # no other cluster: greatest() would ignore the missing side
    value = F.when((F.col("own_size") == 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))
    return sides.select("id", "clustering", "cluster", value.alias("silhouette"))
