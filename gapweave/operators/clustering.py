"""Clustering of skill vectors and its quality measures."""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from gapweave.operators import blocks as comparing, lloyd
from gapweave.operators.blocks import against_all, steps, to_matrix, unit_rows
from gapweave.operators.forests import roots, unite
from gapweave.operators.lineage import checkpointed
from gapweave.operators.pivots import against_near, blocked, radius
from gapweave.operators.ranking import rank_within
from gapweave.operators.similarity import knn

LIST_ROWS = 1000


def _features(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))


def _stable_labels(labelled: DataFrame) -> DataFrame:
    """Number clusters by their smallest id; there are at most k of them."""
    firsts = labelled.groupBy("cluster").agg(F.min("id").alias("_first"))
    place = F.row_number().over(Window.orderBy("_first")) - 1
    numbered = firsts.select("cluster", place.cast("int").alias("_number"))
    return (
        labelled.join(F.broadcast(numbered), "cluster")
        .withColumn("cluster", F.col("_number"))
        .drop("_number")
    )


def _fit(points: DataFrame, maker, k: int) -> DataFrame:
    """(id, vector, cluster) for k clusters, or fewer when there are fewer points."""
    k = min(k, points.limit(k).count())
    if k <= 1:
        return points.withColumn("cluster", F.lit(0))
    features = _features(points)
    model = maker(k).fit(features)
    labelled = model.transform(features).withColumnRenamed("prediction", "cluster").drop("features")
    return _stable_labels(labelled)


def kmeans(points: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """K-means over (id, vector)."""
    return _fit(points, lambda n: KMeans(k=n, seed=seed, solver="row"), k)


def hierarchical(points: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Top-down hierarchical clustering (bisecting k-means)."""
    return _fit(points, lambda n: BisectingKMeans(k=n, seed=seed), k)


def silhouettes(points: DataFrame) -> DataFrame:
    """Exact Euclidean silhouette of each point under several clusterings at once.

    ``points`` is (id, vector, labels), one label per clustering; gives (id,
    clustering, cluster, silhouette). All clusterings share one pass over the
    distances, and a task sends, per point, its summed distance to each cluster;
    never a pair.
    """
    rows = points.select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("labels").cast("array<int>").alias("labels"))

    def sums(batches, right):
        if right.num_rows == 0:
            return
        others = to_matrix(right.column("vector"))
        squares = (others * others).sum(axis=1)
        other_ids = right.column("id").to_numpy()
        members = []
        for column in to_matrix(right.column("labels")).T:
            clusters, codes = np.unique(column, return_inverse=True)
            member = np.zeros((len(codes), len(clusters)))
            member[np.arange(len(codes)), codes] = 1.0
            members.append((clusters.astype(np.int32), member))
        for batch in steps(batches, len(others)):
            own = to_matrix(batch.column("vector"))
            gaps = (own * own).sum(axis=1)[:, None] - 2.0 * own @ others.T + squares
            ids = batch.column("id").to_numpy()
            gaps[ids[:, None] == other_ids[None, :]] = 0.0
            gaps = np.sqrt(np.maximum(gaps, 0.0))
            labels = to_matrix(batch.column("labels")).astype(np.int32)
            for i, (clusters, member) in enumerate(members):
                n, width = len(own), len(clusters)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, width)),
                        pa.array(np.full(n * width, i, np.int32)),
                        pa.array(np.repeat(labels[:, i], width)),
                        pa.array(np.tile(clusters, n)),
                        pa.array((gaps @ member).ravel()),
                    ],
                    names=["id", "clustering", "cluster", "other", "total"],
                )

    summed = against_all(rows, rows, sums, "id bigint, clustering int, cluster int, other int, total double")
    sizes = (
        rows.select(F.posexplode("labels").alias("clustering", "other"))
        .groupBy("clustering", "other")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    same = F.col("cluster") == F.col("other")
    per_cluster = (
        summed.groupBy("id", "clustering", "cluster", "other")
        .agg(F.sum("total").alias("total"))
        .join(sizes, ["clustering", "other"])
    )
    sides = per_cluster.groupBy("id", "clustering", "cluster").agg(
        F.max(F.when(same, F.col("size"))).alias("own_size"),
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"),
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    value = F.when(F.col("own_size") == 1, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))
    return sides.select("id", "clustering", "cluster", value.alias("silhouette"))


def silhouette_points(points: DataFrame) -> DataFrame:
    """Exact silhouette of each point of (id, vector, cluster)."""
    one = points.select("id", "vector", F.array("cluster").alias("labels"))
    return silhouettes(one).drop("clustering")


def silhouette_exact(points: DataFrame) -> DataFrame:
    return silhouette_points(points).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_fast(points: DataFrame) -> DataFrame:
    """Silhouette on squared distances: one linear pass, but a different number."""
    value = ClusteringEvaluator(predictionCol="cluster").evaluate(_features(points))
    return points.sparkSession.range(1).select(F.lit(float(value)).alias("silhouette"))


def _swept(points: DataFrame, max_clusters: int, seed: int) -> tuple[list[int], DataFrame]:
    """The numbers of clusters tried, and the stored points with a label under each of them."""
    held = checkpointed(points)
    sizes = list(range(2, min(max_clusters, held.limit(max_clusters + 1).count() - 1) + 1))
    if not sizes:
        return [], held
    centres = lloyd.fits(held, sizes, seed)
    return sizes, checkpointed(lloyd.labelled(held, [centres[k] for k in sizes]).where(F.col("labels").isNotNull()))


def _scores(sizes: list[int], stored: DataFrame, fast: bool) -> list[tuple[int, float]]:
    if not sizes:
        return []
    found = lloyd.linear_silhouettes(stored) if fast else silhouettes(stored)
    means = {r.clustering: r["mean"] for r in found.groupBy("clustering").agg(F.avg("silhouette").alias("mean")).collect()}
    return [(k, means.get(i, 0.0)) for i, k in enumerate(sizes)]


def sweep(points: DataFrame, max_clusters: int = 10, seed: int = 0, fast: bool = True) -> list[tuple[int, float]]:
    """(k, silhouette) for k = 2 .. max_clusters, at most one less than the points.

    All k are fitted together (``lloyd``). The silhouettes are of squared distances, in linear time;
    ``fast=False`` takes the exact Euclidean ones, which compare all points with all others.
    """
    return _scores(*_swept(points.select("id", "vector"), max_clusters, seed), fast)


def best_k(scores: list[tuple[int, float]]) -> int:
    """The first k with the highest silhouette; 1 when nothing could be compared."""
    return max(scores, key=lambda s: (s[1], -s[0]))[0] if scores else 1


def cluster_skills(skills: DataFrame, max_clusters: int = 10, seed: int = 0, fast: bool = True) -> DataFrame:
    """Cluster (id, skill, vector) with the best k and list each cluster's members."""
    sizes, stored = _swept(skills.select("id", "skill", "vector"), max_clusters, seed)
    scores = _scores(sizes, stored, fast)
    place = sizes.index(best_k(scores)) if scores else None
    cluster = F.lit(0) if place is None else F.col("labels")[place]
    return member_lists(_stable_labels(stored.withColumn("cluster", cluster)), "skill", "id")


def member_lists(labelled: DataFrame, member: str, position: str, rows: int = LIST_ROWS) -> DataFrame:
    """Members of each cluster in the order of ``position``, as lists of at most ``rows`` members.

    Part p holds the members at places p*rows .. p*rows + rows - 1 of the cluster, whatever
    their positions are; only a cluster of more than ``rows`` members has several parts.
    """
    ranked = rank_within(labelled.select("cluster", position, member), ["cluster"], [F.col(position), F.col(member)], "_place")
    part = F.floor((F.col("_place") - 1) / rows).alias("part")
    ordered = F.sort_array(F.collect_list(F.struct("_place", F.col(member).alias("member"))))
    return ranked.groupBy("cluster", part).agg(F.transform(ordered, lambda r: r.getField("member")).alias("members"))


def _least_dot(eps: float, digits: int) -> float:
    """The smallest product of two directions whose cosine distance, rounded, is at most eps (exact, found by halving)."""
    near = lambda dot: np.round(1.0 - np.array([dot]), digits)[0] <= eps
    low, high = -4.0, 4.0
    if near(low) or not near(high):
        return -np.inf if near(low) else np.inf
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if near(middle) else (middle, high)
    return high


def _units(table) -> np.ndarray:
    return unit_rows(to_matrix(table.column("vector")))


def _for_each(points: DataFrame, others: DataFrame, rows: tuple[int, int], summary, schema: str, compare) -> DataFrame:
    """(id, value): a summary of the others near each of points, in parts that the caller merges.

    summary is (start, merge, part): part(directions of points, table of others) gives a value a point, and merge puts two
    together; a point that keeps the start value is left out. Where the points are few they go to every task,
    and the others stream past without a shuffle. rows: how many points and others there are.
    """
    start, merge, part = summary
    names = [f.split()[0] for f in schema.split(", ")]

    def found(ids, values):
        some = values != start
        return pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(values[some], pa.int64())], names=names)

    def past_points(batches, right):
        if right.num_rows == 0:
            return
        own, values = _units(right), np.full(right.num_rows, start)
        for batch in steps(batches, len(own)):
            values = merge(values, part(own, batch, _units(batch)))
        yield found(right.column("id").to_numpy(), values)

    def past_others(batches, right):
        if right.num_rows == 0:
            return
        unit = _units(right)
        for batch in steps(batches, len(unit)):
            yield found(batch.column("id").to_numpy(), merge(np.full(batch.num_rows, start), part(_units(batch), right, unit)))

    if rows[0] <= comparing.MAX_BLOCK_ROWS:
        return against_all(others, points, past_points, schema, rows=rows[0])
    return compare(points, others, past_others, schema, rows[1])


def _count_near(points: DataFrame, others: DataFrame, rows: tuple[int, int], least: float, compare) -> DataFrame:
    """(id, near): how many of the others are near each of points (id, vector); a point without any is left out."""
    counted = (0, np.add, lambda unit, _, other: np.count_nonzero(unit @ other.T >= least, axis=1))
    return _for_each(points, others, rows, counted, "id bigint, near bigint", compare).groupBy("id").agg(F.sum("near").alias("near"))


def _smallest_near(points: DataFrame, core: DataFrame, rows: tuple[int, int], least: float, compare) -> DataFrame:
    """Smallest label among the core points (id, vector, label) near each of points (id, vector); a point without any is left out."""
    none = np.iinfo(np.int64).max

    def part(unit, table, other):
        labels = table.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        near = unit @ other[order].T >= least
        first = near.argmax(axis=1)
        return np.where(near[np.arange(len(near)), first], labels[order][first], none)

    found = _for_each(points, core, rows, (none, np.minimum, part), "id bigint, label bigint", compare)
    return found.groupBy("id").agg(F.min("label").alias("label"))


def _joins(least: float):
    """Work that finds which labels of the left batches and of the right table have points near each other, as the edges of a forest."""

    def work(batches, right):
        if right.num_rows == 0:
            return
        edges = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["label", "other"])
        others = _units(right)
        names, theirs = np.unique(right.column("label").to_numpy(), return_inverse=True)
        width = len(names)
        parent = np.arange(width)
        for batch in steps(batches, len(others)):
            labels, places = np.unique(batch.column("label").to_numpy(), return_inverse=True)
            known = np.minimum(np.searchsorted(names, labels), width - 1)
            fresh = names[known] != labels
            node = np.where(fresh, width + np.cumsum(fresh) - 1, known)
            parent = np.concatenate([parent, np.arange(width, width + fresh.sum())])
            own = node[places]
            near = _units(batch) @ others.T >= least
            # Few pairs are united at once; of many, a row's first one with another root, until no pair has two.
            while np.count_nonzero(near) > near.size // 64:
                near &= parent[own][:, None] != parent[theirs]
                first = near.argmax(axis=1)
                some = near[np.arange(len(near)), first]
                unite(parent, own[some], theirs[first[some]])
            mine, met = np.nonzero(near)
            unite(parent, own[mine], theirs[met])
            linked = fresh & (parent[node] < width)
            yield edges(labels[linked], names[parent[node[linked]]])
            parent = parent[:width]
        moved = parent != np.arange(width)
        yield edges(names[moved], names[parent[moved]])

    return work


def _compare_near(rows: DataFrame, count: int, eps: float, digits: int):
    """How dbscan compares more points than fit a task: blocks that may hold neighbours, found when first needed.

    Below a distance of 1 neighbours are at an acute angle, and a zero vector has none.
    """
    found = []

    def compare(left, right, work, schema, right_rows):
        if right_rows <= comparing.MAX_BLOCK_ROWS or eps >= 1.0:
            return against_all(left, right, work, schema, rows=right_rows)
        if not found:
            found.append(blocked(rows, radius(eps, digits), count))
        if found[0] is None:
            return against_all(left, right, work, schema, rows=right_rows)
        return against_near(left, right, work, schema, found[0])

    return compare


def _part(parts: int):
    """Number of the part of about MAX_BLOCK_ROWS rows that a row is in, by a hash of its id."""
    return F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts))


def _dense(rows: DataFrame, count: int, least: float, min_samples: int, compare) -> DataFrame:
    """(key, near) of rows (id, key, vector): how many rows are near those of each key; exact below min_samples, else min_samples at least.

    The rows meet one part of the table after another, and those with neighbours enough drop out. Once few are left,
    or a part settles less than half of them, they meet all parts that are left at once.
    """
    parts = max(1, -(-count // comparing.MAX_BLOCK_ROWS))
    # a null key is no point of the result, but a neighbour of others
    open_, left = rows.where(F.col("key").isNotNull()).withColumn("near", F.lit(0).cast("bigint")), count
    schema = f"id bigint, key bigint, vector {rows.schema['vector'].dataType.simpleString()}, near bigint"
    settled = []

    def add(batches, right):
        unit = _units(right) if right.num_rows else None
        for batch in steps(batches, right.num_rows):
            near = batch.column("near").to_numpy()
            if unit is not None:
                near = near + np.count_nonzero(_units(batch) @ unit.T >= least, axis=1)
            kept = pa.array(np.arange(len(near)), mask=near >= min_samples)  # settled rows leave their vectors
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), batch.column("vector").take(kept), pa.array(near)], schema=batch.schema)

    done = 0
    while left > comparing.MAX_BLOCK_ROWS and done < parts:
        held = rows.where(_part(parts) == done).select("id", "vector").toArrow()  # about MAX_BLOCK_ROWS rows
        added = checkpointed(against_all(open_, held, add, schema, held=held))
        done += 1
        settled.append(added.where(F.col("near") >= min_samples).select("key", "near"))
        open_ = added.where(F.col("near") < min_samples)
        was, left = left, open_.count()
        if 2 * left > was:
            break
    if left and done < parts:
        others = rows.where(_part(parts) >= done)
        more = _count_near(open_, others, (left, count), least, compare).withColumnRenamed("near", "_more")
        open_ = open_.join(more, "id", "left").withColumn("near", F.col("near") + F.coalesce("_more", F.lit(0)))
    every = open_.select("key", "near")
    for some in settled:
        every = every.unionByName(some)
    return checkpointed(every.groupBy("key").agg(F.sum("near").alias("near")))


def _joined(core: DataFrame, count: int, least: float, compare) -> DataFrame:
    """(key, label) of the core points (id, key, vector): one label for all keys that hang together by near points.

    The points meet one part of the table after another, and what is found near goes into one cluster. Points of the
    largest cluster need no more comparisons with each other: only those outside it meet the next part, and
    once they are few, or a part takes in less than half of them, all points.
    """
    parts = max(1, -(-count // comparing.MAX_BLOCK_ROWS))
    schema = "label bigint, other bigint"
    work = _joins(least)
    labels = core.select("key").distinct().withColumn("label", F.col("key"))
    marked = core.select("id", "vector", F.col("key").alias("label"))
    outside, left = marked, count

    def merged(edges):
        return checkpointed(labels.join(roots(edges), "label", "left").select("key", F.coalesce("root", "label").alias("label")))

    for part in range(parts):
        held = marked.where(_part(parts) == part).toArrow()  # about MAX_BLOCK_ROWS rows
        labels = merged(against_all(outside, held, work, schema, held=held))
        if parts == 1:
            return labels
        marked = checkpointed(core.join(labels, "key").select("id", "vector", "label"))
        sizes = marked.groupBy("label").count()
        largest = sizes.agg(F.max_by("label", "count")).first()[0]
        outside = marked.where(F.col("label") != largest)
        was, left = left, outside.count()
        if left <= comparing.MAX_BLOCK_ROWS or 2 * left > was:
            break
    if not left:
        return labels
    if left <= comparing.MAX_BLOCK_ROWS:
        return merged(against_all(marked, outside, work, schema, rows=left))
    return merged(compare(outside, marked, work, schema, count))


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 2, digits: int = 9) -> DataFrame:
    """Density clusters by cosine distance over (id, vector): (id, cluster), noise -1.

    A point counts itself. The answer is exact, but few pairs need to be compared for it: a point is dense as soon as
    min_samples near it are found, and two points that are known to hang together are not compared
    again (``_dense``, ``_joined``). So the work beyond some parts of the table grows with the points that are
    noise or outside the largest cluster, times all points. Neighbour pairs are never stored. Where points of that kind are too many for one
    task they are cut into blocks, and blocks that cannot hold neighbours are not compared (``pivots``).
    Clusters are numbered by their smallest core id, and a border point joins the
    first cluster that reaches it.
    """
    # floats travel as they are, and are widened where they are compared
    narrow = points.schema["vector"].dataType.simpleString() == "array<float>"
    named = points.select(F.col("id").cast("bigint").alias("key"), F.col("vector").cast("array<float>" if narrow else "array<double>").alias("vector"))
    # keys may repeat: rows have a number of their own
    rows = checkpointed(named.where(F.col("vector").isNotNull()).select(F.monotonically_increasing_id().alias("id"), "key", "vector"))
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if count > comparing.MAX_BLOCK_ROWS and rows.rdd.getNumPartitions() < cores:
        rows = checkpointed(rows.repartition(2 * cores))  # a table may come as one task
    least = _least_dot(eps, digits)
    compare = _compare_near(rows, count, eps, digits)
    near = _dense(rows, count, least, min_samples, compare)
    core = checkpointed(rows.join(near.where(F.col("near") >= min_samples).select("key"), "key", "left_semi").select("id", "key", "vector"))
    rows_core = core.count()
    labels = _joined(core, rows_core, least, compare)
    first = labels.groupBy("label").agg(F.min("key").alias("first"))  # a cluster's name is its smallest core id
    labels = checkpointed(labels.join(first, "label").select("key", F.col("first").alias("label")))
    # a point that is near itself only has no cluster to join
    outside = checkpointed(rows.join(near.where(F.col("near") < min_samples).where(F.col("near") > 1).select("key"), "key", "left_semi").select("id", "key", "vector"))
    reached = _smallest_near(outside, core.join(labels, "key"), (outside.count(), rows_core), least, compare)
    border = outside.join(reached, "id").groupBy("key").agg(F.min("label").alias("label"))
    numbers = rank_within(labels.select("label").distinct(), [], [F.col("label")], "number")
    placed = core.select("key").join(labels, "key").unionByName(border).join(numbers, "label")
    found = placed.select(F.col("key").alias("id"), (F.col("number") - 1).cast("int").alias("cluster"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def spectral(points: DataFrame, k: int = 5, neighbors: int = 10) -> DataFrame:
    """Power-iteration clustering of the symmetric nearest-neighbour graph.

    Gives (id, cluster) for every point; -1 for one without a neighbour of positive
    score or without a vector. Every point is searched against all others exactly.
    """
    courses = points.select(F.col("id").alias("_id"), "vector")
    asked = points.select(F.col("id").cast("string").alias("skill"), "vector")
    # One more than asked for, as each point finds itself.
    found = knn(courses, asked, neighbors + 1).select(F.col("skill").cast("bigint").alias("src"), F.col("_id").alias("dst"), "score")
    pairs = found.where("src <> dst and score > 0").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score"
    )
    edges = pairs.groupBy("src", "dst").agg((F.sum("score") / 2).alias("weight"))
    held = checkpointed(edges)
    out = PowerIterationClustering(k=k, weightCol="weight").assignClusters(held)
    return points.select("id").join(out.select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
