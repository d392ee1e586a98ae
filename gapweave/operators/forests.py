"""What hangs together: trees of numbered nodes in one task, and classes of a table of edges."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.lineage import checkpointed

#: Edges that the driver follows at once; more are contracted over all tasks first.
FEW_EDGES = 1 << 18


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put a[i] and b[i] into one tree, for every i. parent names each node's root, the least node of its tree."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _followed(edges: pa.Table) -> pa.Table:
    """label, root: the least label that each label of the edges hangs together with."""
    ends = np.concatenate([edges.column("label").to_numpy(), edges.column("other").to_numpy()])
    names, nodes = np.unique(ends, return_inverse=True)
    parent = np.arange(len(names))
    unite(parent, nodes[: edges.num_rows], nodes[edges.num_rows :])
    return pa.table({"label": pa.array(names, pa.int64()), "root": pa.array(names[parent], pa.int64())})


def roots_of_hooks(hooks: DataFrame) -> DataFrame:
    """(label, root) from (label, parent), where each cluster names its smallest neighbour.

    Such names form trees whose only cycles are two clusters naming each other; the
    smaller of the two, which is the smallest of its tree, becomes the root. Each step doubles the way up, on one row per cluster.
    """
    up = lambda df: df.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
    pairs = hooks.join(up(hooks), "parent", "left")
    root = (F.col("above") == F.col("label")) & (F.col("label") < F.col("parent"))
    hooks = checkpointed(pairs.select("label", F.when(root, F.col("label")).otherwise(F.col("parent")).alias("parent")))
    while True:
        jumped = hooks.join(up(hooks), "parent", "left").select("label", F.coalesce("above", "parent").alias("above"), "parent")
        jumped = checkpointed(jumped)
        hooks = jumped.select("label", F.col("above").alias("parent"))
        if jumped.where("above <> parent").isEmpty():
            return hooks.withColumnRenamed("parent", "root")


def roots(edges: DataFrame) -> DataFrame:
    """(label, root) of the edges (label, other): one root for all labels that hang together.

    While there are more than FEW_EDGES, each label is hooked to the smallest other one that it has an edge
    with, and what hangs together by that becomes one, so that at most half of those with an edge remain.
    """
    spark = edges.sparkSession
    steps = []
    while True:
        edges = checkpointed(edges.where("label <> other").distinct())
        if edges.count() <= FEW_EDGES:
            break
        both = edges.unionByName(edges.select(F.col("other").alias("label"), F.col("label").alias("other")))
        step = roots_of_hooks(checkpointed(both.groupBy("label").agg(F.min("other").alias("parent"))))
        steps.append(step)
        ends = {c: step.select(F.col("label").alias(c), F.col("root").alias(f"_{c}")) for c in ("label", "other")}
        edges = edges.join(ends["label"], "label").join(ends["other"], "other").select(F.col("_label").alias("label"), F.col("_other").alias("other"))
    last = _followed(edges.toArrow())
    found = spark.createDataFrame(last) if last.num_rows else spark.createDataFrame([], "label bigint, root bigint")
    for step in reversed(steps):  # label, root of the step; the root goes on
        above = found.select(F.col("label").alias("root"), F.col("root").alias("_above"))
        found = step.join(above, "root", "left").select("label", F.coalesce("_above", "root").alias("root"))
    return found
