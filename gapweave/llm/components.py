"""Connected components of a graph held in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.tables import discard, spread_join, store, temporary

#: Edges that are left for one task at most; a larger graph is first contracted by rounds over all tasks.
REST_EDGES = 1 << 16


def _rest(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that can be reached, for a graph of at most REST_EDGES edges."""
    kind = edges.select("a").union(edges.select("b")).schema["a"].dataType.simpleString()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        ends = [np.concatenate([part.column(k).to_numpy(zero_copy_only=False) for part in parts]) for k in (0, 1)]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(place, 2)
        root = np.arange(len(nodes))
        while len(a):  # every root with an edge hooks to a smaller one, or is hooked to
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    typed = edges.select(F.col("a").cast(kind), F.col("b").cast(kind))
    return typed.coalesce(1).mapInArrow(follow, f"node {kind}, root {kind}")


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: follow every node's smallest neighbour until it is its own."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    step = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        # root is a node as well, and one node may be the root of very many
        above = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = store(spread_join(step, above, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        discard(step)
        moved = jumped.where("moved").limit(1).count()
        step = jumped.drop("moved")
        if not moved:
            return step


@temporary
def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of edges (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots
    by pointer jumping, and goes on with the edges between roots. A node that is not a
    root leaves the graph, so each round at least halves the nodes that still have an edge.
    What is left is followed in one task once it has at most REST_EDGES edges.
    Null ends, loops and repeated edges are ignored.
    """
    edges, labels = edges.select("a", "b").where("a != b"), None
    if (left := edges.count()) > REST_EDGES:
        edges = store(edges.distinct())
        left = edges.count()
    while left:
        last = left <= REST_EDGES
        roots = store(_rest(edges)) if last else _roots(edges)
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            further = roots.select(F.col("node").alias("component"), F.col("root").alias("_root"))
            joined = spread_join(labels, further, "component", "left")
            renamed = store(joined.select("node", F.coalesce("_root", "component").alias("component")))
            discard(labels)
            labels = renamed
        if last:
            break
        ends = spread_join(edges, roots.select(F.col("node").alias("a"), F.col("root").alias("p")), "a").select("b", "p")
        ends = store(ends)
        shorter = spread_join(ends, roots.select(F.col("node").alias("b"), F.col("root").alias("q")), "b")
        rest = store(shorter.where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        discard(edges, ends)
        edges = rest
        left = edges.count()
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
