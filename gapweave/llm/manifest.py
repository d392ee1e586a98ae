"""Merkle manifest of a dataset: a tree of leaves per source, a tree over the sources, and a proof for every row.

The leaves of a tree are cut into superblocks of ARITY ** levels. On the way up a task
reduces one superblock to one node; the nodes left are cut again, until one is left. On
the way down each superblock meets the proof of its own node (cogrouped), reduces its leaves once
more, and joins and folds the proofs. No tree is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gapweave.llm.tables import store

ARITY = 3
#: Levels of a tree that one task reduces: a superblock has ARITY ** LEVELS nodes.
LEVELS = 7


def leaf_digest(*columns: str | Column) -> Column:
    """Lower-case hex SHA-256 of the columns one after another: `-` for null, else UTF-8 byte count, `:`, value."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(digests: list[str], whole: int, levels: int) -> list[list[str]]:
    """The levels of one superblock, from its nodes up. whole: the nodes of its tree at this height.

    A superblock that is not the only one goes up all levels even where one node is left.
    """
    out = [digests]
    while len(out) <= levels if whole > ARITY**levels else len(out[-1]) > 1:
        low = out[-1]
        out.append([_hash("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return out


def steps(levels: list[list[str]]) -> Callable[[int], list[tuple[str, str]]]:
    """node -> (digests before it, digests after it) in its run, level by level."""

    def of(node: int) -> list[tuple[str, str]]:
        out = []
        for level in levels[:-1]:
            low = node - node % ARITY
            out.append(("".join(level[low:node]), "".join(level[node + 1 : low + ARITY])))
            node //= ARITY
        return out

    return of


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and its siblings lead to."""
    for before, after in path:
        digest = _hash(before + digest + after)
    return digest


def packed(path: list[tuple[str, str]]) -> tuple[str, str]:
    """A proof as two strings: the siblings, and for each level how many stand before and after (two digits)."""
    return "".join(a + b for a, b in path), "".join(f"{len(a) // 64}{len(b) // 64}" for a, b in path)


def unpacked(proof: str, places: str) -> list[tuple[str, str]]:
    """packed() undone."""
    path, at = [], 0
    for k in range(0, len(places), 2):
        middle = at + 64 * int(places[k])
        end = middle + 64 * int(places[k + 1])
        path.append((proof[at:middle], proof[middle:end]))
        at = end
    return path


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df (stored) with n, the rows of the group, and idx, the row's place in it from 0.

    The rows are range-sorted into slices, so a group may be of any size: a row's place is that in
    its slice plus its group's rows in the slices before.
    """
    rows = store(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id()))
    slices = rows.groupBy(group, F.shiftright("_id", 33).alias("_slice")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)  # one row per slice
    slices = slices.select(
        F.col(group).alias("_group"),
        "_slice",
        (F.sum("_rows").over(whole.orderBy("_slice")) - F.col("_rows") - F.col("_first")).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_id", 33) == F.col("_slice"))
    return rows.join(slices, same).withColumn("idx", F.col("_id") + F.col("_offset")).drop("_group", "_slice", "_offset", "_id")


def _block(levels: int) -> Column:
    return F.expr(f"idx div {ARITY**levels}").alias("block")


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(the tiers of all trees from the leaves up, tree and digest of each root). nodes: tree, idx, n, digest."""
    block = ARITY**levels

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        whole = int(pdf["n"].iloc[0])
        top = reduced(pdf["digest"].tolist(), whole, levels)[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "idx": [int(pdf["idx"].iloc[0]) // block], "n": [-(-whole // block)], "digest": [top]})

    tiers, roots = [nodes], None
    while True:
        blocks = tiers[-1].select("tree", "idx", "n", "digest", _block(levels)).groupBy("tree", "block")
        above = store(blocks.applyInPandas(up, "tree long, idx long, n long, digest string"))
        done = above.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        rest = above.where("n > 1")
        if not rest.limit(1).count():
            return tiers, roots
        tiers.append(rest)


def _joined(keep: list[str], levels: int, finish: Callable[[pd.DataFrame, list, pd.Series], dict]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A cogrouped function: the nodes of a superblock, reduced again, and the proof of the superblock's own node.

    finish gets the nodes, their whole paths and the row from above.
    """

    def join(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        digests, outer = nodes["digest"].tolist(), above.iloc[0]
        local = steps(reduced(digests, int(nodes["n"].iloc[0]), levels))
        rest = unpacked(outer["proof"], outer["places"])
        paths = [local(k) + rest for k in range(len(digests))]
        return pd.DataFrame({c: nodes[c].tolist() for c in keep} | finish(nodes, paths, outer))

    return join


def _inner(nodes: pd.DataFrame, paths: list, outer: pd.Series) -> dict:
    proofs = [packed(p) for p in paths]
    return {"subroot": [outer["subroot"]] * len(paths), "proof": [p for p, _ in proofs], "places": [p for _, p in proofs]}


def _leaf(nodes: pd.DataFrame, paths: list, outer: pd.Series) -> dict:
    told = [d if p is None else p for d, p in zip(nodes["digest"].tolist(), nodes["presented"].tolist(), strict=True)]
    return _inner(nodes, paths, outer) | {"folded_root": [fold(d, p) for d, p in zip(told, paths, strict=True)]}


def descend(tiers: list[DataFrame], given: DataFrame, levels: int, finish: Callable, keep: dict[str, str], more: str) -> DataFrame:
    """The proofs of all nodes of the lowest tier. given: tree, leaves, subroot, proof, places of each tree's root.

    keep: columns of the lowest tier with their types; finish makes the others (more).
    """
    own, proofs = {"tree": "long", "idx": "long"}, "subroot string, proof string, places string"
    outer = None
    for height in range(len(tiers) - 1, -1, -1):
        # trees whose nodes of this tier are one superblock hang from their root, others from the tier above
        left = F.ceil(F.col("leaves") / float(ARITY ** (levels * height)))
        fits = (left <= ARITY**levels) & ((F.lit(height) == 0) | (left > 1))
        roots = given.where(fits).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "proof", "places")
        above = roots if outer is None else roots.union(outer)
        kept, last = (keep, finish) if height == 0 else (own, _inner)
        schema = ", ".join([f"{c} {t}" for c, t in kept.items()] + [more if height == 0 else proofs])
        nodes = tiers[height].select("*", _block(levels)).groupBy("tree", "block")
        found = nodes.cogroup(above.groupBy("tree", "block")).applyInPandas(_joined(list(kept), levels, last), schema)
        if height:
            outer = store(found).select("tree", F.col("idx").alias("block"), "subroot", "proof", "places")
    return found


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, places, folded_root, verified for every row.

    rows: doc_id, source, leaf (hex digest) and presented (the digest that is to be proved; null: leaf).
    The leaves of a source ascend by doc_id (null first; equal ones by leaf). While several nodes
    remain, every ARITY consecutive ones become the hash of their digests; what remains is the
    source's subroot. The subroots by source (null first, bytewise) likewise give the root. proof holds
    the siblings up to the root, level by level and left to right, places how many of them
    stand before and after. folded_root is the root recomputed from presented and the siblings,
    verified whether it equals the root.

    One task reduces ARITY ** levels nodes. Repeated rows are leaves of their own. An empty table gives no rows. doc_id may be of any type that
    can be ordered and cast to a string and back.
    """
    spark: SparkSession = rows.sparkSession
    kind = rows.schema["doc_id"].dataType
    told = rows.select("doc_id", "source", "leaf", "presented").withColumn("row", F.monotonically_increasing_id())
    # equal rows are told apart by their number, so the sort can cut between them
    ordered = store(numbered(store(told), "source", ["doc_id", "leaf", "row"]))
    sources = ordered.where("idx = 0").select("source", F.col("n").alias("leaves"), F.lit(0).cast("long").alias("tree"))
    trees = store(numbered(store(sources), "tree", ["source"]).select(F.col("source").alias("_source"), "leaves", F.col("idx").alias("tree"), F.col("n").alias("trees")))
    nodes = ordered.join(trees, F.col("source").eqNullSafe(F.col("_source")))
    nodes = store(nodes.select("tree", "idx", "n", F.col("leaf").alias("digest"), "presented", F.col("doc_id").cast("string").alias("key")))

    tiers, subroots = climb(nodes, levels)
    top = trees.join(subroots, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest", "leaves")
    top = store(top)
    top_tiers, roots = climb(top, levels)
    found = roots.collect()  # one digest, none for an empty table
    root = found[0].digest if found else ""
    start = spark.createDataFrame([(0, top.count(), root, "", "")] if found else [], "tree long, leaves long, subroot string, proof string, places string")
    keep = {"idx": "long", "digest": "string", "leaves": "long"}
    given = descend(top_tiers, start, levels, _inner, keep, "subroot string, proof string, places string")
    given = store(given.select(F.col("idx").alias("tree"), "leaves", F.col("digest").alias("subroot"), "proof", "places"))
    found = descend(
        tiers, given, levels, _leaf, {"key": "string", "digest": "string"}, "subroot string, proof string, places string, folded_root string"
    )
    return found.select(
        F.col("key").cast(kind).alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        "proof",
        "places",
        "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
