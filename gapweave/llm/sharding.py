"""Sharding by vector bin packing: bytes, tokens and rows balanced together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gapweave.llm.packing import token_numbers
from gapweave.llm.tables import appended, store, text_or_empty

#: A group with more than 1 / HEAVY of a shard in any dimension is placed by the driver, before all others.
HEAVY = 256
#: A group stays whole where a shard has room for it but for this share of a shard; smaller groups always do.
SLACK = 1 / 16
#: Rows that one task places at a time.
PART_ROWS = 8_192
SIZES = ("size", "tokens", "members")
#: Weights of the dimensions in the dot product: bytes first, as the law promises their balance.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def place(units: np.ndarray, total: np.ndarray, capacity: np.ndarray, slack: float | None = None) -> np.ndarray:
    """The shard of each unit (rows of bytes, tokens, rows); capacity: per shard, what it should still get of each.

    Units go in falling order of their largest share of total. Each goes to the shard with
    the highest dot product (by WEIGHTS) of the unit and the shard's residual capacity, both
    as shares of total; residual capacity may become negative. The lowest shard wins ties.
    With slack (a share of total) a unit of several rows and more than slack goes only where
    it exceeds the residual capacity by at most slack in each dimension, to none (-1) otherwise.
    """
    whole = np.maximum(total, 1.0)
    shares, residual = units / whole, capacity / whole
    out = np.zeros(len(units), np.int32)
    for k in np.argsort(-shares.max(axis=1, initial=0.0), kind="stable"):
        gain = residual @ (WEIGHTS * shares[k])
        if slack is not None and units[k, 2] > 1 and shares[k].max() > slack:
            room = (shares[k] <= residual + slack).all(axis=1)
            if not room.any():
                out[k] = -1
                continue
            gain = np.where(room, gain, -np.inf)
        shard = int(np.argmax(gain))
        residual[shard] -= shares[k]
        out[k] = shard
    return out


def measured(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and the text's 128-bit hash (group_a, group_b) of every document."""
    text = text_or_empty()
    kept = [
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group_a"),
        F.xxhash64(F.lit(1), text).alias("group_b"),
    ]
    if tokenizer is None:
        return docs.select(*kept, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    # the texts themselves do not travel back from the workers
    narrow = docs.select("text", *kept)
    carry = [c for c in narrow.columns if c != "text"]
    return appended(narrow, "text", lambda c: {"tokens": pa.array(token_numbers(c, tokenizer))}, "tokens long", carry=carry)


def shards(docs: DataFrame, count: int = 24, tokenizer: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law bytes.

    size is the text's UTF-8 bytes plus 8 (null text: empty); tokens are those of the tokenizer file,
    without one the words between white space. Equal texts form a group, and a group lies in one shard. Only a group
    that no shard has room for is cut: one above a shard in bytes, tokens or rows, or above
    SLACK of a shard where larger groups have left less than that.

    Groups above 1 / HEAVY of a shard are fewer than 3 * HEAVY * count: the driver places
    them first, then the pieces, of about 1 / HEAVY of a shard, of those that are cut. The
    rest is dealt by hash to parts of about PART_ROWS rows, each with an equal part of every
    shard's residual capacity, and one task places the groups of a part one by one. slot
    counts the rows of a shard by part, from 0.

    grown_shard is null under this law. A null doc_id is a row like any other; repeated rows
    are members of their text's group. An empty table gives an empty result.
    """
    # row: fixed from here on, as the table is written
    rows = store(measured(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = np.array([x or 0 for x in total], float)
    limit = np.maximum(total / (count * HEAVY), 1.0)
    groups = rows.groupBy("group_a", "group_b").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("members"))
    largest = F.greatest(*[F.col(c) / float(x) for c, x in zip(SIZES, limit, strict=True)])
    # of every dimension fewer than HEAVY * count groups can pass the limit
    heavy = groups.where(largest > 1).withColumn("pieces", F.least(F.ceil(largest), F.col("members"))).orderBy("group_a", "group_b").toPandas()
    capacity = np.tile(total / count, (count, 1))
    units = heavy[list(SIZES)].to_numpy(float)
    heavy["heavy_shard"] = place(units, total, capacity, SLACK / count)
    whole = heavy[heavy["heavy_shard"] >= 0]
    heavy.loc[whole.index, "pieces"] = 1
    residual = capacity
    np.subtract.at(residual, whole["heavy_shard"].to_numpy(), units[whole.index])
    spark = docs.sparkSession
    named = spark.createDataFrame(heavy[["group_a", "group_b", "pieces"]].values.tolist(), "heavy_a long, heavy_b long, pieces long")
    marked = rows.join(F.broadcast(named), (F.col("group_a") == F.col("heavy_a")) & (F.col("group_b") == F.col("heavy_b")), "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("row"), "pieces")).cast("long")
    )
    marked = store(marked.select(*rows.columns, "piece", (F.col("pieces") > 1).alias("cut")))
    fixed = whole.assign(piece=0)[["group_a", "group_b", "piece", "heavy_shard"]].values.tolist()
    if len(whole) < len(heavy):
        placed = (
            marked.where("cut")
            .groupBy("group_a", "group_b", "piece")
            .agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("members"))
            .orderBy("group_a", "group_b", "piece")
            .toPandas()
        )
        units = placed[list(SIZES)].to_numpy(float)
        placed["heavy_shard"] = place(units, total, residual)
        np.subtract.at(residual, placed["heavy_shard"].to_numpy(), units)
        fixed += placed[["group_a", "group_b", "piece", "heavy_shard"]].values.tolist()
    fixed = spark.createDataFrame(fixed, "group_a long, group_b long, piece long, heavy_shard int")
    parts = int(total[2] // PART_ROWS) + 1
    dealt = marked.join(F.broadcast(fixed), ["group_a", "group_b", "piece"], "left").withColumn(
        "part",
        F.when(F.col("piece") < 0, F.pmod(F.xxhash64("group_a", "group_b"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("row"), F.lit(parts))),
    )
    # light groups lie whole in one part; the rows of heavy pieces are placed already and only numbered there
    share = residual / parts

    def fill(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values("row", ignore_index=True)
        shard = frame["heavy_shard"].to_numpy(float)
        light = np.flatnonzero(np.isnan(shard))
        if len(light):
            sub = frame.loc[light]
            number = sub.groupby(["group_a", "group_b"], sort=True).ngroup().to_numpy()
            units = np.zeros((number.max() + 1, 3))
            np.add.at(units, number, np.column_stack([sub["size"], sub["tokens"], np.ones(len(sub))]))
            shard[light] = place(units, units.sum(0), share + (units.sum(0) - share.sum(0)) / len(share))[number]
        frame["shard"] = shard.astype(np.int32)
        frame["local"] = frame.groupby("shard").cumcount()
        columns = ["doc_id", "size", "text_crc32", "part", "shard", "local"]
        out = {c: pa.array(frame[c]) for c in columns if c != "doc_id"}
        order = pc.sort_indices(table["row"])
        out["doc_id"] = table["doc_id"].take(order).combine_chunks() if table.num_rows else table["doc_id"].combine_chunks()
        return pa.table({c: out[c] for c in columns})

    assigned = store(
        dealt.select("doc_id", "size", "tokens", "text_crc32", "group_a", "group_b", "row", "heavy_shard", "part")
        .groupBy("part")
        .applyInArrow(fill, "doc_id long, size long, text_crc32 long, part long, shard int, local long")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part and shard
    offsets = (
        assigned.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return assigned.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("local")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
