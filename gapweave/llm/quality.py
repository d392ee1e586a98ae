"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.arrays import byte_grams, words
from gapweave.llm.tables import appended, bounded_sample, discard, store

GRAM = 4
BUCKETS = 1 << 18
#: At most so many target rows fit the target model, and as many more set the cut.
TARGET_ROWS = 20_000
#: A text's n-grams overlap and repeat: beyond so many, the sum of their log ratios is tempered to that of so many draws.
EVIDENCE = 200.0
#: Key ranges that one step of the search for the k-th largest key counts.
RANGES = 4096
#: The least positive number: ranges are at least so wide.
TINY = 5e-324
#: Share of other target rows above the cut; nearer to 1 the cut would hang on a few extreme rows.
KEEP = 0.99


def _buckets(column: pa.Array):
    """(first row, places of the rows, bucket of each gram) for parts of the column; no gram crosses a row's end."""
    for found in words(column):
        grams = byte_grams(found.data, GRAM, BUCKETS)
        # grams start at row offsets; the last GRAM - 1 places of a row have none
        stops = np.maximum(found.offsets[1:] - (GRAM - 1), found.offsets[:-1])
        yield found.low, found.offsets[:-1], stops, grams


def gram_counts(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts over all documents and over the target rows (doc_id)."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(targets.select(F.col("doc_id").alias("_id")).distinct().withColumn("_target", F.lit(True))),
        F.col("doc_id") == F.col("_id"),
        "left",
    )

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = np.asarray(batch.column(1).fill_null(False))
            for low, starts, stops, grams in _buckets(batch.column(0)):
                inside = np.zeros(len(grams) + 1, np.int64)
                wanted = np.zeros(len(grams) + 1, np.int64)
                some = stops > starts
                np.add.at(inside, starts[some], 1)
                np.add.at(inside, stops[some], -1)
                some &= chosen[low : low + len(starts)]
                np.add.at(wanted, starts[some], 1)
                np.add.at(wanted, stops[some], -1)
                raw += np.bincount(grams[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
                if some.any():
                    target += np.bincount(grams[np.cumsum(wanted)[:-1] > 0], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return (
        marked.select("text", "_target")
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), one added to every count. At most BUCKETS rows reach the driver."""
    table = counts.toArrow()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = table["bucket"].to_numpy()
    raw[at] += table["raw"].to_numpy()
    target[at] += table["target"].to_numpy()
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS, np.float32)  # no target text: nothing to tell apart
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def weighted(docs: DataFrame, ratios: np.ndarray, evidence: float = EVIDENCE) -> DataFrame:
    """docs with log_weight: the sum of the log ratios of a text's n n-grams over the temperature max(1, n / evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(column: pa.Array) -> dict[str, pa.Array]:
        out = np.zeros(len(column))
        for low, starts, stops, grams in _buckets(column):
            # each row's own sum: differences of running sums would depend on the rows before it
            values = np.append(shared.value[grams].astype(np.float64), 0.0)
            ends = np.minimum(np.stack([starts, stops], axis=1).ravel(), len(values) - 1)
            total = np.where(stops > starts, np.add.reduceat(values, ends)[::2], 0.0)
            out[low : low + len(starts)] = total / np.maximum((stops - starts) / evidence, 1.0)
        return {"log_weight": pa.array(out)}

    return appended(docs, "text", weigh, "log_weight double")


def _noise(seed: int):
    """Gumbel noise drawn from a hash of doc_id, text and seed."""
    uniform = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5
    return -F.log(-F.log(F.least(F.greatest(uniform, F.lit(1e-12)), F.lit(1 - 1e-12))))


def _halves() -> Column:
    """Numbers the parts that a range too wide for RANGES ranges of equal width is cut into: infinite ends, negative and other values."""
    key = F.col("key")
    return F.when(key == -np.inf, -1).when(key == np.inf, 2).when(key < 0, 0).otherwise(1)


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column key (exact), None where there are fewer than k; NaN is the largest value.

    keys is read a few times: store it first. Each step counts the values in RANGES ranges and goes on in the one
    that holds the k-th, so at most RANGES + 1 rows reach the driver and no values are sorted or gathered.
    """
    number = F.when(~F.isnan("key"), F.col("key"))
    bounds = keys.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("key").alias("n"), F.count_if(F.isnan("key")).alias("nan")).first()
    if k > bounds.n:
        return None
    if k <= bounds.nan:
        return float("nan")
    low, high, left = bounds.low, bounds.high, k - bounds.nan
    while low < high:
        width = max((high - low) / RANGES, TINY)
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(RANGES - 1)) if width < np.inf else _halves()
        inside = keys.where(F.col("key").between(low, high)).groupBy(at.alias("at"))
        counts = inside.agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for part in sorted(counts, key=lambda r: -r["at"]):
            if part.n >= left:
                break
            left -= part.n
        low, high = part.low, part.high
    return high


def resample(
    docs: DataFrame,
    targets: DataFrame,
    k: int | None = None,
    keep: float = KEEP,
    evidence: float = EVIDENCE,
    target_rows: int = TARGET_ROWS,
    seed: int = 1,
) -> DataFrame:
    """docs with log_weight, gumbel_key and selected: the Gumbel top-k sample of the importance weights.

    The raw model counts the n-grams of every document, the target model those of at
    most target_rows rows of targets (doc_id). log_weight is the sum of a text's log ratios, tempered
    (``weighted``): the smaller evidence is, the nearer the sample comes to a uniform one. gumbel_key is log_weight plus Gumbel
    noise drawn from a hash of doc_id, text and seed, so the k largest keys are a sample
    without replacement in proportion to the weights, and retries agree. Without a k it is the number
    of documents whose key reaches the (1 - keep) quantile of the keys of as many other
    target rows: a share keep of target-like text stays. Either way the k-th largest key is searched for among
    the stored keys of all documents (``kth_largest``).

    Null text counts as empty. A text of fewer than four bytes has weight 0. Equal rows
    have equal keys and share their fate, so ties with the k-th key all stay; a k of at least the number of
    documents selects all, 0 none. Without targets and k all documents are selected.
    Columns of docs named like the three new ones are replaced.
    """
    chosen = bounded_sample(targets.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", 2 * target_rows)
    ids = [r.doc_id for r in chosen.collect()]  # at most 2 * target_rows
    spark = docs.sparkSession
    frame = lambda x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    ratios = log_ratios(gram_counts(docs, frame(ids[::2])))
    keyed = weighted(docs, ratios, evidence).withColumn("gumbel_key", F.col("log_weight") + _noise(seed))
    reach = None
    if k is None:
        held = frame(ids[1::2] or ids)
        reach = (
            weighted(docs.select("doc_id", "text").join(F.broadcast(held), "doc_id"), ratios, evidence)
            .select((F.col("log_weight") + _noise(seed)).alias("key"))
            .agg(F.percentile("key", F.lit(1 - keep)))
            .first()[0]
        )
        if reach is None:
            return keyed.withColumn("selected", F.lit(True))
    elif k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    keys = store(keyed.select(F.col("gumbel_key").alias("key")))
    if k is None:
        k = keys.where(F.col("key") >= F.lit(reach)).count()
    cut = kth_largest(keys, k)
    discard(keys)
    return keyed.withColumn("selected", F.lit(True) if cut is None else F.col("gumbel_key") >= F.lit(cut))
