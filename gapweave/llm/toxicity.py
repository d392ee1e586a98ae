"""Class-conditional Kneser-Ney models of byte n-grams, compared per byte."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.arrays import FOLD, NOT_ALNUM, column_bytes
from gapweave.llm.tables import appended, bounded_sample, store

#: Bytes of an n-gram, the discount, and the bytes of the window whose mean is compared.
ORDER = 5
DISCOUNT = 0.75
WINDOW = 16
#: At most so many labelled rows of each class are learned from.
CLASS_ROWS = 20_000
#: One labelled row in so many calibrates the score and is kept from the models.
CALIBRATE = 4
#: Ridge of the calibration.
RIDGE = 0.05

_BYTES = np.where(NOT_ALNUM[FOLD], 32, FOLD).astype(np.uint8)


def expressions(text: np.ndarray) -> np.ndarray:
    """The byte n-grams of a text as numbers: A-Z lower-cased, runs of other signs as one space, a space at both ends."""
    plain = _BYTES[text]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    plain = np.concatenate([[32], plain[keep], [32]]).astype(np.int64)
    count = len(plain) - ORDER + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    gram = np.zeros(count, np.int64)
    for k in range(ORDER):
        gram = gram << 8 | plain[k : k + count]
    return gram


def gram_counts(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """gram, ordinary, toxic, texts: how many texts of either class, and of all documents, hold the gram.

    learned: doc_id, toxic, of a bounded number of rows.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(learned.select(F.col("doc_id").alias("_id"), "toxic")), F.col("doc_id") == F.col("_id"), "left"
    )

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        counts = np.zeros((len(grams), 3), np.int64)
        at = 0
        for g, c in parts:
            np.add.at(counts, place[at : at + len(g)], c)
            at += len(g)
        return grams, counts

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            toxic = np.asarray(batch.column(1).fill_null(-1))
            for r in range(batch.num_rows):
                grams = np.unique(expressions(data[offsets[r] : offsets[r + 1]]))
                row = np.array([[toxic[r] == 0, toxic[r] == 1, True]], np.int64)
                parts.append((grams, np.broadcast_to(row, (len(grams), 3))))
                size += len(grams)
                if size > 1 << 21:
                    parts = [merged(parts)]
                    size = 0
        if parts:
            grams, counts = merged(parts)
            for at in range(0, len(grams), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[some]), *(pa.array(np.ascontiguousarray(counts[some, k])) for k in range(3))],
                    names=["gram", "ordinary", "toxic", "texts"],
                )

    found = marked.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        count, "gram long, ordinary long, toxic long, texts long"
    )
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "texts")])


def with_backoff(grams: DataFrame) -> DataFrame:
    """The grams of the labelled classes with shared, their backoff probability.

    shared is the interpolated Kneser-Ney probability of the gram's last byte after its inner
    bytes. On every level below the grams a suffix counts its distinct left contexts in the
    level above, discounted, with the rest given to the suffix one byte shorter; the counts
    start from the grams of all documents. Without the lower levels a suffix that occurs in
    one word only would have probability 1, and the word would tell nothing.
    """
    tail = lambda size: F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))
    levels, level = [], grams
    for size in range(ORDER - 1, 0, -1):
        level = store(level.groupBy(tail(size).alias("gram")).agg(F.count(F.lit(1)).alias("contexts")))
        levels.append((size, level))
    lower = None
    for size, level in reversed(levels):
        inner = F.shiftright("gram", 8).alias("inner")
        sums = level.groupBy(inner).agg(F.sum("contexts").alias("all_contexts"), F.count(F.lit(1)).alias("kinds"))
        found = level.select("gram", "contexts", inner).join(sums, "inner")
        share = F.col("contexts") / F.col("all_contexts")
        if lower is not None:
            found = found.withColumn("tail", tail(size - 1)).join(lower, "tail")
            share = (F.col("contexts") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("shared")) / F.col("all_contexts")
        lower = found.select(F.col("gram").alias("tail"), share.alias("shared"))
    labelled = grams.where(F.col("ordinary") + F.col("toxic") > 0)
    return labelled.withColumn("tail", tail(ORDER - 1)).join(lower, "tail").select("gram", "ordinary", "toxic", "shared")


@dataclass
class Model:
    """Log-likelihood ratio of every learned gram, and of an unseen byte after every learned context."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out = self.ratios[at].copy()
        miss = np.flatnonzero(self.grams[at] != grams)
        context = grams[miss] >> 8
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out[miss] = np.where(self.contexts[at] == context, self.unseen[at], 0.0)
        return out

    def features(self, text: np.ndarray) -> tuple[float, float]:
        """The mean ratio per byte of the text and of its most toxic window."""
        ratios = self.of(expressions(text))
        if not len(ratios):
            return 0.0, 0.0
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        width = min(WINDOW, len(ratios))
        return float(ratios.mean()), float((sums[width:] - sums[:-width]).max() / width)


def fit(grams: DataFrame) -> Model:
    """Both class models. The driver gets the grams of a bounded number of labelled texts."""
    table = with_backoff(grams).orderBy("gram").toArrow()
    gram, shared = table["gram"].to_numpy(), table["shared"].to_numpy()
    contexts, place = np.unique(gram >> 8, return_inverse=True)
    logs, unseen = [], []
    for name in ("ordinary", "toxic"):
        count = table[name].to_numpy().astype(float)
        total = np.bincount(place, weights=count, minlength=len(contexts)) + 1
        mass = np.bincount(place, weights=np.minimum(count, DISCOUNT), minlength=len(contexts)) + 1
        logs.append(np.log(np.maximum(count - DISCOUNT, 0) / total[place] + (mass / total)[place] * shared))
        unseen.append(np.log(mass / total))
    return Model(gram, logs[1] - logs[0], contexts, unseen[1] - unseen[0])


def _features(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(column: pa.Array) -> dict[str, pa.Array]:
        data, offsets = column_bytes(column)
        rows = [shared.value.features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        mean, top = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0))
        return {"mean_ratio": pa.array(mean), "top_ratio": pa.array(top), "log_size": pa.array(np.log1p(np.diff(offsets)))}

    return appended(docs, "text", measure, "mean_ratio double, top_ratio double, log_size double", carry)


def calibrate(rows: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights (constant, mean, top, log bytes) of a logistic curve; the last column of rows is the label."""
    x, y = rows[:, :-1], rows[:, -1]
    weights = np.zeros(x.shape[1] + 1)
    if not 0 < y.sum() < len(y):
        weights[0] = 20.0 if len(y) and y.all() else -20.0
        return weights
    # centred and in units of their spread, so that the ridge weighs all features alike
    middle, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    penalty = np.diag([0.0] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - penalty @ weights)
        weights += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))  # shortened as a whole, so its direction stays
        if np.abs(step).max() < 1e-8:
            break
    weights[1:] /= spread
    weights[0] -= middle @ weights[1:]
    return weights


def held_out() -> Column:
    """True for rows that no label may be learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in carry, doc_id among them; None: all) with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Texts are compared as byte n-grams of ORDER bytes. Each class has a Kneser-Ney model
    from at most class_rows labelled rows that are not held out (those with the smallest
    hash of doc_id); both back off to the same continuation counts, gathered from all
    documents, so that expressions rare in the labelled rows weigh the same in both.
    score is a logistic curve over the log-likelihood ratio per byte of the whole text and
    of its most toxic window of WINDOW bytes, and the logarithm of the length; the curve is
    fitted on one labelled row in CALIBRATE that the models do not learn from.

    Null and empty texts are scored as a text without n-grams. An id labelled twice counts
    as toxic if one label says so; null ids and null labels teach nothing. Without both
    classes among the labels every score is near 0 (near 1 if all are toxic).
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    spark = docs.sparkSession
    rows = []
    for value in (0, 1):
        rows += [(r.doc_id, value) for r in bounded_sample(usable.where(F.col("toxic") == value), "doc_id", class_rows).collect()]
    # every CALIBRATE-th row of each class, in the sample's own (hashed) order
    turn = {value: [r for r in rows if r[1] == value] for value in (0, 1)}
    frame = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    learned = frame([r for v in (0, 1) for k, r in enumerate(turn[v]) if k % CALIBRATE])
    checked = frame([r for v in (0, 1) for k, r in enumerate(turn[v]) if not k % CALIBRATE])
    model = fit(store(gram_counts(docs, learned)))

    wanted = docs.select("doc_id", "text").join(F.broadcast(checked), "doc_id")
    sample = _features(wanted, model, ["toxic"]).select("mean_ratio", "top_ratio", "log_size", F.col("toxic").cast("double")).toPandas()
    constant, mean, top, length = (float(w) for w in calibrate(sample.to_numpy()))
    level = F.lit(constant) + mean * F.col("mean_ratio") + top * F.col("top_ratio") + length * F.col("log_size")
    score = 1 / (1 + F.exp(-F.least(F.greatest(level, F.lit(-30.0)), F.lit(30.0))))
    return (
        _features(docs, model, carry)
        .withColumn("held_out", held_out())
        .withColumn("score", score)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
