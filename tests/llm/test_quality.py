"""Importance resampling against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import quality
from gapweave.llm.arrays import byte_grams

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    random = np.random.default_rng(11)
    draw = lambda kind, n: " ".join(f"{kind}{random.integers(60)}" for _ in range(n))
    rows = [(i, draw("good" if i < 300 else "zzq", int(random.integers(1, 60)))) for i in range(900)]
    rows += [(900, None), (901, ""), (902, "abc"), (903, rows[0][1]), (0, rows[0][1]), (904, "der été 你好 " * 40)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def grams(text):
    return byte_grams(np.frombuffer((text or "").encode(), np.uint8), quality.GRAM, quality.BUCKETS)


def log_weights(rows, targets, evidence):
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, text in rows:
        np.add.at(raw, grams(text), 1)
        if i in targets:
            np.add.at(target, grams(text), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return [ratio[grams(t)].sum() / max(1.0, len(grams(t)) / evidence) for _, t in rows]


@pytest.mark.parametrize("evidence", [200.0, 20.0])
def test_weights_keys_and_a_requested_k_equal_plain_numpy(spark, corpus, evidence):
    rows, docs = corpus
    good = spark.range(200).withColumnRenamed("id", "doc_id")
    chosen = [r.doc_id for r in quality.bounded_sample(good, "doc_id", 2 * quality.TARGET_ROWS).collect()][::2]
    want = {(i, t): w for (i, t), w in zip(rows, log_weights(rows, set(chosen), evidence))}
    for k in (1, 250, len(rows)):
        found = quality.resample(docs, good, k=k, evidence=evidence).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.log_weight == pytest.approx(want[r.doc_id, r.text], abs=1e-3)
        cut = sorted((r.gumbel_key for r in found), reverse=True)[k - 1]
        assert all(r.selected == (r.gumbel_key >= cut) for r in found)
        assert k <= sum(r.selected for r in found) <= k + 1  # one row is there twice
    assert not any(r.selected for r in quality.resample(docs, good, k=0).collect())
    assert all(r.selected for r in quality.resample(docs, good, k=10**6).collect())


def test_the_noise_is_gumbel(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    noise = np.array([r[0] for r in rows.select(quality._noise(1)).collect()])
    assert noise.mean() == pytest.approx(0.5772, abs=0.03) and noise.var() == pytest.approx(np.pi**2 / 6, abs=0.06)


def test_the_sample_moves_towards_the_target_and_seeds_differ(spark, corpus):
    rows, docs = corpus
    good = spark.range(200).withColumnRenamed("id", "doc_id")

    def model(texts):
        counts = np.zeros(quality.BUCKETS)
        for t in texts:
            np.add.at(counts, grams(t), 1)
        return counts / counts.sum()

    target = model(t for i, t in rows if i < 300)
    away = lambda texts: np.abs(target - model(texts)).sum() / 2
    samples = {}
    for evidence, seed in [(200.0, 1), (2.0, 1), (2.0, 2)]:
        found = quality.resample(docs, good, k=200, evidence=evidence, seed=seed).where("selected").collect()
        samples[evidence, seed] = {(r.doc_id, r.text) for r in found}
    raw = away([t for _, t in rows])
    assert all(away([t for _, t in kept]) < raw / 2 for kept in samples.values())
    assert samples[2.0, 1] != samples[2.0, 2]


@pytest.mark.parametrize("values", [[1.0], [2.0] * 9, [1.0, np.nextafter(1.0, 2)] * 4, list(np.random.default_rng(3).normal(size=500)) + [1e9, -1e9]])
def test_kth_largest(spark, values):
    keys = spark.createDataFrame([(float(v),) for v in values], "key double").repartition(3)
    for k in {1, len(values) // 2 or 1, len(values)}:
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(keys, len(values) + 1) is None
