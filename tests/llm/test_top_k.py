"""op1 selects the k largest keys, found by the exact search."""

import numpy as np
import pyarrow as pa
import pytest

from gapweave.llm import quality, queries

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    "values",
    [[1.0, 2.0, 3.0, INF], [-INF, -3.0, 0.0, 2.0, 2.0, INF], [0.0, 5e-324, 1e-323], [-1.7e308, 0.0, 1.0, 1.7e308], [NAN, 1.0, 2.0]],
)
def test_kth_largest_of_values_that_ranges_of_equal_width_do_not_divide(spark, values):
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    want = sorted(values, key=lambda v: (v != v, v), reverse=True)
    assert str([quality.kth_largest(keys, k) for k in range(1, len(values) + 1)]) == str(want)
    assert quality.kth_largest(keys, len(values) + 1) is None


def test_op1_takes_the_k_largest_keys(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(5)
    draw = lambda kind, n: " ".join(f"{kind}{random.integers(60)}" for _ in range(n))
    rows = [(i, draw("good" if i < 300 or i % 5 == 0 else "zzq", int(random.integers(1, 60)))) for i in range(900)]
    rows += [rows[7], rows[7], (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(200)] + [(i, 0) for i in range(300, 400)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    searched = []
    search = quality.kth_largest
    monkeypatch.setattr(quality, "kth_largest", lambda keys, k: searched.append((keys.count(), k, search(keys, k))) or searched[-1][2])
    found = queries.op1_quality(spark, str(tmp_path)).collect()

    good = [r.doc_id for r in quality.bounded_sample(spark.createDataFrame([(i,) for i in range(200)], "doc_id long"), "doc_id", 2 * quality.TARGET_ROWS).collect()]
    keys = {r.doc_id: r.gumbel_key for r in found}
    reach = np.quantile([k for i in good[1::2] for k in [keys[i]] * (3 if i == 7 else 1)], 1 - quality.KEEP)
    k = sum(r.gumbel_key >= reach for r in found)
    (counted, asked, cut), = searched
    assert (counted, asked) == (len(rows), k) and 250 < k < len(rows)
    assert cut == sorted((r.gumbel_key for r in found), reverse=True)[k - 1]
    best = sorted(range(len(found)), key=lambda n: -found[n].gumbel_key)[:k]
    assert {n for n, r in enumerate(found) if r.selected} == set(best)


def test_the_weight_of_a_text_does_not_hang_on_the_rows_before_it(spark):
    random = np.random.default_rng(10)
    ratios = (random.normal(size=quality.BUCKETS) * 10.0 ** random.uniform(-7, 0, quality.BUCKETS)).astype(np.float32)
    texts = ["".join(map(chr, random.integers(97, 123, random.integers(3, 4_000)))) for _ in range(200)]
    docs = spark.createDataFrame(pa.table({"n": list(range(400)), "text": texts + texts[::-1]})).coalesce(1)
    weight = {r.n: r.log_weight for r in quality.weighted(docs, ratios).collect()}
    assert all(weight[n] == weight[399 - n] for n in range(200))
