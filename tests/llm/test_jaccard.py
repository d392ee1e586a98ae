"""The similarity join on long texts, popular lines and repeated ids, against all pairs."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest

from gapweave.llm import components, jaccard_join, tables
from gapweave.llm.arrays import U64
from tests.llm.test_operators import SCHEMA, classes


def long_rows():
    """Texts of 2,000 words that share half of them, drifting copies of some, and one line common to all."""
    random = np.random.default_rng(5)
    half = [f"h{k}" for k in range(1_000)]
    line = "one line that stands in every text of this table and in no other"
    rows = []
    for k in range(14):
        own = [f"o{k}x{j}" for j in range(1_000)]
        rows.append((10 * k + 1, " ".join([line, *half, *own])))
        if k % 3 == 0:  # near copies: in reach, just out of reach, and a chain
            for step, changes in enumerate((8, 30, 60, 90)):
                text = list(half + own)
                for place in random.integers(0, len(text), changes):
                    text[place] = f"n{random.integers(10**6)}"
                rows.append((10 * k + 2 + step, " ".join([line, *text])))
    rows += [(1_000 + k, f"{line} " + " ".join(f"s{k}y{j}" for j in range(4 + k % 9))) for k in range(40)]
    return rows


@pytest.mark.parametrize("tile", [4, 1_024])
def test_long_texts_and_a_common_line(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)  # 4: other centers are tried first, and tiles are compared
    rows = long_rows()
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows)


def test_long_sketches_bound_the_differences_and_tell_unrelated_sets_apart():
    random = np.random.default_rng(6)
    for size in (600, 1_030, 3_000, 20_000):
        p, q, base = (np.unique(random.integers(0, 2**63, size, np.int64).view(U64)) for _ in range(3))
        near = np.unique(np.concatenate([base[size // 20 :], p[: size // 10]]))  # a power of two may lie between the sizes
        far = jaccard_join._LongSketches(pa.chunked_array([[jaccard_join.long_sketch(s) for s in (base, near, p, q)] + [None]]))
        found = far.distances(np.array([0, 2, 0]), np.array([1, 3, 4]))
        assert 0 < found[0] <= len(np.setxor1d(base, near)) and found[2] == 0
        assert found[1] * 180 > (len(p) + len(q)) * 20


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (None, a), (4, ""), (4, ""), (5, d), (5, d)]
    start = time.time()
    kept = jaccard_join.first_of_class(spark.createDataFrame(rows, SCHEMA)).collect()
    took = time.time() - start
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (None, a), (4, ""), (4, "")], key=repr)
    assert took < 60


def test_one_answer_for_rows_with_and_without_repeated_ids(spark):
    rows = [(i, t) for i, t in long_rows() if i < 1_000]
    alone = {r.doc_id for r in jaccard_join.first_of_class(spark.createDataFrame(rows, SCHEMA)).collect()}
    more = rows + [(5_000, "some other text of a few words"), (5_000, "yet another text of a few words")]
    mixed = {r.doc_id for r in jaccard_join.first_of_class(spark.createDataFrame(more, SCHEMA)).collect()}
    want = classes(rows)
    assert alone == {i for i in want if want[i] == i} and mixed == alone | {5_000}


def test_long_sketches_fold_to_the_short_ones():
    random = np.random.default_rng(8)
    sets = [np.unique(random.integers(0, 2**63, size, np.int64).view(U64)) for size in (129, 300, 1_025, 40_000)]
    far = jaccard_join._LongSketches(pa.chunked_array([[jaccard_join.long_sketch(s) for s in sets] + [None]]))
    own = np.arange(5 * len(jaccard_join.SKETCH), dtype=U64).reshape(5, -1)
    folded = far.short(own)
    for k, s in enumerate(sets):
        bits = np.bincount((s & U64(511)).astype(np.int64), minlength=512) & 1
        assert (folded[k] == np.packbits(bits.astype(np.uint8)).view(U64)).all()
    assert (folded[4] == own[4]).all()


def test_only_the_result_stays_on_disk(spark):
    random = np.random.default_rng(21)
    base = [f"w{random.integers(10**6)}" for _ in range(80)]
    rows = []
    for i in range(300):  # one group of near copies, copies of some, and texts of their own
        words = list(base) if i % 3 else [f"o{random.integers(10**6)}" for _ in range(30)]
        for place in random.integers(0, len(words), i % 4):
            words[place] = f"n{random.integers(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, t) for i, t in rows[:40]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"{tables.shared_folder(spark)}/tables".removeprefix("file:")
    held = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before, setting = held(), spark.conf.get(tables.FREE_SHUFFLES, None)
    found = jaccard_join.jaccard_classes(frame)
    assert len(held() - before) == 1 and spark.conf.get(tables.FREE_SHUFFLES, None) == setting
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert {r.doc_id: r.component_id for r in found.collect()} == label


def test_linked_sets_share_more_keys_than_each_may_do_without():
    random = np.random.default_rng(31)
    draw = lambda n: np.unique(random.integers(0, 2**63, n, np.int64).view(U64))
    bands, spared = jaccard_join.Bands(80, 4_000), 0
    for size in (3, 12, 40, 90, 300, 1_200):
        for _ in range(30):
            base, changes = draw(size), int(random.integers(0, size // 10 + 1))
            other = np.unique(np.concatenate([base[changes:], draw(changes)])) if changes else base
            if 100 * len(np.intersect1d(base, other)) < 80 * len(np.union1d(base, other)):
                continue
            pair = [(s, bands.of(len(s))) for s in (base, other)]
            for band in {b + k for _, b in pair for k in (0, 1)}:
                if all(band - b in (0, 1) for _, b in pair):
                    keys = [jaccard_join.block_keys(s, band, bands) for s, _ in pair]
                    assert all((k >> U64(32) & U64(1) == U64(band & 1)).all() for k in keys)
                    more = max(jaccard_join.shared_more(jaccard_join.block_bytes(s, band, bands), band, bands) for s, _ in pair)
                    assert len(np.intersect1d(*keys)) >= (more + 2 if more else 1)
                    spared += more
    assert spared > 0


def test_popular_keys_are_left_out_as_far_as_allowed(spark):
    # keys 2, 4, 6 are of even bands, 7 of an odd one; document 1 may do without two even ones, 2 without none
    classed = spark.createDataFrame([(k, r, r) for k, r in [(2, 1), (2, 2), (2, 3), (4, 1), (4, 2), (6, 1), (7, 1), (7, 3)]], "key long, rep long, class long")
    known = spark.createDataFrame([(1, 2, 0), (2, 0, 0), (3, 5, 0)], "rep long, even_more int, odd_more int")
    left = jaccard_join._needed(classed, known).collect()
    assert sorted((r.key, r.rep) for r in left) == [(2, 2), (4, 2), (6, 1), (7, 1), (7, 3)]


def test_equal_sets_of_repeated_and_single_ids_both_meet_others(spark):
    text = [f"a{k}" for k in range(60)]
    near = " ".join([*text[:-2], "x", "y"])
    rows = [(5, " ".join(text)), (5, " ".join(f"b{k}" for k in range(60))), (3, " ".join(text)), (9, near)]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in found} == {5: 3, 3: 3, 9: 3}


def test_counts_inside_a_step_drop_their_shuffle_files(spark):
    held = []

    @tables.temporary
    def step(df):
        held.append(spark.conf.get(tables.FREE_SHUFFLES))
        return df.limit(df.count())

    assert step(spark.range(3)).count() == 3 and held == ["true"]


def jobs_of(spark, name, fn):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return fn(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_small_graph_takes_few_jobs(spark):
    rows = [(k, k + 1) for k in range(100, 400)] + [(3, 2), (2, 9), (9, 3), (9, 3), (5, 5), (None, 2), (7, None)]
    edges = spark.createDataFrame(rows, "a long, b long")
    found, jobs = jobs_of(spark, "small graph", lambda: components.components(edges))
    assert {r.node: r.component for r in found.collect()} == {k: 100 for k in range(100, 401)} | {2: 2, 3: 2, 9: 2}
    assert jobs <= 6


@pytest.mark.parametrize("most", [0, 20, 1_000])
def test_the_rest_of_a_graph_meets_the_rounds_before(spark, monkeypatch, most):
    monkeypatch.setattr(components, "REST_EDGES", most)
    random = np.random.default_rng(3)
    rows = [tuple(map(int, pair)) for pair in random.integers(0, 150, (110, 2))]
    found = components.components(spark.createDataFrame(rows, "a long, b long")).collect()
    want = {x: x for a, b in rows if a != b for x in (a, b)}
    for a, b in rows:
        if a != b:
            low, high = sorted((want[a], want[b]))
            want = {x: low if label == high else label for x, label in want.items()}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def test_few_rows_join_without_a_shuffle(spark, monkeypatch):
    left = tables.store(spark.range(5_000).selectExpr("id % 7 AS k", "id"))
    right = tables.store(spark.createDataFrame([(k, 10 * k, bytes(k), [k] * k) for k in range(5)], "k long, v long, b binary, l array<long>"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        few = tables.spread_join(left, right, "k", "left")
        assert "BroadcastHashJoin" in plan(few) and "hashpartitioning" not in plan(few)
        rows = sorted(map(tuple, few.drop("b", "l").collect()))
        monkeypatch.setattr(tables, "FEW_BYTES", 0)
        many = tables.spread_join(left, right, "k", "left")
        assert "hashpartitioning" in plan(many) and sorted(map(tuple, many.drop("b", "l").collect())) == rows and len(rows) == 5_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_empty_row_of_a_long_document_takes_no_part(spark):
    text = [f"a{k}" for k in range(400)]
    rows = [(1, " ".join(text)), (1, ""), (2, " ".join([*text[:-3], "x", "y", "z"])), (3, "b " * 9), (3, None)]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]


def test_no_table_counts_as_few(spark, monkeypatch):
    monkeypatch.setattr(tables, "FEW_BYTES", -1)
    monkeypatch.setattr(tables, "FEW_ROWS", -1)
    monkeypatch.setattr(components, "REST_EDGES", 0)
    text = [f"a{k}" for k in range(300)]
    rows = [(k, " ".join([f"n{k}" if 10 * j <= 2 * k and j < 5 else w for j, w in enumerate(text)])) for k in range(1, 12)]
    rows += [(20 + k, f"one line that stands in every text of some {k} " + " ".join(f"s{k}y{j}" for j in range(9))) for k in range(10)]
    rows += [(40, " ".join(text)), (40, rows[-1][1]), (41, ""), (42, "one")]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows)
