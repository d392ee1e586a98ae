"""Records cut at any split of a file, against Spark's multi-line reader."""

import random

import pytest

from gapweave.sources import csv_chunks

CELLS = [
    "plain", "", '"quoted"', '"a, b"', '"two\nlines"', '"a ""word"" in quotes"', '5" disk', 'it "says" so', '"broken"tail',
    '" spaced "', ' "late', '"x\n\n,""\n"', '""', '"\n"', "ünï", '"win\r\ndows"', '"tab\there; semicolon"', "a'b\\",
]


def written(folder, count, seed, sep=",", end="\n"):
    draw = random.Random(seed)
    rows = [sep.join(["id", "x", "y", "z"])]
    for k in range(count):
        cells = [draw.choice(CELLS).replace(",", sep) for _ in range(draw.choice([3, 3, 3, 3, 2, 4]))]
        rows.append(sep.join([str(k), *cells]))
        if k % 37 == 0:
            rows.append("")
    path = folder / f"part{seed}.csv"
    path.write_bytes((end.join(rows) + end).encode())
    return path


@pytest.fixture
def small_splits(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for name, value in old.items():
        spark.conf.set(name, value)


def both(spark, path, sep=","):
    ours = csv_chunks.read_wide_csv(spark, str(path), sep)
    theirs = spark.read.options(header=True, multiLine=True, sep=sep, quote='"', escape='"').csv(str(path))
    assert ours.columns == theirs.columns
    return sorted(map(repr, ours.collect())), sorted(map(repr, theirs.collect()))


@pytest.mark.parametrize("size", ["41", "300", "128m"])
def test_equal_to_the_multi_line_reader_at_any_split(spark, tmp_path, small_splits, size):
    for seed in (1, 2):
        written(tmp_path, 150, seed)
    small_splits(size)
    ours, theirs = both(spark, tmp_path)
    assert len(ours) == 300 and ours == theirs


@pytest.mark.parametrize("most", [0, 100_000])
def test_other_separators(spark, tmp_path, small_splits, monkeypatch, most):
    monkeypatch.setattr(csv_chunks, "BROADCAST_SPLITS", most)
    path = written(tmp_path, 120, 3, "\t")
    small_splits(60)
    ours, theirs = both(spark, path, "\t")
    assert len(ours) == 120 and ours == theirs


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = written(tmp_path, 400, 4)
    small_splits(path.stat().st_size // 16)
    lines = spark.read.option("lineSep", "\n").text(str(path))
    assert lines.rdd.getNumPartitions() >= 16
    found = csv_chunks.records(spark, str(path))
    assert found.count() == 401 and found.where("first").count() == 1


def test_a_record_over_many_splits_and_one_that_never_closes(spark, tmp_path, small_splits):
    path = tmp_path / "long.csv"
    long = "\n".join(f"line {k}, with a comma" for k in range(60))
    path.write_text(f'a,b\n1,"{long}"\n2,x\n3,"open\nuntil the end')
    small_splits(50)
    found = {r.a: r.b for r in csv_chunks.read_wide_csv(spark, str(path)).collect()}
    assert found["1"] == long and found["2"] == "x" and len(found) == 3


def test_windows_line_ends_and_headers_that_differ(spark, tmp_path, small_splits):
    small_splits(30)
    path = tmp_path / "win.csv"
    path.write_bytes(b'a,a,b\r\n1,"x, y",z\r\n\r\n2,,"w"\r\n')
    assert sorted(map(tuple, csv_chunks.read_wide_csv(spark, str(path)).collect())) == [("1", "x, y", "z"), ("2", None, "w")]
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        csv_chunks.read_wide_csv(spark, str(tmp_path)).collect()
