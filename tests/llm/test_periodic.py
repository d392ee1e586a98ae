"""Periodic runs against all periods tried one by one."""

import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gapweave.llm import periodic
from gapweave.llm.queries import QUERIES


def brute(ids, words=6, periods=4):
    out, n = [], len(ids)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(ids[k] == ids[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(words, periods * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    ids = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 5]))), max_size=50))
    for _ in range(draw(st.integers(0, 2))):
        block = draw(st.lists(st.integers(0, 2), min_size=1, max_size=6))
        at = draw(st.integers(0, len(ids)))
        ids[at:at] = (block * 9)[: draw(st.integers(1, 9 * len(block)))]
    return ids


@settings(max_examples=1500, deadline=None)
@given(ids=sequences())
def test_runs(ids):
    assert periodic.runs_of(np.array(ids, np.int64)) == brute(ids)


@settings(max_examples=300, deadline=None)
@given(ids=sequences(), words=st.integers(1, 12), periods=st.integers(3, 6))
def test_runs_of_other_sizes(ids, words, periods):
    assert periodic.runs_of(np.array(ids, np.int64), words, periods) == brute(ids, words, periods)


def test_long_sequences():
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs_of(np.arange(60_000) % 777) == [(0, 60_000, 777)]
    assert periodic.runs_of(np.arange(60_000)) == []
    with pytest.raises(ValueError, match="three periods"):
        periodic.runs_of(np.zeros(9, np.int64), periods=2)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    crc = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if crc is not None and crc % 10 == 0 and n:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if not runs else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()


def test_query(spark, tmp_path):
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    prose = " ".join(f"w{i * 7 % 301}" for i in range(300))
    rows = [(i, prose) for i in chosen[:12]] + [(chosen[12], None), (chosen[13], ""), (chosen[14], " \n "), (chosen[15], "one")]
    rows += [(1001, "a b " * 20 + "c " * 9), (1002, None), (1003, ""), (1004, "x\x0by\tz\n" * 30 + "été 你 " * 10), (None, "q " * 8), (1001, "a b " * 20 + "c " * 9)]
    rows += [(1005, "one line of text\n" * 40), (1006, "w" * 200_000), (1007, "a A " * 9), (1008, " lead and trail  " * 5), (1009, prose)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.select("*", F.lit("clash").alias("runs"), F.lit("clash").alias("w"), F.lit(1).alias("collapsed")).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_periodic"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([expected(*r) for r in rows], key=repr)
    assert any(r.n_runs > 1 for r in found)


def test_spans_and_text(spark):
    frame = spark.createDataFrame([(1, "go go go go go go on", "x"), (2, None, "y")], "doc_id long, text string, runs string")
    found = {r.doc_id: r for r in periodic.periodic_runs(frame).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 6, 1)] and found[1].collapsed == "go on" and found[1].n_words == 7
    assert found[2].runs == [] and found[2].collapsed == "" and found[2].n_words == 0
    assert periodic.periodic_runs(frame.limit(0)).count() == 0
