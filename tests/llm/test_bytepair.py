"""Byte-level BPE against the tiktoken library."""

import base64
import random
from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from gapweave.llm import bytepair
from gapweave.llm.queries import QUERIES

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
TEXTS = [
    (1, "Hello world, don't stop!"), (2, None), (3, ""), (4, "a" * 100_000), (5, " \n\t  x  \n\n"), (6, "der été 你好 😀 ̀ \x00\x7f"),
    (None, "<|endoftext|>"), (1, "Hello world, don't stop!"), (7, " ".join(f"ingthere{i}edly" for i in range(4_000))), (8, "=" * 3_001 + " 1234567890" * 50),
]


def library(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    with open(public_tokenizers.path(request.param), "rb") as lines:
        return bytepair.BytePairs(lines.read(), public_tokenizers.PATTERN), library(request.param)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("abeinghtrs =-\n\t1'é你😀̀\x85\xa0")) | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_equal_to_the_library(both, texts):
    ours, theirs = both
    found = ours.encode(texts)
    assert [ids(x) for x in found] == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(x) for x in found] == [t.encode() for t in texts]


def test_random_syllables_and_long_runs(both):
    ours, theirs = both
    rng = random.Random(5)
    parts = ["ing", "the", "ed", "an", "th", "er", "re", "ou", "s", "e", "a", "t", "ly", "sh", "é", "="]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(200)) for _ in range(20)]
    texts += ["ab" * 20_000, "the" * 9_000, "".join(rng.choices("abcd", k=30_000)), " " * 10_000, "x" * bytepair.WINDOW * 3]
    assert [ids(x) for x in ours.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_alone_and_side_by_side_agree(both):
    ours, _ = both
    rng = random.Random(6)
    pieces = ["".join(rng.choices("thesingour", k=rng.randint(2, bytepair.LONGEST))).encode() for _ in range(500)]
    pieces = [p for p in pieces if p not in ours.ranks]
    assert [ids(x) for x in ours.encode_pieces(pieces)] == [ours.encode_piece(p) for p in pieces]


def test_memos_stay_small(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bytepair, "MEMO_PIECES", 50)
    monkeypatch.setattr(bytepair, "MEMO_PAIRS", 20)
    monkeypatch.setattr(bytepair, "TURN", 100)
    texts = [" ".join(f"word{i * k}ing" for i in range(300)) + " " + "longer" * 40 for k in range(1, 5)]
    assert [ids(x) for x in ours.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert len(ours.beside) <= 20 and len(ours.pieces) <= 50 + 4 * 100


def test_a_vocabulary_without_some_byte_is_refused():
    with pytest.raises(ValueError, match="every byte"):
        bytepair.BytePairs(b"YQ== 0\nYg== 1", public_tokenizers.PATTERN)


def test_query(spark, tmp_path):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit("clash").alias("ids"), F.lit("clash").alias("n_tokens"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    theirs = library(NAMES[0])
    want = []
    for doc_id, text in TEXTS:
        tokens = theirs.encode_ordinary(text or "")
        want.append((doc_id, len(tokens), sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    found = QUERIES["op12_bytepair"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_ids_are_decoded_again(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    path, pattern = public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN
    coded = bytepair.encoded(frame, path, pattern)
    again = bytepair.decoded(coded.drop("decoded").union(frame.limit(1).selectExpr("doc_id", "text", "0L", "null")), path, pattern).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again if r.ids is not None)
    assert [bytes(r.decoded) for r in again if r.ids is None] == [b""]
    assert bytepair.encoded(frame.limit(0), path, pattern).count() == 0
