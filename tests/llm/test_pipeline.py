"""The whole pipeline over awkward rows, each stage against plain Python on all that the one before kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from gapweave.llm import quality
from tests.llm.test_operators import base, multiset, plain, shingles
from tests.llm.test_quality import log_weights

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["kept", "selected", "log_weight", "text_hash", "_row", "_extra", "n_words", "start", "sequence_id"]


def corpus():
    """(documents, ids labelled good, benchmark items)."""
    random = np.random.default_rng(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(letters[c] for c in random.integers(0, 26, random.integers(2, 10))) for _ in range(3_000)]
    draw = lambda n: [vocabulary[j] for j in random.integers(0, 3_000, n)]
    items = [(j, " ".join(draw(30 + j))) for j in range(6)] + [(90, None), (91, ""), (92, "two words"), (None, " ".join(draw(20)))]
    good = [draw(int(n)) for n in random.integers(60, 300, 150)]
    texts = [" ".join(t) for t in good]
    texts += [texts[k] for k in range(10)] * 2  # copies
    for k in range(10, 20):  # near copies, and copies of these: chains
        near = list(good[k])
        near[len(near) // 2] = "changed"
        texts += [" ".join(near), " ".join(near[1:])]
    for k in range(20, 30):  # some hold an item, whole or with a word of it changed
        item = items[k % 6][1].split()
        item[3 * (k % 2)] = "other" if k % 2 else item[0]
        texts.append(" ".join(good[k][:50] + item + good[k + 10][:40]).replace(" ", "\n", 3))
    texts += [" ".join(good[k]).upper() for k in range(30, 34)] + [" ".join(good[k][:20]) for k in range(34, 38)]
    texts += ["\n".join([" ".join(good[38][:60])] * 4), " ".join(draw(6_000)), " ".join(good[39] + ["#"] * 60), " ".join(good[40] + ["12"] * 200)]
    bad = ["".join(letters[c].upper() + "0" for c in random.integers(0, 26, 4)) for _ in range(200)]
    texts += [" ".join(bad[j] for j in random.integers(0, 200, 90)) for _ in range(30)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n\t")]
    rows += [(None, texts[50]), (None, texts[50]), (None, None), (51, " ".join(draw(80))), (52, texts[52]), (53, texts[60]), (5, texts[70])]
    return rows, list(range(150)), items


def passes(text):
    """Whether no quality rule rejects an ASCII text."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = base(text)
    lines = [x for x in (text or "").split("\n") if x.split()]
    lettered = sum(bool(re.search("[A-Za-z]", w)) for w in (text or "").split())
    upper, all_letters = len(re.findall("[A-Z]", text or "")), len(re.findall("[A-Za-z]", text or ""))
    return not (
        n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words
        or word_chars > 15 * n_words or 10 * n_dup_lines > 3 * len(lines) or 10 * lettered < 8 * n_words or 2 * upper > all_letters
    )


def one_of_each_class(rows):
    named = [(i, t, shingles(t)) for i, t in rows if i is not None]
    label = list(range(len(named)))
    for a, (_, _, p) in enumerate(named):
        for b in range(a):
            q = named[b][2]
            if label[a] != label[b] and p and q and 100 * len(p & q) >= 80 * len(p | q):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    classes = {}
    for (i, t, _), c in zip(named, label):
        classes.setdefault(c, []).append((i, t))
    return classes, [(i, t) for i, t in rows if i is None]


def contaminated(text, items):
    words = plain(text)
    for _, other in items:
        there = plain(other)
        q = multiset(there)
        for at in range(max(1, len(words) - len(there) + 1) if q else 0):
            p = multiset(words[at : at + len(there)])
            if sum((p & q).values()) >= 0.8 * sum((p | q).values()):
                return True
    return False


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, good, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 else "hot", len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS)
    docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in good] + [(i, 0, None) for i in range(220, 230)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, good, items


def test_every_stage_equals_plain_python(spark, tables, monkeypatch):
    from tokenizers import Tokenizer

    folder, rows, good, items = tables
    seen = {}

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs
            found = stage(spark, docs, sf_dir)
            assert name == "packing" or found.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), *CLASHES]
            return found

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [recorded(*s) for s in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {name: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()) for name, df in seen.items()}
    assert list(got) == ["quality_classifier", "quality_rules", "near_duplicates", "benchmark_decontamination", "packing"]
    assert got["quality_classifier"] == Counter(rows)
    assert all(r[c] == "clash" for r in seen["packing"].select(*CLASHES).collect() for c in CLASHES)

    # importance resampling: a held-out half of the good rows sets the cut
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    noise = {(r.doc_id, r.text): r.noise for r in frame.withColumn("noise", quality._noise(1)).collect()}
    ids = spark.createDataFrame([(i,) for i in good], "doc_id long")
    ids = [r.doc_id for r in quality.bounded_sample(ids, "doc_id", 2 * quality.TARGET_ROWS).collect()]
    keys = [w + noise[row] for row, w in zip(rows, log_weights(rows, set(ids[::2]), quality.EVIDENCE))]
    cut = np.quantile([k for (i, _), k in zip(rows, keys) if i in ids[1::2]], 1 - quality.KEEP)
    kept = Counter(row for row, k in zip(rows, keys) if k >= cut)
    assert got["quality_rules"] == kept and 0 < sum(kept.values()) < len(rows)

    kept = Counter({row: n for row, n in kept.items() if passes(row[1])})
    assert got["near_duplicates"] == kept < got["quality_rules"]

    classes, unnamed = one_of_each_class(list(kept.elements()))
    left = got["benchmark_decontamination"]
    for members in classes.values():  # the smallest id; of rows that share it, one
        first = min(i for i, _ in members)
        assert sum(left[row] for row in set(members) if row[0] == first) == 1
    assert sum(left.values()) == len(classes) + len(unnamed) < sum(kept.values())
    assert not Counter(unnamed) - left

    kept = Counter({row: n for row, n in left.items() if not contaminated(row[1], items)})
    assert got["packing"] == kept < left

    # packing: every token once, at its place
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {row: library.encode(row[1] or "", add_special_tokens=False).ids + [1] for row in kept}
    want, by = Counter(i for (i, _), n in kept.items() for _ in range(n)), {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(want)
    for row, own in tokens.items():
        if want[row[0]] == 1:
            at = 0
            for r in sorted(by[row[0]], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes()))
                at += r.length
            assert at == len(own)
    assert sum(r.length for r in pieces) == sum(len(tokens[row]) * n for row, n in kept.items())
    assert max(Counter({s: sum(r.length for r in pieces if r.sequence_id == s) for s in {r.sequence_id for r in pieces}}).values()) <= 2048
