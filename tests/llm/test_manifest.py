"""The Merkle manifest against a tree built in plain Python."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gapweave.llm import manifest
from gapweave.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """(root, the siblings of each digest level by level as (before, after))."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            low = i // 3 * 3
            path.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def expected(rows):
    """The rows that the query op11 asks for, in plain Python."""
    by_source = {}
    for row in rows:
        doc_id, *rest, text = row
        told = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        by_source.setdefault(row[1], []).append((doc_id, leaf(*row), leaf(doc_id, *rest, told)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        inner[s] = tree([x[1] for x in by_source[s]])
    root, above = tree([inner[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for (doc_id, digest, folded), path in zip(by_source[s], inner[s][1], strict=True):
            for before, after in path + up:
                folded = h(before, folded, after)
            proof = h(*[a + b for a, b in path + up])
            out.append((doc_id, digest, inner[s][0], root, proof, folded, folded == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def query(spark, tmp_path):
    def run(rows):
        frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("leaf"), F.lit(1).alias("idx"), F.lit("x").alias("proof"))
        frame.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return QUERIES["op11_manifest"](spark, str(tmp_path)).collect()

    return run


AWKWARD = [
    (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (None, "a", "en", 0, ""), (4, None, "de", 1, "é\n"), (4, None, "de", 1, "é\n"),
    (5, "", "en", 9, "\n" * 50_000), (6, "é", "", -1, "z"), (1, "a", "en", 3, "x\ny"), (7, "one", "en", 3, "a\nb"), (8, "z:", "-", 1, "-"),
]


def test_awkward_rows(query):
    found = query(AWKWARD)
    assert ordered(found) == ordered(expected(AWKWARD))
    assert {r.verified for r in found} == {True, False}


def test_empty_table(query):
    assert query([]) == []


@pytest.mark.parametrize("levels", [1, 2])
def test_many_tiers(spark, levels):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"t{i}\n" * (i % 4)) for i in range(400)] + [(900, "lone", "en", 1, "q")]
    frame = spark.createDataFrame(rows, SCHEMA)
    told = frame.select("doc_id", "source", manifest.leaf_digest(*frame.columns).alias("leaf"), F.lit(None).cast("string").alias("presented"))
    found = manifest.manifest(told, levels).collect()
    want = {r[0]: r for r in expected(rows)}
    for r in found:
        digest, subroot, root, proof = want[r.doc_id][1:5]
        assert (r.leaf, r.subroot, r.root, sha256(r.proof.encode()).hexdigest()) == (digest, subroot, root, proof)
        assert r.verified and manifest.fold(r.leaf, manifest.unpacked(r.proof, r.places)) == root
        assert manifest.fold(manifest._hash("other"), manifest.unpacked(r.proof, r.places)) != root
    assert len(found) == len(rows)


def test_one_hot_source(query):
    rows = [(i, "hot", "en", i, f"line {i}\nmore") for i in range(5_000)]
    assert ordered(query(rows)) == ordered(expected(rows))
