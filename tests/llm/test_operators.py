"""The text operators on awkward rows, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from gapweave.llm import archive, decontaminate, jaccard_join, licences, packing, quality, rules, sharding, token_counts, toxicity
from gapweave.llm.components import components

LOREM = " ".join(f"w{i * 7 % 301}" for i in range(900))
NEAR = " ".join(LOREM.split()[:895] + ["x1", "x2"])
TEXTS = [
    (1, LOREM), (2, LOREM), (3, NEAR), (4, None), (5, ""), (6, "one two"), (7, "One TWO"), (None, LOREM), (8, LOREM + " tail"),
    (9, "a\tb\x0bc  d\ne" * 3000), (10, "x" * 300_000), (6, "one two"), (11, "der été <|endoftext|> don't 你好 12 !!"),
]
SCHEMA = "doc_id long, text string"
EXTRA = ["score", "shard", "kept", "n_tokens", "labels", "_text", "size", "a", "rep", "selected", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, SCHEMA)
    return frame.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 2)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def data(text):
    return (text or "").encode()


def test_quality(docs, none, labels):
    found = quality.resample(docs, labels.where("quality = 1")).collect()
    assert len(found) == len(TEXTS) and all(r.gumbel_key >= r.log_weight - 4 for r in found)
    assert {r.log_weight for r in found if not r.text} == {0.0}
    assert quality.resample(none, labels).count() == 0
    assert all(r.selected for r in quality.resample(docs, labels.limit(0)).collect())


def test_quality_cut_does_not_hang_on_two_odd_rows(spark):
    random = np.random.default_rng(7)
    draw = lambda kind: " ".join(f"{kind}{random.integers(60)}" for _ in range(80))
    rows = [(i, draw("good" if i < 800 else "zzq")) for i in range(1200)]
    rows[795:800] = [(i, draw("zzq")) for i in range(795, 800)]  # labelled good by mistake
    good = spark.range(800).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id for r in quality.resample(spark.createDataFrame(rows, SCHEMA), good).where("selected").collect()}
    assert len(kept & set(range(795))) >= 0.95 * 795 and len(kept & set(range(800, 1200))) <= 0.05 * 400


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.token_counts(docs, path).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(data(r.text)), n, n > 2048)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_keep_the_case_of_special_strings(spark):
    from tokenizers import Tokenizer

    texts = ["<|ENDOFTEXT|>", "a<|EndOfText|>b", "A<|endoftext|>B <|endoftext|>", "Plain WORDS <|StartOfText|> Plain", "<|EndOf Text|> ÉTÉ İ"] * 3
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # folds case, does not
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        for frequent in (4_000, 0):  # by the frequent table, by the worker's cache
            found = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path, sample_rows=frequent)
            got = {r.doc_id: r.n_tokens for r in found.collect()}
            assert got == {i: sum(len(library.encode(p, add_special_tokens=False).ids) for p in t.split()) for i, t in enumerate(texts)}


def test_toxicity(spark, docs, none, labels):
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in found)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] < 0.01
    words = [" ".join(f"v{(i * j) % 97}" for j in range(1, 60)) for i in range(1, 400)]
    rows = [(i, f"{t} nasty{i % 4}bad nasty word" if i % 5 == 0 else t) for i, t in enumerate(words)]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    scored = [r for r in toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), marks).collect() if r.held_out]
    bad, good = ([r.score for r in scored if (r.doc_id % 5 == 0) == x] for x in (True, False))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.95


def base(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", data(text))
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in data(text).split(b"\n") if x.strip()]
    return (
        len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


def test_rules(docs, none):
    found = rules.cascade(docs, complete=rules.BASE).collect()
    assert all(tuple(r[c] for c in rules.BASE) == base(r.text) for r in found) and len(found) == len(TEXTS)
    assert {(r.doc_id, r.kept) for r in found if not r.text} == {(4, False), (5, False)}
    assert all(r.kept for r in found if r.doc_id in (1, 2, 3, 8)) is False  # LOREM repeats its windows
    backwards = rules.cascade(docs, rules.RULES[::-1]).select("doc_id", "kept").collect()
    assert Counter(backwards) == Counter(rules.cascade(docs).select("doc_id", "kept").collect())
    assert rules.cascade(none).count() == 0


def test_sharding(spark, docs, none):
    found = sharding.shards(docs).collect()
    assert len(found) == len(TEXTS) and sharding.shards(none).count() == 0
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((i, len(data(t)) + 8, zlib.crc32(data(t))) for i, t in TEXTS)
    # one text holds half of all rows, and every other row is a text of its own
    many = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 40).cast("int"))).alias("text"))
    rows = sharding.shards(many.withColumnRenamed("id", "doc_id")).toPandas()
    by = rows.groupby("shard")
    assert by["size"].sum().max() <= 1.02 * by["size"].sum().min() and by.size().max() <= 1.15 * by.size().min()
    assert all(sorted(s) == list(range(len(s))) for _, s in by["slot"])


def test_shards_balance_real_tokens(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    found = sharding.measured(docs, path).collect()
    assert Counter((r.doc_id, r["size"], r.tokens, r.text_crc32) for r in found) == Counter(
        (i, len(data(t)) + 8, count(t), zlib.crc32(data(t))) for i, t in TEXTS
    )
    # texts of equal bytes and words, every second one of rare characters and so of many tokens
    random = np.random.default_rng(8)
    rows = []
    for i in range(3_000):
        word = "the" if i % 2 else "qxz"
        rows.append((i, " ".join([word] * int(random.integers(10, 60)) + [f"{i:06d}"])))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.lit("clash"))
    shard = {r.doc_id: r.shard for r in sharding.shards(frame, tokenizer=path).collect()}
    tokens, size = Counter(), Counter()
    for i, t in rows:
        tokens[shard[i]] += count(t)
        size[shard[i]] += len(t) + 8
    assert len(shard) == 3_000 and max(size.values()) <= 1.02 * min(size.values()) and max(tokens.values()) <= 1.05 * min(tokens.values())


def test_equal_texts_share_a_shard(spark):
    rows, texts = [], 0
    for members in [60, 25, 9, 5] + [2] * 300 + [1] * 800:  # a shard has 62 or 63 of the 1,499 rows
        rows += [f"text {texts} " + "word " * (10 + texts % 10)] * members
        texts += 1
    rows += ["hot"] * 700  # more than a shard
    found = sharding.shards(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).toPandas()
    by = found.assign(text=[rows[i] for i in found["doc_id"]]).groupby("text")["shard"].nunique()
    assert by["hot"] > 1 and by.drop("hot").max() == 1 and len(found) == len(rows)
    size = found.groupby("shard")["size"].sum()
    assert size.max() <= 1.1 * size.min()


def test_archive(spark, tmp_path):
    big, other = "<p>" + "é" * 100, "x" * 100
    rows = [(3, "u3", big), (1, "u\r\n1", big), (2, None, big), (None, "u", big), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "v", "only" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    store = archive.write(pages)
    assert store.payloads.count() == len({data(h) for _, _, h in rows})
    found = archive.read(store).collect()
    want = []
    for i, _, h in rows:
        ids = [p for p, _, q in rows if data(q) == data(h) and p is not None]
        again = len(data(h)) >= 100 and bool(ids) and (i is None or i > min(ids))
        want.append((i, len(data(h)), "revisit" if again else "response", min(ids) if again else None))
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found) == Counter(want)
    archive.export(store, str(tmp_path / "warc"))
    said = Counter((r.header, "" if r.record_type == "revisit" else r.payload) for r in found)
    assert Counter((r.header, r.payload) for r in archive.scan(spark, str(tmp_path / "warc")).collect()) == said
    assert archive.read(archive.write(pages.limit(0))).count() == 0


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data(text)))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def classes(rows):
    """doc_id -> smallest doc_id reachable, all pairs compared."""
    label = {i: i for i, _ in rows if i is not None}
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    moved = True
    while moved:
        moved = False
        for i, p in sets:
            for j, q in sets:
                if label[i] != label[j] and (i == j or p and q and 100 * len(p & q) >= 80 * len(p | q)):
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return label


def test_jaccard(spark, docs, none):
    want = classes(TEXTS)
    found = jaccard_join.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((i, len(shingles(t)), want.get(i)) for i, t in TEXTS)
    assert jaccard_join.jaccard_classes(none).count() == 0
    kept = jaccard_join.first_of_class(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {i for i in want if want[i] == i} | {None})
    assert kept.columns == docs.columns


def test_jaccard_against_all_pairs(spark):
    random = np.random.default_rng(3)
    rows = []
    for group in range(12):  # drifting copies: neighbours link, the ends need not
        text = [f"g{group}x{k}" for k in range(int(random.integers(6, 160)))]
        for _ in range(15):
            rows.append((int(random.integers(1, 10**6)), " ".join(text)))
            for place in random.integers(0, len(text), max(1, len(text) // 60)):
                text[place] = f"n{random.integers(10**6)}"
    passage = " ".join(f"common{k}" for k in range(50))
    rows += [(2_000_000 + k, f"{passage} " + " ".join(f"r{k}y{j}" for j in range(int(random.integers(0, 60))))) for k in range(60)]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 500).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    found = components(edges.union(edges.limit(3))).collect()
    assert {r.node for r in found} == set(range(500)) and {r.component for r in found} == {0}
    assert components(edges.limit(0)).count() == 0


def plain(text):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").lower()).split()


def multiset(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_decontaminate(spark, docs, none):
    item = "The quick brown fox jumps over the lazy dog near a river bank today and every day"
    near = item.replace("The quick", "A quick") + " again"
    items = [(1, item), (2, item), (3, "too short"), (4, None), (None, "never seen words in any text at all here"), (5, "aa bb cc dd ee " * 4)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit("clash"))
    rows = TEXTS + [(20, f"{LOREM}, {item.upper()}! {LOREM}"), (21, item), (22, near), (None, f"x {item}"), (23, item[:50]), (24, "aa bb cc dd ee " * 9)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("clash"))
    want = set()
    for i, text in rows:
        words = plain(text)
        for j, other in items:
            there = plain(other)
            q = multiset(there)
            for at in range(max(1, len(words) - len(there) + 1)):
                p = multiset(words[at : at + len(there)])
                if q and sum((p & q).values()) >= 0.8 * sum((p | q).values()):
                    want.add((i, j))
    found = decontaminate.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and {(20, 1), (21, 2), (None, 1), (24, 5)} <= want
    assert decontaminate.contaminated(none, benchmark).count() == 0 == decontaminate.contaminated(frame, benchmark.limit(0)).count()
    clean = decontaminate.decontaminated(frame, benchmark)
    left = [(i, t) for i, t in rows if not any(i == x and (i is not None or t == f"x {item}") for x, _ in want)]
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(left) and clean.columns == frame.columns
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_decontaminate_moves_no_words_per_shingle(spark, monkeypatch):
    random = np.random.default_rng(12)
    items = [(j, " ".join(f"v{random.integers(200)}" for _ in range(20))) for j in range(30)] + [(99, "a b c d e f g")]
    texts = [" ".join(["lead"] * (j % 4) + text.split()[:18] + ["end", "of", "it"]) for j, text in items]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (None, texts[2]), (None, texts[2]), (5, None)]
    frame, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    small = Counter(decontaminate.contaminated(frame, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 10)
    found = decontaminate.contaminated(frame, benchmark)
    assert small and Counter(found.collect()) == small


def test_decontaminate_finds_similar_windows_beyond_the_radius(spark):
    random = np.random.default_rng(11)
    items, rows, want = [], [], set()
    for j in range(60):
        n = (50, 60, 150)[j % 3]
        words = [f"v{random.integers(10**6)}" for _ in range(n)]
        items.append((j, " ".join(words)))
        for _ in range(20):  # documents as long as the item: one window each
            copy = list(words)
            for place in random.integers(0, n, n // 50):
                copy[place] = f"n{random.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            p, q = multiset(copy), multiset(words)
            if sum((p & q).values()) >= 0.8 * sum((p | q).values()):
                want.add((rows[-1][0], j))
    # a shingle of many occurrences weighs much in a fingerprint
    items.append((60, " ".join(f"u{k}" for k in range(200)) + " again" * 24))
    rows.append((len(rows), " ".join(f"u{k}" for k in range(200)) + " " + " ".join(f"o{k}" for k in range(24))))
    p, q = multiset(rows[-1][1].split()), multiset(items[-1][1].split())
    assert sum((p & q).values()) >= 0.8 * sum((p | q).values())
    want.add((rows[-1][0], 60))
    found = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert sum(r.distance > decontaminate.RADIUS for r in found) > 1


def test_decontaminate_looks_at_every_start(spark):
    """Windows that are aligned with no shingle of the item count as well: moved halves, shifts in both directions."""
    random = np.random.default_rng(13)
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    items, rows = [(0, words("a", 60)), (1, words("b", 100)), (2, words("r", 5) * 8 + words("s", 30))], []
    rows.append(words("x", 7) + items[0][1][30:] + items[0][1][:30] + words("y", 9))  # halves exchanged
    rows.append(items[1][1][40:] + items[1][1][:40])  # the same as the whole text
    rows.append(items[0][1][2:31] + words("z", 2) + items[0][1][31:] + items[0][1][:2])
    rows.append(words("x", 30) + items[2][1][20:] + items[2][1][:20] + words("y", 30))
    for _ in range(12):  # parts of items in another order, with gaps
        parts, item = [], items[random.integers(3)][1]
        cuts = sorted(random.integers(0, len(item), 2))
        for a, b in ((cuts[0], cuts[1]), (cuts[1], len(item)), (0, cuts[0])):
            parts += item[a:b] + words("g", random.integers(3))
        rows.append(words("h", random.integers(9)) + parts + words("i", random.integers(9)))
    best = {}
    for i, row in enumerate(rows):
        for j, item in items:
            for at in range(max(1, len(row) - len(item) + 1)):
                p, q = multiset(row[at : at + len(item)]), multiset(item)
                likeness = sum((p & q).values()) / sum((p | q).values())
                if likeness >= 0.8 and likeness > best.get((i, j), (0, 0))[0]:
                    best[i, j] = (likeness, at)
    frame = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], SCHEMA)
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(frame, benchmark).collect()}
    assert found == best and {(0, 0), (1, 1), (3, 2)} <= set(best)


def test_licences(spark, docs, none):
    mit = licences.TEMPLATES["mit"]
    rows = TEXTS + [
        (30, f"Code. {mit.upper()}. CC-BY or cc by, All rights\nreserved"), (31, mit[: len(mit) // 4]), (32, "cc by cc by"), (33, "general public license" * 2),
        (34, " ".join(mit.split()[:12]) + " xx " + " ".join(mit.split()[13:])),
    ]
    found = {(r.doc_id, r.text): r for r in licences.scan(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))).collect()}
    for (_, text), r in found.items():
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data(text)))]
        places = [(k, label) for phrase, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    by = {i: r for (i, _), r in found.items()}
    assert by[30].labels == "cc-by,mit,reserved" and by[31].labels == "" and by[34].labels == "mit" and by[4].score == 0
    assert licences.scan(none).count() == 0


def test_matches_are_the_longest():
    words = [0, 1, 2, 3, 1, 2, 4]
    known = licences.Automaton([words, [2, 3, 1, 5]])
    text = [9, 1, 2, 3, 1, 5, 9, 0, 1, 2, 4, 1, 2, 3, 1, 2]
    got = {(end, size) for end, size, _ in known.matches(text, 2)}
    inside = lambda part: any(t[k : k + len(part)] == part for t in (words, [2, 3, 1, 5]) for k in range(len(t)))
    longest = {}
    for end in range(len(text)):
        longest[end] = max((n for n in range(1, end + 2) if inside(text[end - n + 1 : end + 1])), default=0)
    want = {(e, n) for e, n in longest.items() if n >= 2 and longest.get(e + 1, 0) <= n}
    assert got == want


def test_a_match_inside_a_longer_one_of_another_template_counts(spark):
    a, b = "x0 a1 b2 c3 d4 e5 f6 g7", "a1 b2 c3 d4 e5 f6 g7 y8"
    found = licences.scan(spark.createDataFrame([(1, f"{a} zz"), (2, f"q {a} y8 a1 b2 c3"), (3, "a1 b2 c3 d4")], SCHEMA), {"A": a, "B": b}).collect()
    assert {r.doc_id: r.labels for r in found} == {1: "A,B", 2: "A,B", 3: ""}


def test_occurrences_against_all_stretches():
    random = np.random.default_rng(4)
    for _ in range(150):
        templates = [random.integers(0, 3, random.integers(1, 12)).tolist() for _ in range(3)]
        text = random.integers(0, 4, 20).tolist()
        want = set()
        for number, t in enumerate(templates):
            for i in range(len(text)):
                for j in range(len(t)):
                    if i and j and text[i - 1] == t[j - 1]:
                        continue
                    n = 0
                    while i + n < len(text) and j + n < len(t) and text[i + n] == t[j + n]:
                        n += 1
                    if n >= 2:
                        want.add((i + n - 1, n, number, j + n - 1))
        got = licences.Automaton(templates).occurrences(text, 2)
        assert len(got) == len(set(got)) and set(got) == want


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = TEXTS[:9] + [(100 + k, LOREM[: 17 * k]) for k in range(200)] + TEXTS[9:]
    found = packing.packed(spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash")), path).collect()
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in rows:
        if i == 6:
            continue  # two equal rows of one id
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= sum(r.length for r in found) / 2048 * 1.01 + 2
    assert packing.packed(none.select("doc_id", "text"), path).count() == 0


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
