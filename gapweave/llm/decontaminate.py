"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, rare shingles beyond them, exact check. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.llm.tables import store, text_or_empty
from gapweave.operators.lineage import once

WORDS = 5
SIMILARITY = 0.8
#: Pairs whose 64-bit fingerprints are within this Hamming distance are met by blocks, others by a rare shingle.
RADIUS = 16
#: A benchmark with up to so many shingles is broadcast (about 32 bytes each); a larger one is joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Hash slots of documents that are broadcast to leave others out of a shuffle.
SLOTS = 1 << 21


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingles(words: str, size: int) -> Column:
    """Hashes of all runs of size words, in order; empty for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: str) -> Column:
    """64-bit SimHash: a bit is set where more than half of the shingles, by their occurrences, have it set."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CASE WHEN 2 * aggregate({shingles}, 0L, "
        f"(c, s) -> c + (shiftright(s, b) & 1L)) > size({shingles}) THEN 1L ELSE 0L END, b))"
    )


def _blocks(radius: int) -> Column:
    """radius + 1 stretches of the fingerprint; fingerprints within radius agree in one of them at least."""
    bounds = [64 * j // (radius + 1) for j in range(radius + 2)]
    part = lambda low, high: F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
    return F.array(*[F.struct(F.lit(j).alias("block"), part(a, b).alias("value")) for j, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])


def _starts(size: int, similarity: float) -> Column:
    """Spans (low, high) of the starts of all windows that can reach an item of n_words words; no two spans overlap.

    places: where the document's shingles are those of an item of that length, in order. Windows of
    a and b shingles with the similarity share at least similarity * (a + b) / (1 + similarity),
    by occurrences, so a window holds as many places. A start belongs to the first place it holds.
    """
    own = F.least("total", "n_words") - size + 1
    need = F.greatest(F.lit(1), F.ceil(similarity * (own + F.col("n_words") - size + 1) / (1 + similarity) - 1e-6).cast("int"))
    last = F.greatest(F.lit(0), F.col("total") - F.col("n_words"))

    def span(i):
        low = F.greatest(F.lit(0), F.get("places", i + need - 1) - own + 1, F.coalesce(F.get("places", i - 1) + 1, F.lit(0)))
        return F.struct(low.alias("low"), F.least(F.get("places", i), last).alias("high"))

    spans = F.transform(F.sequence(F.lit(0), F.size("places") - need), span)
    found = F.filter(spans, lambda x: x.getField("low") <= x.getField("high"))
    return F.when(F.size("places") >= need, found)


def _with_multiset(df: DataFrame, name: str, words: str, size: int) -> DataFrame:
    """df with the shingles of words as text, each with the number of its earlier occurrences: a multiset as a set."""
    text = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.concat_ws(" ", F.slice(words, i, size)))
    earlier = lambda s, i: F.size(F.filter(F.slice("_text", 1, i), lambda x: x == s)).cast("string")
    # counting earlier ones takes a square of the words, so only where some repeat
    again = F.size(F.array_distinct("_text")) < F.size("_text")
    numbered = F.transform("_text", lambda s, i: F.concat(s, F.lit("\n"), F.when(again, earlier(s, i)).otherwise("0")))
    return once(once(df, "_text", text), name, numbered).drop("_text")


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, start, n_words, distance, similarity: the best window of a document for each item it holds.

    docs: doc_id, text; benchmark: item_id, text. The similarity of a window and an item is
    the Jaccard similarity of their shingles of size words, weighted by occurrences; an item
    is found where a window of as many words as the item reaches it.

    All windows count, wherever they start. One with too few shingles that are any item's of
    its length cannot reach the similarity and is left out (see _starts); every other one
    gets a SimHash; items of the same length within radius are found by joining radius + 1
    blocks of the fingerprints, which loses none of them. Similar pairs can be farther apart:
    those are found by the shingles of the item that fewest items hold, so many that no
    similar window misses all. Then the similarity is computed from the words, so the
    radius decides speed only.

    Items with fewer than size words, null and empty texts match nothing. Rows with a null
    doc_id or item_id are reported with it. Equal rows of docs (doc_id and text) are reported
    once. Of equally similar windows the first is reported.
    """
    items = (
        benchmark.select("item_id", words_of(text_or_empty()).alias("item_words"))
        .where(F.size("item_words") >= size)
        .distinct()
        .withColumn("item_shingles", _shingles("item_words", size))
        .withColumn("n_words", F.size("item_words"))
    )
    items = store(items.withColumn("fingerprint", fingerprint("item_shingles")).withColumn("item", F.monotonically_increasing_id()))
    marks = items.select("n_words", F.explode("item_shingles").alias("shingle")).distinct()
    fits = items.agg(F.sum(F.size("item_shingles"))).first()[0] or 0
    fits = fits <= BROADCAST_SHINGLES

    told = once(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "words", words_of(text_or_empty())).drop("text")
    # no words go along: a row per shingle is joined and shuffled with its place alone
    shingled = told.select("doc_id", "text_hash", F.size("words").alias("total"), F.posexplode(_shingles("words", size)).alias("at", "shingle"))
    anchors = shingled.join(_small(marks, fits), "shingle")
    places = anchors.groupBy("doc_id", "text_hash", "total", "n_words").agg(F.sort_array(F.collect_set("at")).alias("places"))
    laid = store(places.select("doc_id", "text_hash", "n_words", F.explode(_starts(size, similarity)).alias("span")))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")  # at most SLOTS numbers are broadcast
    asked = docs.select("doc_id", "text", slot).join(F.broadcast(laid.select(slot).distinct()), "slot", "left_semi")
    texts = asked.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text").dropDuplicates(["_id", "_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    spans = once(laid.join(texts, same), "words", words_of(text_or_empty()))
    spans = spans.select("doc_id", "text_hash", "n_words", "words", F.explode(F.sequence("span.low", "span.high")).alias("start"))
    windows = spans.select("doc_id", "text_hash", "n_words", "start", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("window"))
    probes = store(once(once(windows, "shingles", _shingles("window", size)), "fingerprint", fingerprint("shingles")).withColumn("probe", F.monotonically_increasing_id()))
    index = items.select("item_id", "item_words", "n_words", F.col("fingerprint").alias("item_print"), F.explode(_blocks(radius)).alias("b"))
    index = index.select("item_id", "item_words", "n_words", "item_print", "b.block", "b.value")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    near = (
        probes.select("*", F.explode(_blocks(radius)).alias("b"))
        .select("doc_id", "text_hash", "n_words", "start", "window", "fingerprint", "b.block", "b.value")
        .join(_small(index, fits), ["n_words", "block", "value"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= radius)
        # met in several blocks: count it in the first of them only
        .where(F.col("block") == _first_block(radius))
    )
    shared = probes.select("probe", "n_words", F.explode("shingles").alias("shingle")).join(_small(_rare(items, similarity, fits), fits), ["n_words", "shingle"])
    absent = F.size(F.array_except("shingles", "item_shingles"))
    far = (
        shared.select("probe", "item")
        .distinct()
        .join(_small(items.select("item", "item_id", "item_words", "item_shingles", F.col("fingerprint").alias("item_print")), fits), "item")
        .join(probes, "probe")
        .withColumn("distance", distance)
        .where(F.col("distance") > radius)
        # the similarity is not above this, as absent shingles occur once at least
        .where(F.size("shingles") - absent >= similarity * (F.size("item_shingles") + absent) - 1e-6)
    )
    columns = ["doc_id", "text_hash", "item_id", "item_words", "n_words", "start", "window", "distance"]
    met = near.select(columns).unionByName(far.select(columns))
    a, b = F.col("a"), F.col("b")
    both = F.size(F.array_intersect(a, b))
    compared = _with_multiset(_with_multiset(met, "a", "window", size), "b", "item_words", size).withColumn(
        "similarity", both / (F.size(a) + F.size(b) - both)
    )
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return (
        compared.where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.start", "best.n_words", "best.distance", "best.similarity")
    )


def _rare(items: DataFrame, similarity: float, fits: bool) -> DataFrame:
    """item, n_words, shingle: shingles of each item, the rarest among items of its length; a similar window holds one at least.

    Of an item's n shingles, by their occurrences, a similar window misses at most (1 -
    similarity) * n, as the union is not smaller than n. One more than that are taken.
    """
    each = items.select("item", "n_words", F.size("item_shingles").alias("n"), F.explode("item_shingles").alias("shingle"))
    held = each.select("item", "n_words", "shingle").distinct().groupBy("n_words", "shingle").agg(F.count(F.lit(1)).alias("items"))
    order = Window.partitionBy("item").orderBy("items", "shingle")  # a group is one item
    taken = each.join(_small(held, fits), ["n_words", "shingle"]).withColumn("turn", F.row_number().over(order))
    return store(taken.where(F.col("turn") <= F.floor((1 - similarity) * F.col("n") + 1e-6) + 1).select("item", "n_words", "shingle").distinct())


def _first_block(radius: int) -> Column:
    """The first block in which fingerprint and item_print agree."""
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    bounds = [64 * j // (radius + 1) for j in range(radius + 2)]
    first = F.lit(None).cast("int")
    for j in range(radius, -1, -1):
        mask = (1 << (bounds[j + 1] - bounds[j])) - 1
        same = F.shiftrightunsigned(differ, bounds[j]).bitwiseAND(F.lit(mask)) == 0
        first = F.when(same, F.lit(j)).otherwise(first)
    return first


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that hold no item of benchmark. Rows are told apart by doc_id and text."""
    found = contaminated(docs.select("doc_id", "text"), benchmark, size, similarity, radius)
    bad = store(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    same = (F.xxhash64(docs["text"]) == F.col("_hash")) & docs["doc_id"].eqNullSafe(F.col("_id"))
    return docs.join(bad, same, "left_anti")
