"""Parity-sketch similarity join of shingle sets, and the classes it links.

A set is sketched by toggling one bit per shingle (XOR), so the Hamming distance of two
sketches never exceeds the symmetric difference of the sets. Sets that reach the
similarity differ in at most d shingles, d given by their sizes; a sketch cut into more
than d blocks then has a block without a difference. Blocks are joined by their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.llm.arrays import FOLD, SPACES, U64, mix, shingle_sets, words
from gapweave.llm.components import components
from gapweave.llm.tables import discard, few, give_back, map_batches, spread_join, store, temporary

WORDS = 5
PERCENT = 80
#: Block keys that one task compares, and that are gathered before equal ones are merged.
BUCKET_KEYS = 1 << 18
SEGMENT_KEYS = 1 << 18
#: Words of the whole-set parity sketch that is compared before the sets themselves.
SKETCH = [f"s{k}" for k in range(8)]
#: A byte for each block of the sketch, in a set's own band and in the next one.
CODES = ["own", "following"]
#: How many keys of an even and of an odd band a set may do without, as it shares more with each linked one.
MORE = ["even_more", "odd_more"]
#: Rounds with other centers at most, before the rest is compared pair by pair.
TURNS = 8
#: Members of one block that are compared at once.
TILE = 1_024
#: Rows of tiles that one task compares, and bytes of their long sketches.
TASK_ROWS = 1 << 14
TASK_BYTES = 1 << 25
#: Sets above so many shingles compare a long parity sketch instead: four bits a shingle at least, and at most so many.
LONG_SET = 128
MOST_BITS = 1 << 17
#: Hash slots of documents that are broadcast to leave others out of a shuffle.
SLOTS = 1 << 21


class Bands:
    """Size bands in which a linked pair lies in the same or in neighbouring bands, with the blocks that each needs."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.largest = 0
        self.reach(largest)

    def reach(self, largest: int) -> Bands:
        """Extend the bands to sets of so many shingles."""
        if largest <= self.largest:
            return self
        self.largest = 2 * largest
        edges = [1]
        while edges[-1] <= 2 * self.largest * 100 // self.percent + 2:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // self.percent)))
        self.edges = np.array(edges)
        # sets of at most h shingles that reach the similarity differ in at most 2 h (100 - p) / (100 + p)
        high = self.edges[1:] - 1
        self.differ = 2 * high * (100 - self.percent) // (100 + self.percent)
        # blocks beyond differ + 1 are spare: so many empty ones may go unused
        self.spare = -(-(self.differ + 1) // 5) + 3
        self.blocks = self.differ + 1 + self.spare
        return self

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1


def _blocks(shingles: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, code) of the blocks of the sketch that hold something.

    A block is a stretch of 2**40 sketch bits, one per shingle hash, written as the XOR of a
    code per set bit: equal blocks have equal codes.
    """
    block = ((shingles >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)  # the hashes are sorted, so blocks are
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return block[starts], np.bitwise_xor.reduceat(mix(shingles ^ U64(0x5BD1E995)), starts)


def block_keys(shingles: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """A 64-bit key for each block of the sketch that must be joined in this band.

    Of k blocks at least k - differ are equal in a linked pair. Empty blocks go unused unless
    they are more than spare: one of the equal blocks of a pair is then neither empty nor
    unused, in the member with fewer. Bit 32 tells whether the band is odd.
    """
    k = int(bands.blocks[band])
    number, code = _blocks(shingles, k)
    if k - len(number) > bands.spare[band]:
        full = np.zeros(k, U64)
        full[number] = code
        number, code = np.arange(k), full
    keys = mix(code ^ mix(number.astype(U64) + U64((band + 1) << 32)))
    return keys & ~U64(1 << 32) | U64((band & 1) << 32)


def block_bytes(shingles: np.ndarray, band: int, bands: Bands) -> bytes:
    """A byte of every block's code: a linked pair differs in at most differ of them."""
    out = np.zeros(int(bands.blocks[band]), np.uint8)
    number, code = _blocks(shingles, len(out))
    out[number] = (code >> U64(56)).astype(np.uint8)
    return out.tobytes()


def shared_more(codes: bytes, band: int, bands: Bands) -> int:
    """Keys beyond two that the set with these block bytes shares in this band with every linked one, at least.

    Of a linked pair spare + 1 blocks are equal, and at most as many of them are empty as this set has
    empty ones. One key is left aside, should two of a set's keys have the same name.
    """
    return max(0, int(bands.spare[band]) - codes.count(0) - 1)


def sketches(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row doc_id, n_shingles, set_a, set_b (128 bits that equal sets share), a short parity sketch, a byte
    per block of the sketches of its own band and of the next, and shared_more of the even and the odd one of the two."""
    bands = Bands(percent, 1)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        codes, more = [[b""] * rows, [b""] * rows], np.zeros((rows, 2), np.int32)
        n, sets, parity = np.zeros(rows, np.int64), np.zeros((rows, 2), U64), np.zeros((rows, len(SKETCH)), np.int64)
        r = 0
        for part in words(batch.column(1), SPACES, FOLD):
            for shingles in shingle_sets(part, size):
                n[r] = len(shingles)
                sets[r] = mix(shingles ^ U64(1)).sum(dtype=U64), mix(shingles ^ U64(2)).sum(dtype=U64)
                bits = np.bincount((shingles & U64(511)).astype(np.int64), minlength=512) & 1
                parity[r] = np.packbits(bits.astype(np.uint8)).view(np.int64)
                if len(shingles):
                    band = bands.reach(len(shingles)).of(len(shingles))
                    for k, b in enumerate((band, band + 1)):
                        codes[k][r] = block_bytes(shingles, b, bands)
                        more[r, b & 1] = shared_more(codes[k][r], b, bands)
                r += 1
        columns = [batch.column(0), pa.array(n), *(pa.array(sets[:, k].view(np.int64)) for k in (0, 1))]
        columns += [pa.array(np.ascontiguousarray(parity[:, k])) for k in range(len(SKETCH))]
        columns += [pa.array(x, pa.binary()) for x in codes] + [pa.array(np.ascontiguousarray(more[:, k])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", *SKETCH, *CODES, *MORE])

    kinds = [f"{s} long" for s in SKETCH] + [f"{c} binary" for c in CODES] + [f"{m} int" for m in MORE]
    schema = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(kinds)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), sketch, schema)


def _runs(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (key, member): keys, members, the first member of each key's run, and whether a row is that first one."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys, members, members[first][np.cumsum(first) - 1] if len(keys) else members, first


def _name(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The number of a key in the whole join. It is odd for odd bands."""
    return bucket.astype(np.int64) << 32 | rest.astype(np.int64)


def _block_rows(bands: Bands, buckets: int, size: int):
    """Batches of (doc_id, text) -> rows of keys for each bucket, and local matches.

    Keys are gathered to segments. A key that repeats inside a segment goes on once, for its
    smallest member; the others are noted as matches of that member at once. So a popular
    block sends one row per segment however many members it has.
    """

    def flush(keys: list[np.ndarray], members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, member = np.concatenate(keys), np.concatenate(members)
        sorted_key, sorted_member, center, first = _runs(key, member)
        again = ~first
        if again.any():
            known = _name(sorted_key[again] % U64(buckets), sorted_key[again] >> U64(32))
            # a group of their own: as large as a segment, whatever the table's size
            own = int((mix(key ^ member.view(U64)).sum(dtype=U64)) >> U64(2))
            yield _batch(np.array([-1 - own]), [known], [sorted_member[again]], [center[again]])
        key, member = sorted_key[first], sorted_member[first]
        bucket = (key % U64(buckets)).astype(np.int64)
        order = np.lexsort((member, bucket))  # members in order pack well
        # within a bucket half of a key tells nearly all apart; the rest is left to the verification
        bucket, key, member = bucket[order], (key >> U64(32)).astype(np.uint32)[order], member[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stops = np.concatenate([at[1:], [len(bucket)]])
        yield _batch(bucket[at], [key[a:b] for a, b in zip(at, stops, strict=True)], [member[a:b] for a, b in zip(at, stops, strict=True)], None)

    def _batch(bucket, keys, members, centers) -> pa.RecordBatch:
        binary = lambda parts: pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())
        empty = pa.nulls(len(bucket), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), binary(keys), binary(members), empty if centers is None else binary(centers)],
            names=["bucket", "keys", "members", "centers"],
        )

    def run(batches):
        keys, members, count, seen = [], [], 0, set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            r = 0
            for part in words(batch.column(1), SPACES, FOLD):
                for shingles in shingle_sets(part, size):
                    doc = ids[r]
                    r += 1
                    if not len(shingles):
                        continue
                    same = (doc, len(shingles), int(mix(shingles).sum(dtype=U64)))
                    if same in seen:  # an equal row of this segment has sent these keys
                        continue
                    seen.add(same)
                    band = bands.of(len(shingles))
                    for b in (band, band + 1):
                        found = block_keys(shingles, b, bands)
                        keys.append(found)
                        members.append(np.full(len(found), doc, np.int64))
                        count += len(found)
                    if count >= SEGMENT_KEYS:
                        yield from flush(keys, members)
                        keys, members, count, seen = [], [], 0, set()
            give_back()
        if keys:
            yield from flush(keys, members)
        del keys, members, seen
        give_back()

    return run


def _match(table: pa.Table) -> pa.Table:
    """The matches of one bucket: key, member, center (the smallest member of the key)."""
    out = []
    sent = []
    for keys, members, centers in zip(*(table[c].to_pylist() for c in ("keys", "members", "centers")), strict=True):
        member = np.frombuffer(members, np.int64)
        if centers is not None:
            out.append((np.frombuffer(keys, np.int64), member, np.frombuffer(centers, np.int64)))
        else:
            sent.append((np.frombuffer(keys, np.uint32), member))
    if sent:
        key, member, center, first = _runs(np.concatenate([k for k, _ in sent]), np.concatenate([m for _, m in sent]))
        out.append((_name(table["bucket"].to_numpy()[:1], key[~first]), member[~first], center[~first]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    del out, sent
    give_back()
    return pa.table({n: pa.array(c) for n, c in zip(("key", "member", "center"), columns, strict=True)})


def block_matches(docs: DataFrame, bands: Bands, keys: int, size: int = WORDS) -> DataFrame:
    """key, member, center for every block content that several sets share: each member with the smallest one it met.

    Members of a key are connected through their centers (the smallest of a segment, then of all).
    """
    spark = docs.sparkSession
    buckets = max(keys // BUCKET_KEYS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.select("doc_id", "text").mapInArrow(_block_rows(bands, buckets, size), "bucket long, keys binary, members binary, centers binary")
    return sent.groupBy("bucket").applyInArrow(_match, "key long, member long, center long")


def _near(percent: int, left: str = "", right: str = "o_") -> Column:
    """Whether the parity sketches and sizes of two sets allow the similarity."""
    a, b = F.col(f"{left}n_shingles"), F.col(f"{right}n_shingles")
    distance = sum((F.bit_count(F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))) for s in SKETCH), F.lit(0))
    limit = (a + b) * (100 - percent)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (distance * (100 + percent) <= limit)


def _slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SLOTS)).alias("slot")


def _in_slots(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs whose key's hash slot is (left_semi) or is not (left_anti) that of a doc_id of ids. At most SLOTS numbers are broadcast."""
    slots = F.broadcast(ids.select(_slot("doc_id")).distinct())
    return docs.select("*", _slot(key)).join(slots, "slot", how).drop("slot")


def _of(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is a doc_id of ids. Few ids are broadcast; else hardly any other docs are shuffled."""
    if few(ids):
        return docs.join(F.broadcast(ids.select(F.col("doc_id").alias(key))), key, "left_semi")
    ids = store(ids.distinct())
    return _in_slots(docs, ids, "left_semi", key).join(ids.select(F.col("doc_id").alias(key)), key, "left_semi")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def _once(pairs: DataFrame, single: bool) -> DataFrame:
    """Each pair once. It is there once if every document has one set (single)."""
    return pairs if single else pairs.distinct()


@temporary
def _verified(docs: DataFrame, pairs: DataFrame, percent: int, size: int, single: bool) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity. Of documents in no pair hardly any is shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s.view(np.int64) for part in words(batch.column(1), SPACES, FOLD) for s in shingle_sets(part, size)]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    rows = _of(_identified(docs), ends)
    held = store(map_batches(rows.select("doc_id", "text"), sets, "id long, shingles array<long>").where(F.size("shingles") > 0))
    first = spread_join(pairs, held.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b")
    # a (the smaller, often a center) may be in very many pairs
    both = spread_join(first, held.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a", counted=pairs.select("a", "b"))
    shared = F.size(F.array_intersect("p", "q"))
    union = F.size("p") + F.size("q") - shared
    return _once(both.where(100 * shared >= percent * union).select("a", "b"), single)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _needed(classed: DataFrame, known: DataFrame) -> DataFrame:
    """key, rep, class without the most popular keys of each rep, as many as it may do without (MORE).

    Keys are ordered by their members here, then by number. Of the c keys that a linked pair shares, the rarest
    comes before c - 1 others in the order of either member, so neither leaves it out. A set that meets others only
    in a few popular keys goes without any.
    """
    popular = store(classed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    # a document of several sets keeps all its keys
    alone = known.groupBy("rep").agg(F.count(F.lit(1)).alias("sets"), *[F.max(m).alias(m) for m in MORE]).where("sets = 1").drop("sets")
    alone = store(alone)
    held = store(spread_join(classed, popular, "key"))
    bounded = spread_join(held, alone, "rep", "left")
    odd = F.col("key").bitwiseAND(F.lit(1))
    free = F.coalesce(F.when(odd == 1, F.col(MORE[1])).otherwise(F.col(MORE[0])), F.lit(0))
    bounded = store(bounded.select("key", "rep", "class", "n", odd.alias("odd"), free.alias("free")))
    place = F.row_number().over(Window.partitionBy("rep", "odd").orderBy(F.desc("n"), F.desc("key")))
    ranked = bounded.where("free > 0").withColumn("place", place).where("place > free")
    columns = ["key", "rep", "class"]
    return bounded.where("free = 0").select(columns).union(ranked.select(columns))


def _apart(classed: DataFrame) -> DataFrame:
    """The members of keys that lie in several classes, of keys with the same members those of one."""
    told = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit("again"))).alias("y")]
    several = classed.groupBy("key").agg(*told, (F.min("class") != F.max("class")).alias("several")).where("several")
    kept = store(several.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return spread_join(classed, kept, "key")


@temporary
def _still_open(some: DataFrame, labels: DataFrame) -> DataFrame:
    """_open once more, after classes were joined."""
    fresh = spread_join(some.drop("class"), labels.select(F.col("node").alias("rep"), F.col("component").alias("class")), "rep", "left")
    return _apart(store(fresh.select("key", "rep", F.coalesce("class", "rep").alias("class"))))


@temporary
def _open(matches: DataFrame, met: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """key, rep, class: the members of keys whose members lie in several classes, as far as _needed.

    met: the pairs of matches that are not known to be linked. Members of a key hang together
    through their centers, so a key whose matches all lie in one class is done. Of keys with
    the same members one is enough.
    """
    of = lambda name, label: labels.select(F.col("node").alias(name), F.col("component").alias(label))
    left = spread_join(met, of("member", "x"), "member", "left")
    # a class is named by its smallest member: a center of that name lies in it
    left = store(left.withColumn("x", F.coalesce("x", "member")).where("x != center"))
    both = spread_join(left, of("center", "y"), "center", "left")
    apart = store(both.where(F.col("x") != F.coalesce("y", "center")).select("member", "center"))
    if not apart.limit(1).count():
        return apart.select(F.col("member").alias("key"), F.col("member").alias("rep"), F.col("member").alias("class"))
    open_keys = store(matches.join(_small(apart), ["member", "center"]).select("key").distinct())
    still = store(spread_join(matches, open_keys, "key"))
    members = still.select("key", F.col("member").alias("rep")).union(still.select("key", F.col("center").alias("rep"))).distinct()
    classed = spread_join(store(members), of("rep", "class"), "rep", "left")
    classed = store(classed.select("key", "rep", F.coalesce("class", "rep").alias("class")))
    return _apart(store(_needed(classed, known)))


@temporary
def _stars(some: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each open key's members with one of them, chosen by a hash, where their classes differ."""
    chosen = F.min_by(F.struct(F.col("rep").alias("center"), F.col("class").alias("at")), F.xxhash64("rep", F.lit(turn)))
    centers = store(some.groupBy("key").agg(chosen.alias("c")).select("key", "c.*"))
    return spread_join(some, centers, "key").where("class != at").select(*_ordered("rep", "center")).distinct()


def long_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch with bits in proportion to the set (a power of two), so that distances stay near the differences.

    Its two halves, XORed, are the sketch of half the size, down to the short one.
    """
    bits = min(4 << max(7, (len(shingles) - 1).bit_length()), MOST_BITS)
    place = (shingles & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


@temporary
def _long_sketches(docs: DataFrame, known: DataFrame, wanted: DataFrame, size: int, single: bool) -> DataFrame:
    """rep, sketch: the long sketches of the documents in wanted above LONG_SET."""
    ids = store(_of(known.where(F.col("n_shingles") > LONG_SET).select("rep"), wanted, "rep").select(F.col("rep").alias("doc_id")))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [long_sketch(s) if len(s) else b"" for part in words(batch.column(1), SPACES, FOLD) for s in shingle_sets(part, size)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "sketch"])

    rows = _of(_identified(docs), ids)
    found = map_batches(rows.select("doc_id", "text"), sketch, "rep long, sketch binary")
    if single:
        return found.where(F.octet_length("sketch") > 0)
    # several texts of one document may differ: it then goes without
    one = found.groupBy("rep").agg(F.count(F.lit(1)).alias("texts"), F.first("sketch").alias("sketch"))
    return one.where("texts = 1").drop("texts")


@temporary
def _further(docs: DataFrame, some: DataFrame, known: DataFrame, percent: int, size: int, every: bool, single: bool) -> DataFrame:
    """Pairs of open members of one key that lie in different classes and that their sketches allow.

    The members are compared tile by tile, so a popular key is spread over many tasks. Of two
    classes that meet in a task the most alike members are paired, or all (every).
    """
    sized = store(some.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    tiled = (
        spread_join(some, sized, "key")
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", "rep", "class", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
    )
    tiled = store(tiled)
    ids = store(some.select(F.col("rep").alias("doc_id")).distinct())
    longer = _long_sketches(docs, known, ids, size, single)
    facts = _of(known.select("rep", "n_shingles", *SKETCH), ids, "rep").join(_small(longer), "rep", "left")
    # the long sketch holds the short one
    facts = store(facts.select("rep", "n_shingles", *[F.when(F.col("sketch").isNull(), F.col(s)).alias(s) for s in SKETCH], "sketch"))
    full = spread_join(tiled, facts, "rep")
    held = spread_join(tiled, facts.select("rep", F.octet_length("sketch").alias("size")), "rep")
    weight = held.agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = max(weight[0] // TASK_ROWS, (weight[1] or 0) // TASK_BYTES) + 1

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, group, tile, n, x, y = (table[c].to_numpy() for c in ("rep", "class", "tile", "n_shingles", "x", "y"))
        far = _LongSketches(table.column("sketch"))
        bits = far.short(np.column_stack([table[s].fill_null(0).to_numpy() for s in SKETCH]).view(U64))
        order = np.lexsort((y, x, table["key"].to_numpy()))
        key = table["key"].to_numpy()[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        bounds = np.flatnonzero(new)
        stop = np.repeat(bounds[1:], np.diff(bounds))  # the end of each row's run
        found, rows, step = [], np.arange(len(order)), 1
        while True:  # rows of one run that are step places apart
            rows = rows[rows + step < stop[rows]]
            if not len(rows):
                break
            i, j = order[rows], order[rows + step]
            open_ = (group[i] != group[j]) & ((x[i] == y[i]) | (tile[i] != tile[j]))
            open_ &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[open_], j[open_]
            limit = (n[i] + n[j]) * (100 - percent)
            distance = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) * (100 + percent)
            near = distance <= limit
            i, j, limit = i[near], j[near], limit[near]
            distance = np.maximum(distance[near], far.distances(i, j) * (100 + percent))
            near = distance <= limit
            i, j = i[near], j[near]
            found.append(np.column_stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), np.minimum(group[i], group[j]), np.maximum(group[i], group[j]), 1_000_000 * distance[near] // np.maximum(limit[near], 1)]))
            step += 1
        pairs = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        if every:
            pairs = np.unique(pairs[:, :2], axis=0)
        else:
            pairs = pairs[np.lexsort(pairs.T[[1, 0, 4, 3, 2]])]
            first = np.ones(len(pairs), bool)
            first[1:] = (pairs[1:, 2] != pairs[:-1, 2]) | (pairs[1:, 3] != pairs[:-1, 3])
            pairs = pairs[first]
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    part = F.pmod(F.xxhash64("key", "x", "y"), F.lit(parts)).alias("part")
    return full.withColumn("part", part).groupBy("part").applyInArrow(compare, "a long, b long").distinct()


class _LongSketches:
    """Distances of the long sketches of a table's rows."""

    def __init__(self, column: pa.ChunkedArray):
        self.data = column.to_pylist()
        self.width = np.array([len(x) if x else 0 for x in self.data], np.int64)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def short(self, other: np.ndarray) -> np.ndarray:
        """The short sketches of the rows: folded long ones, other's where a row has none."""
        out = other.copy()
        for r in np.flatnonzero(self.width).tolist():
            out[r] = np.bitwise_xor.reduce(np.frombuffer(self.data[r], U64).reshape(-1, len(SKETCH)), axis=0)
        return out

    def _lines(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row -> its line or -1, lines) of the sketches of this width and, folded, of twice the width."""
        if width not in self.held:
            line, parts = np.full(len(self.data), -1), []
            for r in np.flatnonzero((self.width == width) | (self.width == 2 * width)).tolist():
                bits = np.frombuffer(self.data[r], np.uint64)
                line[r] = len(parts)
                parts.append(bits if 8 * len(bits) == width else bits[: width // 8] ^ bits[width // 8 :])
            self.held[width] = line, np.array(parts)
        return self.held[width]

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most the numbers of shingles that differ; 0 where a row has no sketch."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.width[i], self.width[j])
        near = (width > 0) & (np.maximum(self.width[i], self.width[j]) <= 2 * width)
        for each in np.unique(width[near]).tolist():
            line, lines = self._lines(each)
            at = np.flatnonzero(near & (width == each))
            for low in range(0, len(at), 1024):
                some = at[low : low + 1024]
                out[some] = np.bitwise_count(lines[line[i[some]]] ^ lines[line[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


@temporary
def jaccard_classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A row's set holds
    its distinct shingles of size words; with fewer words the whole sequence is the only
    shingle; without words the set is empty and links with nothing. Two rows link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable by
    links. Rows that share a doc_id count as one document, so their links are joined; a null
    doc_id takes no part and has a null component_id.

    Steps: equal sets are found by their 128-bit sums. Blocks of the parity sketches are
    joined (see block_keys); every member of a shared block is paired with the smallest one,
    pairs that the sketches allow are verified on the whole sets, and classes are formed.
    Members of blocks that still lie in different classes (without the most popular blocks, as linked sets
    share many: see _needed) are paired with other centers, if
    some block has very many and as long as that joins many. What is then left open is compared pair by pair in the workers, by
    sketches whose bits follow the size of the sets: first the most alike members of any two
    classes are verified, then all pairs of classes that stayed apart, so no link is missed.
    Blocks inside one class, such as those of thousands of near copies, need no more.
    """
    rows = store(sketches(docs, size, percent))
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    totals = rows.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    bands = Bands(percent, int(totals[0] or 0))
    of_set = ["set_a", "set_b", "n_shingles"]
    sets = store(real.groupBy(*of_set).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(s).alias(s) for s in SKETCH + CODES + MORE]))
    known = sets.select("rep", "n_shingles", *SKETCH, *CODES, *MORE)
    # copies of a set, each with the smallest document of the set; the sums and the size are compared after the join on their hash
    several = sets.where("copies > 1").select(F.xxhash64(*of_set).alias("set"), *[F.col(c).alias(f"r_{c}") for c in of_set], "rep")
    found = spread_join(real.select("doc_id", *of_set, F.xxhash64(*of_set).alias("set")), several, "set")
    equal = [F.col(c) == F.col(f"r_{c}") for c in of_set]
    owner = store(found.where(equal[0] & equal[1] & equal[2] & (F.col("doc_id") != F.col("rep"))).select("doc_id", "rep").distinct())
    # rows of one doc_id with different sets hang together
    repeated = store(real.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    single = not repeated.count()
    joint = owner.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    extra = store(owner.join(repeated, "doc_id", "left_anti").select("doc_id").distinct())

    # one document of each set goes on
    texts = _identified(docs)
    chosen = _in_slots(texts, extra, "left_anti").union(_in_slots(texts, extra, "left_semi").join(extra, "doc_id", "left_anti"))
    matches = store(block_matches(chosen, bands, int(totals[1] or 0), size))
    met = store(matches.select("member", "center").distinct())
    pairs = store(met.select(*_ordered("member", "center")).where("a != b"))  # a center is the smaller one
    edges = store(_verified(docs, _allowed(pairs, known, percent, single), percent, size, single).union(joint))
    labels = components(edges)
    # other centers for very popular keys, while they still join many classes; then the most alike of any two classes, then all that is left
    unlinked = met.select("*", *_ordered("member", "center")).join(_small(edges.select("a", "b")), ["a", "b"], "left_anti")
    unlinked = store(unlinked.select("member", "center"))
    some = _open(matches, unlinked, labels, known)
    discard(matches, met)
    largest = some.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    turn = 1 if largest > TILE else TURNS + 1
    while turn <= TURNS + 2 and largest:
        tried = _stars(some, turn) if turn <= TURNS else _further(docs, some, known, percent, size, turn > TURNS + 1, single)
        tried = store(tried.join(_small(pairs), ["a", "b"], "left_anti"))
        links = _verified(docs, _allowed(tried, known, percent, single), percent, size, single)
        found = links.count()
        few = turn <= TURNS and found * 50 < some.select("rep").distinct().count()
        if turn <= TURNS + 1:
            pairs = store(pairs.union(tried))
        if found:
            edges = store(edges.union(links))
            labels = components(edges)
            if turn <= TURNS + 1:
                some = _still_open(before := some, labels)
                discard(before)
                largest = some.limit(1).count()
        turn = TURNS + 1 if few else turn + 1

    # a document's class is that of its set's smallest document, or its own
    nodes = rows.select("doc_id").where(F.col("doc_id").isNotNull()).join(_small(owner), "doc_id", "left")
    nodes = store(nodes.select("doc_id", F.coalesce("rep", "doc_id").alias("node")).distinct())
    classed = spread_join(nodes, labels, "node", "left")
    label = store(classed.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id")))
    return rows.select("doc_id", "n_shingles").join(label, "doc_id", "left")


@temporary
def _allowed(pairs: DataFrame, known: DataFrame, percent: int, single: bool) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity, first the short ones, then block by block.

    Two sets in one band compare their bytes of that band, in neighbouring bands the smaller
    set's of the following one. Blocks that differ are at most as many as differing shingles.
    """
    wide = ["n_shingles", *SKETCH]
    ends = lambda some: some.select(F.explode(F.array("a", "b")).alias("doc_id"))
    met = store(_of(known.select("rep", *wide), ends(pairs), "rep"))
    all_few = few(met)
    left = spread_join(pairs, met.select(F.col("rep").alias("a"), *wide), "a")
    right = spread_join(left if all_few else store(left), met.select(F.col("rep").alias("b"), *[F.col(c).alias(f"o_{c}") for c in wide]), "b")
    near = store(_once(right.where(_near(percent)).select("a", "b"), single))
    bands = Bands(percent, 1)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        columns = [batch.column(i) for i in range(2, 8)]
        for r, (n, own, following, m, other, beyond) in enumerate(zip(*columns, strict=True)):
            n, m = n.as_py(), m.as_py()
            bands.reach(max(n, m))
            x, y = bands.of(n), bands.of(m)
            if abs(x - y) <= 1:
                p, q = (own if x >= y else following), (other if y >= x else beyond)
                p, q = np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8)
                keep[r] = np.count_nonzero(p != q) * (100 + percent) <= (n + m) * (100 - percent)
        chosen = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"])

    parts = ["n_shingles", *CODES]
    met = store(_of(known.select("rep", *parts), ends(near), "rep"))
    first = spread_join(near, met.select(F.col("rep").alias("a"), *parts), "a")
    both = spread_join(first, met.select(F.col("rep").alias("b"), *[F.col(c).alias(f"o_{c}") for c in parts]), "b", counted=near)
    return _once(map_batches(both.select("a", "b", *parts, *[f"o_{c}" for c in parts]), compare, "a long, b long"), single)


def first_of_class(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each class of rows that with the smallest doc_id.

    The rule holds row by row: a row goes only if its own text is equal to, or linked with (also through
    others), that of a row that stays, whatever other rows have its doc_id. Of rows in one class with the
    same doc_id one stays. Rows with a null doc_id and rows without words all stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        classes = jaccard_classes(docs.select("doc_id", "text"), size, percent)
        extra = store(classes.where("doc_id != component_id").select(F.col("doc_id").alias("_extra")))
        return docs.join(extra, docs["doc_id"] == extra["_extra"], "left_anti")
    # ids repeat: the rows get numbers, so that each is a document of its own
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = store(docs.withColumn(number, F.monotonically_increasing_id()))
    known = rows.where(F.col("doc_id").isNotNull())
    classes = store(jaccard_classes(known.select(F.col(number).alias("doc_id"), "text"), size, percent))
    own = classes.join(known.select(F.col("doc_id").alias("id"), F.col(number).alias("doc_id")), "doc_id")
    first = store(own.groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("_kept")))
    kept = known.join(first, known[number] == first["_kept"], "left_semi")
    return kept.unionByName(rows.where(F.col("doc_id").isNull())).drop(number)
