"""Written intermediate tables, skew-safe joins and maps over text columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: A join key with more than 1 / HOT_SHARE of the rows is split; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 256
#: A hot key is cut into pieces of about 1 / PIECES of all rows.
PIECES = 4096
#: Bytes of a table that a join broadcasts at most, and rows whose keys one task counts. Executors keep broadcasts of
#: ended queries until the driver collects its garbage.
FEW_BYTES = 1 << 20
FEW_ROWS = 1 << 16
#: Rows of a text column that are worked on together.
LOT_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a local session that names none."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders written by the functions under way that are marked temporary, innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("_written", default=())
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files once they end; else these stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def store(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and go on from there: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if scopes := _written.get():
        scopes[-1].append(path)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    context = spark.sparkContext
    for name in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def temporary(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn, whose first argument is a table, with its result stored; all other tables that it stores are deleted when it
    returns, and the shuffle files of its queries when these end. No table of theirs may leave it otherwise."""

    @functools.wraps(fn)
    def run(*args, **named) -> DataFrame:
        outer, own = _written.get(), []
        token = _written.set((*outer, own))
        try:
            with freed_shuffles(args[0].sparkSession):
                made = fn(*args, **named)
        finally:
            _written.reset(token)
        out = store(made)  # belongs to the caller
        _delete(out.sparkSession, own)
        return out

    return run


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on and would keep its largest batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """Run fn over Arrow batches; it returns one batch or yields some."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
            del batch, out
            give_back()

    return df.mapInArrow(run, schema)


def lots(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of at most LOT_ROWS rows and, unless a row alone has more, size bytes."""
    ends = None if size is None else np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(column):
        high = min(low + LOT_ROWS, len(column))
        if ends is not None:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, min(high, int(np.searchsorted(ends, before + size, "right"))))
        yield low, high
        low = high


def appended(
    df: DataFrame, text: str, fn: Callable[[pa.Array], dict[str, pa.Array]], schema: str, carry: list[str] | None = None, size: int | None = None
) -> DataFrame:
    """df's columns named in carry (None: all) with those of schema, computed from a text column batch by batch.

    A column of df with the name of a new one is replaced. Columns that are not carried do
    not travel back from the Python workers. size: bytes of text that are worked on together.
    """
    added = StructType.fromDDL(schema).names
    kept = [f for f in df.schema.fields if f.name not in added and (carry is None or f.name in carry)]
    frame = df.select(F.col(f"`{text}`"), *[F.col(f"`{f.name}`") for f in kept if f.name != text])
    whole = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])
    # the text comes first; each carried column's place in the batch
    rest = [f.name for f in kept if f.name != text]
    places = [0 if f.name == text else 1 + rest.index(f.name) for f in kept]
    names = [f.name for f in kept] + added

    def add(batch: pa.RecordBatch):
        for low, high in lots(batch.column(0), size):  # the arrays of a whole batch would be many times its size
            lot = batch.slice(low, high - low)
            found = fn(lot.column(0))
            yield pa.RecordBatch.from_arrays([lot.column(i) for i in places] + [found[name] for name in added], names=names)

    return map_batches(frame, add, whole)


def few(df: DataFrame) -> bool:
    """Whether df has at most FEW_BYTES, of numbers, binaries and lists of numbers. Rows of numbers in a stored table are counted from its footers."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fixed, sized = {"bigint", "int", "boolean"}, {"binary": F.octet_length, "array<bigint>": lambda c: 8 * F.size(c)}
    if not set(kinds.values()) <= fixed | set(sized):
        return False
    with freed_shuffles(df.sparkSession):
        if set(kinds.values()) <= fixed:
            return 8 * len(kinds) * df.count() <= FEW_BYTES
        lengths = [F.coalesce(sized[kind](F.col(f"`{c}`")).cast("long"), F.lit(0)) if kind in sized else F.lit(8) for c, kind in kinds.items()]
        return (df.agg(F.sum(sum(lengths, F.lit(0)))).first()[0] or 0) <= FEW_BYTES


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left JOIN right on key, where one key may hold most of left; right has few rows per key.

    A right of few bytes is broadcast. Else keys above 1 / HOT_SHARE of left's rows (fewer than HOT_SHARE keys, so their list
    is broadcast) are cut into as many pieces as their rows need, and right's rows for
    them are repeated once per piece. Both are read twice: store them first if they are costly, or
    give a narrow table with left's keys in counted, whose columns then deal the pieces.
    """
    if few(right):
        return left.join(F.broadcast(right), key, how)
    counted = left if counted is None else counted
    spark = left.sparkSession
    total = counted.count()
    piece = total // PIECES + 1
    keys = counted.select(key).where(F.col(key).isNotNull())
    hot = (
        (keys.coalesce(1) if total <= FEW_ROWS else keys)  # one partition needs no shuffle
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > total // HOT_SHARE + 1)
        .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / piece).cast("int").alias("_pieces"))
    )
    with freed_shuffles(spark):
        hot = spark.createDataFrame(hot.collect(), hot.schema)  # fewer than HOT_SHARE rows
    pieces = F.coalesce("_pieces", F.lit(1))
    marked = F.broadcast(hot)
    salted = (
        left.join(marked, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in counted.columns]), pieces).cast("int"))
        .drop("_hot", "_pieces")
    )
    copies = (
        right.join(marked, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_hot", "_pieces")
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most rows rows, those with the smallest hash of key; the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit("sample")), F.col(key)).limit(rows)
