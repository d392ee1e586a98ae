"""Delimited files with line breaks inside quoted cells, read by many tasks a file.

A file's splits end at line breaks, so at the end of each one a reader is either between two
records or inside a quoted cell. Every split is a map from the state before it to the state
after it; a prefix scan over the maps tells the true state before each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gapweave.operators.lineage import checkpointed

FILE, BLOCK = "file", "block"
#: Splits up to so many (a row of a path and some numbers each) are broadcast, more are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end inside a quoted cell, when they begin between records or inside such a cell."""
    other = f"[^{re.escape(sep)}]"
    # a quote counts only where a cell begins; what follows a closed cell belongs to it up to the separator
    inside, closed = r'(?:[^"]|"")*+', rf'"{other}*+'
    cells = rf'(?>{re.escape(sep)}(?:"{inside}{closed}|(?!"){other}*+))*+'
    opened = rf'{re.escape(sep)}"{inside}'
    fresh = rf'(?:"{inside}{closed}|(?!"){other}*+){cells}{opened}|"{inside}'
    within = rf"{inside}{closed}{cells}{opened}|{inside}"
    return re.compile(fresh, re.DOTALL), re.compile(within, re.DOTALL)


class _Chunk:
    """What a split holds if it begins between records (0) or inside a quoted cell (1)."""

    def __init__(self, file: str, block: int):
        self.at = file, block
        self.state = [0, 1]
        self.held: list[list[str]] = [[], []]
        self.started = [False, False]
        self.count = [0, 0]

    def lines(self, lines: list[str], patterns, rows: list | None) -> None:
        for line in lines:
            quoted = '"' in line
            for h in (0, 1):
                if self.state[h] == 0:
                    self._close(h, rows)
                    self.started[h] = True
                if rows is not None:
                    self.held[h].append(line)
                if quoted:
                    self.state[h] = int(patterns[self.state[h]].fullmatch(line) is not None)

    def _close(self, h: int, rows: list | None, role: str = "whole") -> None:
        if rows is None:
            return
        if self.held[h]:
            role = role if self.started[h] else "head"
            rows.append((*self.at, h, role, self.count[h], "\n".join(self.held[h])))
            self.count[h] += 1
            self.held[h] = []

    def end(self, rows: list | None) -> None:
        for h in (0, 1):
            self._close(h, rows, "tail" if self.state[h] else "whole")


def _chunks(batches, patterns, emit: bool) -> Iterator[tuple[_Chunk | None, list]]:
    """(ended split or None, rows) over the lines of a task, which come in file order."""
    chunk = None
    for batch in batches:
        rows = [] if emit else None
        lines, files, blocks = (batch.column(k).to_pylist() for k in range(3))
        low = 0
        while low < len(lines):
            high = low
            at = files[low], blocks[low]
            while high < len(lines) and blocks[high] == at[1] and files[high] == at[0]:
                high += 1
            if chunk is None or chunk.at != at:
                if chunk is not None:
                    chunk.end(rows)
                    yield chunk, []
                chunk = _Chunk(*at)
            chunk.lines(lines[low:high], patterns, rows)
            low = high
        yield None, rows or []
    if chunk is not None:
        rows = [] if emit else None
        chunk.end(rows)
        yield chunk, rows or []


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``file``, ``first`` (whether it is the file's first record) and ``record`` of the records of the files at ``path``.

    Lines end with ``\\n`` or ``\\r\\n``. A quote opens a cell only where the cell begins, two quotes
    inside such a cell are one. Empty lines between records are dropped, but an empty first line
    counts as nothing. A file that ends inside a quoted cell ends with that record.
    """
    # splits of one file are told apart by where they begin; a task reads each one in order
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    patterns = _patterns(sep)
    maps_schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("f0", pa.int32()), ("f1", pa.int32()), ("begun", pa.bool_())])
    rows_schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("h", pa.int32()), ("role", pa.string()), ("place", pa.int64()), ("record", pa.string())])

    def maps(batches):
        for chunk, _ in _chunks(batches, patterns, False):
            if chunk is not None:
                yield _table([(*chunk.at, *chunk.state, chunk.started[1])], maps_schema)

    def cut(batches):
        for _, rows in _chunks(batches, patterns, True):
            if rows:
                yield _table(rows, rows_schema)

    chunk = lines.mapInArrow(maps, "file string, block long, f0 int, f1 int, begun boolean")
    upto = Window.partitionBy(FILE).orderBy(BLOCK)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")
    # the last split that forgets the state before it, then a change for each split that swaps the two states
    chunk = chunk.withColumn("swaps", F.sum(swap).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.when(F.col("f0") == F.col("f1"), F.col("f0") + F.col("swaps"))
    state = F.coalesce(F.last(base, ignorenulls=True).over(before), F.lit(0)) + F.col("swaps") - swap
    chunk = chunk.withColumn("h", F.pmod(state, F.lit(2)).cast("int"))
    tail = F.when(F.col("h") == 0, F.col("f0") == 1).otherwise((F.col("f1") == 1) & F.col("begun"))
    chunk = chunk.withColumn("owner", F.last(F.when(tail, F.col(BLOCK)), ignorenulls=True).over(before))
    found = lines.mapInArrow(cut, "file string, block long, h int, role string, place long, record string")
    starts = checkpointed(chunk.select(FILE, BLOCK, "h", "owner"))
    few = starts.count() <= BROADCAST_SPLITS
    found = found.join(F.broadcast(starts) if few else starts, [FILE, BLOCK, "h"])
    first = (F.col(BLOCK) == 0) & (F.col("place") == 0)
    whole = found.where("role = 'whole'").select(FILE, first.alias("first"), "record")
    parts = found.where("role != 'whole'").select(
        FILE,
        F.when(F.col("role") == "head", F.col("owner")).otherwise(F.col(BLOCK)).alias("begin"),
        F.struct(BLOCK, "record", first.alias("first")).alias("part"),
    )
    joined = parts.groupBy(FILE, "begin").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = joined.select(FILE, F.exists("parts", lambda p: p["first"]).alias("first"), F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", "")).where("record != ''")


def read_wide_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns of the files at ``path`` as text, found by the header that every file begins with.

    Equal to Spark's ``multiLine`` reader, but a file is read by as many tasks as it has splits.
    Files whose headers differ are an error.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
    header = spark.read.options(multiLine=True, **options).csv(path).first()
    schema = ", ".join(f"_c{k} string" for k in range(len(names)))
    cells = F.from_csv("record", schema, options)
    found = records(spark, path, sep).select("file", "first", cells.alias("cells"))
    values = F.array(*[F.col(f"cells._c{k}") for k in range(len(names))])
    same = values.eqNullSafe(F.array(*[F.lit(n).cast("string") for n in header]))
    wrong = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    kept = found.where(F.when(~F.col("first"), True).when(same, False).otherwise(wrong))
    return kept.select(*[F.col(f"cells._c{k}").alias(n) for k, n in enumerate(names)])
