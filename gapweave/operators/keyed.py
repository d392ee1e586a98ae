"""Keyed-table changes as batch operators: each returns a new DataFrame.

Every change set is first reduced to one row per key with a partial aggregate, so
a key that comes a billion times reaches the join as one row. Joins carry no
broadcast hint: Spark broadcasts a change set when its measured size allows it.
"""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gapweave.functions.text import epoch_text, moment_text
from gapweave.operators.lineage import checkpointed
from gapweave.operators.ranking import first_per_group

KEY = "_id"
# Letters of a generated id, and its usual length.
ID_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
ID_LENGTH = 10


def get_rows(table: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is in ``ids`` (one column, repeats allowed)."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def get_row(table: DataFrame, value, key: str = KEY) -> DataFrame:
    return table.where(F.col(key) == F.lit(value)).limit(1)


def find_rows(table: DataFrame, field: str, value) -> DataFrame:
    """Rows where ``field`` equals ``value``; an array field matches by member."""
    if table.schema[field].dataType.typeName() == "array":
        return table.where(F.array_contains(field, F.lit(value)))
    return table.where(F.col(field) == F.lit(value))


def rows_to_insert(old: DataFrame, new: DataFrame, position: str, run_at: Column, key: str = KEY) -> DataFrame:
    """New rows whose key is not in ``old``, stamped with the time of the run.

    The first row by ``position`` wins when a key comes twice. ``run_at`` is one
    timestamp for the whole run, so a retried task writes the same stamps.
    """
    once = first_per_group(new, [key], position).drop(position)
    return (
        once.join(old.select(key), key, "left_anti")
        .withColumn("timestamp", epoch_text(run_at))
        .withColumn("datetime", moment_text(run_at))
    )


def insert_absent(old: DataFrame, new: DataFrame, position: str, run_at: Column, key: str = KEY) -> DataFrame:
    """``old`` unchanged, plus the rows that were absent."""
    return old.unionByName(rows_to_insert(old, new, position, run_at, key), allowMissingColumns=True)


def generated_id(stable_key: Column, run_id: str, length: int = ID_LENGTH) -> Column:
    """Id of ``length`` letters and digits, the same on every retry of a run.

    Ten letters hold 52 bits: at a billion rows ask for 16.
    """
    if not 1 <= length <= 16:
        raise ValueError("an id has 1 to 16 letters")
    digest = F.sha2(F.concat_ws("/", F.lit(run_id), stable_key.cast("string")), 256)
    letters = []
    for i in range(length):
        number = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int")
        letters.append(F.substring(F.lit(ID_LETTERS), (number % len(ID_LETTERS)) + 1, F.lit(1)))
    return F.concat(*letters)


def insert_generated(new: DataFrame, stable_key: str, run_id: str, length: int = ID_LENGTH) -> DataFrame:
    """Every row with a generated key; a key the row brings along is replaced."""
    return new.withColumn(KEY, generated_id(F.col(stable_key), run_id, length))


def id_collisions(table: DataFrame, key: str = KEY) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return table.groupBy(key).count().where(F.col("count") > 1)


def _merged(changes: DataFrame, key: str, position: str | None, carried: str | None) -> tuple[DataFrame, list[str]]:
    """One row per key: for each field ``_new_field``, a struct of the last value given, or null if none was."""
    fields = [c for c in changes.columns if c not in (key, position, carried)]

    def given(name):
        return F.col(name).isNotNull() if carried is None else F.array_contains(carried, name)

    value = {c: F.struct(F.col(c).alias("v")) for c in fields}
    # without an order, that of a hash of the whole change: some change sets the field, the same on every run
    order = F.col(position) if position is not None else F.xxhash64(*[F.col(c) for c in changes.columns])
    last = [F.max_by(value[c], F.when(given(c), order)).alias(f"_new_{c}") for c in fields]
    merged = changes.groupBy(key).agg(F.lit(True).alias("_one"), *last).drop("_one")
    return merged.withColumn("_hit", F.lit(True)), fields


def update_rows(
    old: DataFrame,
    changes: DataFrame,
    position: str | None = None,
    run_at: Column | None = None,
    key: str = KEY,
    carried: str | None = None,
) -> DataFrame:
    """Set the fields that ``changes`` give on the rows that have their key.

    Several changes of a key (in the order of ``position``) are merged field by field:
    the last one that gives a field sets it. Without ``position`` the order is that of a
    hash of the change, so a repeated key never multiplies rows. A field is given when it is not null, or,
    if ``carried`` names an array column, when that holds the field's name, so that a
    null can be set. Adds ``changed``: the row had a change set that altered at least
    one field. With ``run_at``, rows that were matched also get ``last_modified``.
    """
    marked, fields = _merged(changes, key, position, carried)
    joined = old.join(marked, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))

    changed, out = F.lit(False), []
    for name in old.columns:
        if name in fields:
            new = F.col(f"_new_{name}")
            value = F.when(new.isNotNull(), new["v"]).otherwise(F.col(name))
            changed = changed | ~value.eqNullSafe(F.col(name))
            out.append(value.alias(name))
        elif name != "last_modified":
            out.append(F.col(name))
    for name in fields:
        if name not in old.columns:
            changed = changed | F.col(f"_new_{name}.v").isNotNull()
            out.append(F.col(f"_new_{name}.v").alias(name))
    if run_at is not None:
        before = F.col("last_modified") if "last_modified" in old.columns else F.lit(None).cast("string")
        out.append(F.when(hit, epoch_text(run_at)).otherwise(before).alias("last_modified"))
    elif "last_modified" in old.columns:
        out.append(F.col("last_modified"))
    return joined.select(*out, (hit & changed).alias("changed"))


def not_found(old: DataFrame, changes: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of a change set that the table does not hold."""
    return changes.select(key).distinct().join(old.select(key), key, "left_anti")


def upsert_rows(old: DataFrame, new: DataFrame, position: str | None = None, key: str = KEY, carried: str | None = None) -> DataFrame:
    """Set the fields ``new`` gives (as in ``update_rows``), keep all others, create absent rows."""
    marked, fields = _merged(new, key, position, carried)
    joined = old.join(marked, key, "full")
    out = [F.col(key)]
    for name in [c for c in old.columns if c != key] + [c for c in fields if c not in old.columns]:
        if name not in fields:
            out.append(F.col(name))
        elif name in old.columns:
            given = F.col(f"_new_{name}")
            out.append(F.when(given.isNotNull(), given["v"]).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(f"_new_{name}.v").alias(name))
    return joined.select(*out)


def insert_run(old: DataFrame, new: DataFrame, position: str, run_at: Column, path: str, run_id: str, key: str = KEY) -> int:
    """Put the table with the absent rows in the place of ``path``; return the number of rows inserted."""
    rows = rows_to_insert(old, new, position, run_at, key)
    seen = Observation("inserted")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    swap_in(old.unionByName(counted, allowMissingColumns=True), path, run_id)
    return seen.get["rows"]


def insert_generated_run(old: DataFrame, new: DataFrame, stable_key: str, run_id: str, path: str, length: int = ID_LENGTH) -> int:
    """Append rows with generated keys to the table and put it in the place of ``path``; return their number.

    A key that the table or another new row holds is an error, and nothing is replaced: ask for a longer id.
    """
    rows = checkpointed(insert_generated(new, stable_key, run_id, length))
    twice = rows.select(KEY).unionByName(old.select(KEY).join(rows.select(KEY), KEY, "left_semi"))
    first = id_collisions(twice).orderBy(KEY).first()
    if first is not None:
        raise ValueError(f"generated id {first[KEY]!r} is held by {first['count']} rows")
    swap_in(old.unionByName(rows, allowMissingColumns=True), path, run_id)
    return rows.count()


def delete_rows(old: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """The table without the given keys."""
    return old.join(ids.select(key).distinct(), key, "left_anti")


def deleted_ids(old: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """The given keys that the table did hold."""
    return get_rows(old, ids, key).select(key)


def swap_in(df: DataFrame, path: str, run_id: str) -> int:
    """Write ``df`` beside ``path`` and put it in its place; return the row count.

    The input may be read from ``path``: it is only moved aside after the write
    is complete, to ``path``.old-``run_id``.
    """
    spark = df.sparkSession
    staged = f"{path}.new-{run_id}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, fresh, aside = hadoop(path), hadoop(staged), hadoop(f"{path}.old-{run_id}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(aside):
        raise ValueError(f"run {run_id} has already replaced {path}")

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(staged)
    if files.exists(target) and not files.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(fresh, target):
        raise OSError(f"cannot move {staged} to {path}")
    return seen.get["rows"]
