"""Encoding texts and keeping their vectors in a keyed cache."""

import re
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from gapweave.functions.text import encode_text

HASH_MODEL = "hashed-words-384"
HASH_SIZE = 384
#: Bits of the filter over cached keys: 1,048,576 words of 64, broadcast. More keys than bits only make it let more through.
FILTER_BITS = 1 << 26


def hash_encoder(texts: DataFrame, size: int = HASH_SIZE) -> DataFrame:
    """Offline default: unit vectors of hashed word counts, without model weights."""
    steps = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"(?U)\W+", toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size),
            Normalizer(inputCol="_counts", outputCol="_unit", p=2.0),
        ]
    )
    # None of the three learns from data, so this fit runs no job.
    out = steps.fit(texts).transform(texts)
    return out.withColumn("vector", vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def model_encoder(make_predict, batch_size: int = 64):
    """Encoder around a user's model: ``make_predict()`` loads it once per worker
    and returns a function from an array of texts to a matrix."""
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda texts: texts.withColumn("vector", encode("text"))


def encode_distinct(texts: DataFrame, encoder=hash_encoder) -> DataFrame:
    """Encode each distinct text once and give every row its vector.

    For costly models over tables with many copies of a text, such as skills asked
    for by many jobs. Copies meet by the hash of their text: one text per hash and
    task goes through the shuffle, and the join back moves no texts. Spark splits
    the join of a very frequent text (adaptive skew join).
    """
    hashed = texts.withColumn("_hash", F.sha2("text", 256))
    once = hashed.groupBy("_hash").agg(F.any_value("text").alias("text"))
    vectors = encoder(once).select("_hash", "vector")
    return hashed.drop("text").join(vectors, "_hash").drop("_hash")


def columns_hash(columns) -> str:
    import hashlib

    return hashlib.sha256("\t".join(columns).encode()).hexdigest()[:16]


def _files(spark: SparkSession, path: str):
    """The file system that holds ``path``, and ``path`` in its own type."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def cache_folder(path: str, columns, model: str) -> str:
    """The cache's folder for one model and choice of columns: others are never listed or read."""
    return f"{path}/model={re.sub('[^A-Za-z0-9.]+', '-', model)}-{columns_hash([model])}/columns={columns_hash(columns)}"


def committed_runs(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the runs that were written whole; a run that failed left no mark and is not read."""
    files, marks = _files(spark, f"{folder}/_committed")
    return sorted(f"{folder}/run={f.getPath().getName()}" for f in files.listStatus(marks)) if files.exists(marks) else []


def _runs_read(spark: SparkSession, folder: str, runs: list[str]) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(*runs)


def _bit(*names: str):
    """(word, mask) of a key's place in the filter."""
    place = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def bloom_words(held: DataFrame, *names: str) -> DataFrame:
    """``word``, ``bits``: the filter over the keys of ``held``, at most FILTER_BITS / 64 rows."""
    word, mask = _bit(*names)
    return held.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def missing_rows(wanted: DataFrame, held: DataFrame, *names: str) -> DataFrame:
    """Rows of ``wanted`` whose key ``held`` lacks.

    Rows that the filter rules out go on where they are, with their texts. Only the keys of
    the others are joined, and the texts of those it let through wrongly are fetched.
    """
    word, mask = _bit(*names)
    tested = wanted.withColumn("_word", word).withColumn("_mask", mask)
    tested = tested.join(F.broadcast(bloom_words(held, *names)), F.col("_word") == F.col("word"), "left")
    unseen = F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")), F.lit(0)) == 0
    surely = tested.where(unseen).select(*wanted.columns)
    perhaps = tested.where(~unseen).select(*wanted.columns)
    late = perhaps.select(*names).join(held.select(*names), list(names), "left_anti").distinct()
    return surely.unionByName(perhaps.join(late, list(names), "left_semi"))


def cached_vectors(
    catalog: DataFrame, path: str, columns=("name", "description"), encoder=hash_encoder, model: str = HASH_MODEL
) -> DataFrame:
    """Vectors of the catalogue, encoding only rows the cache does not hold.

    A cached row counts when id, model, column choice and text all match, so rows
    whose text or columns changed are encoded again. The Parquet cache at ``path`` has a
    folder for each model and choice of columns, and in it one for each run that added
    rows. A run is marked when it has been written whole and is read from then on. Runs
    that added a key at the same time hold the same vector for it; the run with the
    smallest name gives it. Rows with a null id have no vector.
    """
    spark = catalog.sparkSession
    folder, key = cache_folder(path, columns, model), ["_id", "text_hash"]
    text = encode_text(*[F.col(c) for c in columns])
    wanted = catalog.where(F.col("_id").isNotNull()).select("_id", F.sha2(text, 256).alias("text_hash"), text.alias("text"))
    runs = committed_runs(spark, folder)
    missing = missing_rows(wanted, _runs_read(spark, folder, runs), *key) if runs else wanted
    run, added = uuid.uuid4().hex, Observation()
    new = encoder(missing.dropDuplicates(key)).select(*key, "vector")
    new.observe(added, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/run={run}")
    # without earlier runs an empty one is kept too, so that there is a table to read
    if added.get["rows"] or not runs:
        files, mark = _files(spark, f"{folder}/_committed/{run}")
        files.createNewFile(mark)
    cache = _runs_read(spark, folder, committed_runs(spark, folder))
    # which run gives a key is found on the keys; vectors are only joined
    held = cache.select(*key, "run").groupBy(*key).agg(F.min("run").alias("run"))
    given = wanted.select(*key).join(held, key)
    names = F.array(*[F.lit(c) for c in columns])
    return cache.join(given, [*key, "run"]).select("_id", "vector", names.alias("embedding_keys"))
