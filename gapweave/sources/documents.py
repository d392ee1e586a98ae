"""Raw job descriptions and résumés as tables of decoded text."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.functions.text import blank_to_null


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of the files under a folder; their bytes are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def read_texts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One row per text file: (doc_id, kind, text)."""
    texts = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("doc_id"), F.lit(kind).alias("kind"), F.col("value").alias("text"))


def ingest(texts: DataFrame, doc_id: Column, kind: Column, text: Column) -> DataFrame:
    """(doc_id, kind, text, n_chars) of any text table; blank text counts as missing."""
    given = blank_to_null(text)
    return texts.select(
        doc_id.alias("doc_id"), kind.alias("kind"), given.alias("text"), F.length(given).alias("n_chars")
    )


def write_texts(docs: DataFrame, path: str) -> str:
    """Store documents under one folder per kind; returns where they are."""
    docs.write.mode("append").partitionBy("kind").parquet(path)
    return path
