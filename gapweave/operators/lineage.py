"""Cutting long lineages through the shared checkpoint folder."""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    Spark copies a plain projected column into every later filter and expression
    that uses it; it never does that with the output of a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, for tables that several executors read.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    without one gets a temporary folder; on a cluster that would not survive the
    loss of an executor, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
