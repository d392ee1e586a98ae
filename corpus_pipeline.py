"""From raw documents to packed token sequences: each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm import decontaminate, jaccard_join, packing, quality, rules
from gapweave.llm.queries import good_ids, table
from gapweave.llm.tables import store

ORACLE_SQL = None


def _passing(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], flag: str) -> DataFrame:
    """The rows of docs that operator flags; other columns of docs pass under numbers, as one may be called like one that operator adds."""
    names = {c: c if c in ("doc_id", "text") else f"_column{k}" for k, c in enumerate(docs.columns)}
    found = operator(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()])).where(flag)
    return found.select(*[F.col(name).alias(c) for c, name in names.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling towards good documents selects."""
    return _passing(docs, lambda d: quality.resample(d, good_ids(spark, sf_dir)), "selected")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return _passing(docs, rules.cascade, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return jaccard_join.first_of_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
