"""Building the searchable catalogue."""

from pyspark.sql import DataFrame

from gapweave.operators.keyed import upsert_rows
from gapweave.sources.vectors import HASH_MODEL, cached_vectors, hash_encoder


def embed_and_store(
    catalog: DataFrame,
    table: DataFrame,
    cache_path: str,
    columns=("name", "description"),
    encoder=hash_encoder,
    model: str = HASH_MODEL,
) -> DataFrame:
    """``table`` with ``vector`` and ``embedding_keys`` set for all of ``catalog``.

    Rows the cache already holds are not encoded again. Write the result with
    ``operators.keyed.swap_in``.
    """
    vectors = cached_vectors(catalog, cache_path, columns, encoder, model)
    return upsert_rows(table, vectors)
