"""Token counts by a two-tier lookup of white-space pieces, without a shuffle of pieces."""

from __future__ import annotations

import functools
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.arrays import column_bytes
from gapweave.llm.tables import appended, lots

#: Rows of the sample that the table of frequent pieces is counted on, and its size.
SAMPLE_ROWS = 4_000
FREQUENT = 1 << 16
#: Pieces a worker remembers besides; when full it starts anew. Longer pieces are not remembered.
CACHE = 1 << 17
LONGEST = 48
#: Bytes of text whose pieces are looked up together (or one longer text), and pieces encoded together.
LOT_BYTES = 1 << 18
LOT = 512

_tokenizers: dict = {}
_tables: dict = {}
_cache: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def folding(path: str) -> tuple[bool, list[bytes]]:
    """Whether the tokenizer lower-cases texts, and its added tokens in lower case: pieces with one keep their case.

    Added tokens are matched before case is folded, so folding first could make one.
    """
    known = json.loads(_tokenizer(path).to_str())
    steps = known["normalizer"] or {}
    folds = any(x["type"] == "Lowercase" for x in [steps, *steps.get("normalizers", [])] if x)
    return folds, sorted({x["content"].lower().encode() for x in known["added_tokens"]})


def fold(data: bytes, added: list[bytes]) -> list[bytes]:
    """The white-space pieces of data with ASCII letters in lower case, but for pieces with an added token in any case."""
    low = data.lower()
    pieces, same = low.split(), [x for x in added if x in low]
    if not same:
        return pieces
    return [p if any(x in q for x in same) else q for p, q in zip(data.split(), pieces, strict=True)]


def lengths(path: str, pieces: list[bytes]) -> list[int]:
    """Tokens of each piece as the library counts them; LOT pieces at a time, as encodings are large."""
    tokenizer, out = _tokenizer(path), []
    for low in range(0, len(pieces), LOT):
        texts = [p.decode("utf-8", "replace") for p in pieces[low : low + LOT]]
        out += [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return out


def _folded(name: str, folds: bool, added: list[bytes]) -> Column:
    """The column with folded case, where a tokenizer with this folding counts it alike."""
    low = F.lower(name)
    if not folds:
        return F.col(name)
    kept = [F.contains(low, F.lit(x.decode())) for x in added]
    return F.when(functools.reduce(Column.__or__, kept), F.col(name)).otherwise(low) if kept else low


def frequent_pieces(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, size: int = FREQUENT) -> tuple[bytes, np.ndarray]:
    """The most frequent pieces of a sample, joined by spaces, and their token counts. It decides speed only."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    counted = (
        docs.select("text")
        .sample(fraction=share, seed=1)
        .select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("piece"))
        .select(_folded("piece", *folding(path)).alias("piece"))
        .where((F.col("piece") != "") & (F.octet_length("piece") <= LONGEST))
        .groupBy("piece")
        .count()
        .orderBy(F.desc("count"), "piece")
        .limit(size)
    )
    pieces = [r.piece.encode() for r in counted.select("piece").collect()]  # at most size short strings
    return b" ".join(pieces), np.array(lengths(path, pieces), np.uint16)


class _Lookup:
    """The counts of a text column. A class of this module, so that all tasks of a worker share the module's caches."""

    def __init__(self, table, name: str, path: str, longest: int):
        self.table, self.name, self.path, self.longest = table, name, path, longest
        self.folding = folding(path)

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        if self.name not in _tables:
            _tables.clear()
            _cache.clear()
            blob, sizes = self.table.value
            _tables[self.name] = dict(zip(blob.split(b" "), sizes.tolist(), strict=True)) if blob else {}
        frequent = _tables[self.name]
        folds, added = self.folding
        sizes, out = [], []
        for low, high in lots(column, LOT_BYTES):
            data, offsets = column_bytes(column.slice(low, high - low))
            data = data.tobytes()
            rows = [fold(data[a:b], added) if folds else data[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if len(_cache) > CACHE:
                _cache.clear()
            missing = [p for p in set().union(*rows) if p not in frequent and p not in _cache]
            found = dict(zip(missing, lengths(self.path, missing), strict=True)) if missing else {}
            _cache.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
            for pieces in rows:
                out.append(sum(frequent[p] if p in frequent else _cache[p] if p in _cache else found[p] for p in pieces))
            sizes.append(np.diff(offsets))
        n_tokens = np.array(out, np.int64)
        return {
            "n_bytes": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
            "n_tokens": pa.array(n_tokens),
            "over_limit": pa.array(n_tokens > self.longest),
        }


def token_counts(docs: DataFrame, path: str, longest: int = 2048, sample_rows: int = SAMPLE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in carry; None: all) with n_bytes, n_tokens and over_limit (more than longest tokens).

    The tokenizer drops white space and never joins what it separates, so a text's count
    is the sum over its pieces between ASCII white space. Pieces are looked up in a
    broadcast table of frequent ones (size entries), then in the worker's own cache;
    the rest are encoded by the library, a batch at a time. Nothing is shuffled.

    Null text counts as empty: 0 bytes, 0 tokens. Special strings inside texts count as
    the library counts them, in any case: ASCII case is folded before the lookup only for a
    tokenizer that folds it, and not in pieces with such a string in whatever case. Rows are
    independent, so repeated rows get equal counts.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, sample_rows))
    count = _Lookup(table, uuid.uuid4().hex, path, longest)

    return appended(docs, "text", count, "n_bytes long, n_tokens long, over_limit boolean", carry)
