"""Packing of token sequences, balanced by linear plus quadratic attention cost."""

from __future__ import annotations

import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.arrays import column_bytes
from gapweave.llm.tables import map_batches, store

LENGTH = 2048
#: A document may be cut at multiples of so many tokens; its checksums are kept at these places.
GRAIN = 16
#: Pieces that one task packs together.
CELL_PIECES = 4_096
#: Cost of n tokens in one piece: LINEAR * n + n * n.
LINEAR = 1024.0
SPECIAL = "<|endoftext|>"

_encoders: dict = {}


def _encoder(path: str):
    """text -> token ids, as the tokenizers library gives them for this file.

    The same vocabulary and merges run in tiktoken when its rank file lies beside (three to
    four times as fast); texts that it refuses go to the library, which is loaded for the first of them.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = []

        def slow(text: str) -> np.ndarray:
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, "<u4")

        _encoders[path] = slow
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

            def encode(text: str) -> np.ndarray:
                if SPECIAL in text:
                    return slow(text)
                try:
                    return np.array(fast.encode_ordinary(text), "<u4")
                except Exception:  # noqa: BLE001  its pattern gives up on some very long runs
                    return slow(text)

            _encoders[path] = encode
    return _encoders[path]


def token_numbers(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text, without special tokens (null: none)."""
    encode = _encoder(path)
    data, offsets = column_bytes(column)
    return np.array([len(encode(data[a:b].tobytes().decode("utf-8", "replace"))) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)


def pieces(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, marks: every document's ids and end_id, cut every length tokens.

    marks: checksums (CRC-32 of the little-endian ids) of the piece's first GRAIN, 2 GRAIN, ...
    tokens and of the whole piece. A null text is empty: the end id alone.
    """

    def cut(batch: pa.RecordBatch):
        encode = _encoder(path)
        data, offsets = column_bytes(batch.column(1))
        rows, starts, sizes, totals, marks = [], [], [], [], []
        for r in range(batch.num_rows):
            ids = encode(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
            ids = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            for start in range(0, len(ids), 4 * length):
                part = memoryview(ids)[start : start + 4 * length]
                crc, checks = 0, []
                step = len(part) if len(part) == 4 * length else 4 * GRAIN  # a full piece is never cut
                for at in range(0, len(part), step):
                    crc = zlib.crc32(part[at : at + step], crc)
                    checks.append(crc)
                rows.append(r)
                starts.append(start // 4)
                sizes.append(len(part) // 4)
                totals.append(len(ids) // 4)
                marks.append(np.array(checks, np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, totals)), pa.array(marks, pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "marks"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, start long, length long, doc_tokens long, marks binary")


def _times(matrix: list[int], vector: int) -> int:
    """A 32 x 32 matrix over GF(2) (a number for each input bit) times a vector."""
    total = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def _zero_bytes() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes do to the state of a CRC-32, by squaring."""
    rows = []
    for bit in range(32):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        rows.append(value)
    powers = [rows]
    while len(powers) < 40:
        powers.append([_times(powers[-1], row) for row in powers[-1]])
    return powers


_ZERO_BYTES = _zero_bytes()


def _shift(crc: int, size: int) -> int:
    """What the CRC-32 of some bytes contributes to the CRC-32 of the same bytes followed by size more."""
    for matrix in _ZERO_BYTES:
        if not size:
            return crc
        if size & 1:
            crc = _times(matrix, crc)
        size >>= 1
    return crc


def part_crc(marks: np.ndarray, size: int, low: int, high: int) -> int:
    """CRC-32 of tokens low to high of a piece of size tokens; low and high are multiples of GRAIN or the ends."""
    upto = lambda n: 0 if n == 0 else int(marks[-1]) if n == size else int(marks[n // GRAIN - 1])
    return upto(high) ^ _shift(upto(low), 4 * (high - low)) if low else upto(high)


def pack_cell(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, low, high, sequence, offset) for the tokens low to high of pieces of the given sizes.

    As few sequences are open as the tokens need. Pieces go in falling order of cost, each
    to the sequence of the lowest cost among those with room for it (the first of equals).
    A piece that fits nowhere is cut at a multiple of GRAIN: its front fills the sequence
    with the most room, and the rest waits for its turn. Only when no sequence has room for
    GRAIN tokens another is opened.
    """
    count = max(1, -(-int(sizes.sum()) // length))
    room, cost = np.full(count, length, np.int64), np.zeros(count)
    queue = [(-int(n), k, 0) for k, n in enumerate(sizes)]
    heapq.heapify(queue)
    out = []

    def put(piece: int, low: int, high: int, sequence: int) -> None:
        size = high - low
        out.append((piece, low, high, sequence, int(length - room[sequence])))
        room[sequence] -= size
        cost[sequence] += LINEAR * size + float(size) ** 2

    while queue:
        size, piece, low = heapq.heappop(queue)
        size = -size
        able = np.where(room >= size, cost, np.inf)
        best = int(np.argmin(able))
        if able[best] < np.inf:
            put(piece, low, low + size, best)
            continue
        widest = int(np.argmax(room))
        part = int(room[widest]) // GRAIN * GRAIN
        if part:
            put(piece, low, low + part, widest)
            heapq.heappush(queue, (-(size - part), piece, low + part))
        else:
            room, cost = np.append(room, length), np.append(cost, 0.0)
            heapq.heappush(queue, (-size, piece, low))
    return out


def packed(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document.

    Tokens: the library's ids of the whole text without special ones added, then end_id.
    Every length tokens of a document make a sequence of their own; what is left of the
    documents is dealt by hash into cells of about CELL_PIECES pieces, and one task packs a
    cell (see pack_cell), so a cell has at most one sequence that is not nearly full.

    Null text is empty: a piece of the end id. A null doc_id is carried along. Repeated rows
    are documents of their own; nothing but doc_id tells their pieces apart. No rows give
    no pieces.
    """
    rows = store(pieces(docs, path, end_id, length).withColumn("row", F.monotonically_increasing_id()))
    cells = rows.count() // CELL_PIECES + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes, starts = table["length"].to_numpy(), table["start"].to_numpy()
        checks = [np.frombuffer(m, np.uint32) for m in table["marks"].to_pylist()]
        whole = np.flatnonzero(sizes == length)
        found = [(int(k), 0, length, s, 0) for s, k in enumerate(whole)]
        rest = np.flatnonzero(sizes < length)
        if len(rest):
            found += [(int(rest[k]), a, b, s + len(whole), o) for k, a, b, s, o in pack_cell(sizes[rest], length)]
        piece, low, high, sequence, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
        crc = [part_crc(checks[k], int(sizes[k]), a, b) for k, a, b, _, _ in found]
        cell = table["cell"][0].as_py()
        taken = pa.array(piece)
        return pa.table(
            {
                "doc_id": table["doc_id"].take(taken),
                "start": pa.array(starts[piece] + low),
                "length": pa.array(high - low),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": table["doc_tokens"].take(taken),
                "sequence_id": pa.array((cell << 32) + sequence),
                "offset": pa.array(offset),
            }
        )

    return (
        rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
        .groupBy("cell")
        .applyInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
