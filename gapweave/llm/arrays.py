"""Words of whole Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes scanned at once; a longer text is scanned in pieces cut between words.
PIECE = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over the 256 bytes: True for those in one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Complements of the word classes [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after folding A-Z).
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Byte -> byte with A-Z lower-cased, and the identity.
SAME = np.arange(256, dtype=np.uint8)
FOLD = SAME.copy()
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < length:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(length, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:length], _powers[1][:length]


@dataclass
class Words:
    """Words of some consecutive rows. Row r has words first[r] to first[r + 1]; starts and ends are byte places in data."""

    low: int
    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scan(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; data is folded already, and no word crosses an offset."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U64)
    inside = ~apart[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODES[data] * power[:-1], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def words(column: pa.Array, apart: np.ndarray = SPACES, fold: np.ndarray = SAME) -> Iterator[Words]:
    """Words of every row, some rows at a time. Memory follows PIECE, or the words of one longer text."""
    data, offsets = column_bytes(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        part = fold[data[offsets[low] : offsets[high]]]
        own = offsets[low : high + 1] - offsets[low]
        if len(part) <= PIECE:
            starts, ends, hashes = _scan(part, own, apart)
        else:
            found, at = [], 0
            while at < len(part):
                cut = min(at + PIECE, len(part))
                while cut < len(part):  # up to the next byte between words
                    gap = np.flatnonzero(apart[part[cut : cut + PIECE]])
                    cut = cut + int(gap[0]) if len(gap) else min(cut + PIECE, len(part))
                    if len(gap):
                        break
                s, e, h = _scan(part[at:cut], np.array([0, cut - at]), apart)
                found.append((s + at, e + at, h))
                at = cut
            starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        yield Words(low, part, own, np.searchsorted(starts, own), starts, ends, hashes)
        low = high


def grams(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of size words inside one row."""
    h = found.hashes
    count = len(h) - size + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(count, U64)
    for k in range(size):
        total = (total ^ h[k : k + count]) * U64(_BASE + 2 * k)
        total ^= total >> U64(29)
    row = found.row_of()
    at = np.flatnonzero(row[:count] == row[size - 1 :])
    return mix(total[at]), at


def shingle_sets(found: Words, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles: runs of size words; of fewer words all as one; of none an empty array."""
    hashes, at = grams(found, size)
    bounds = np.searchsorted(at, found.first)
    for r in range(found.rows):
        n = int(found.first[r + 1] - found.first[r])
        if n >= size:
            yield np.unique(hashes[bounds[r] : bounds[r + 1]])
        elif n:
            value = U64(n)
            with np.errstate(over="ignore"):
                for h in found.hashes[found.first[r] : found.first[r + 1]]:
                    value = mix(np.array([value * U64(_BASE) ^ h], U64))[0]
            yield np.array([value], U64)
        else:
            yield np.zeros(0, U64)


def byte_grams(data: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """The bucket of every run of size bytes, by its first byte; buckets is a power of two."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(count, np.uint32)
    for k in range(size):
        total = (total + data[k : k + count]) * np.uint32(0x9E3779B1)
    total ^= total >> np.uint32(15)
    return (total * np.uint32(0x85EBCA6B) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)
