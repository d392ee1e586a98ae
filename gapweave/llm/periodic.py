"""Runs of periodically repeated words: suffix classes united by falling common prefix, over ordered sets of places.

A run of period q that starts at place s and holds n words makes the suffixes from s and
from s + q agree in exactly n - q words. So when suffixes are united in falling order of
their common prefixes, s and s + q come to stand next to each other in the ordered set of
places of one class just when classes that agree in n - q words are united.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapweave.llm.arrays import U64, column_bytes, mix
from gapweave.llm.tables import appended

#: A run holds at least this many words and this many periods.
WORDS = 6
PERIODS = 4
LOT_BYTES = 1 << 22


def _shared(ids: np.ndarray, size: int) -> np.ndarray:
    """Places whose next size words stand elsewhere too (a few others may be among them)."""
    count = len(ids) - size + 1
    if count < 2:
        return np.zeros(0, np.int64)
    total = np.zeros(count, U64)
    for k in range(size):
        total = mix(total ^ ids[k : k + count].view(U64) + U64(k))
    order = np.argsort(total)
    same = total[order[1:]] == total[order[:-1]]
    again = np.zeros(count, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def suffix_order(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, common prefix of each with the next).

    By doubling: the class of a suffix by its first 2 ** (k + 1) words follows from the classes of its
    two halves. It ends when all given places are told apart. The common prefix of two suffixes is
    then read off the stored levels, the longest first.
    """
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    size = 1
    while True:
        low = levels[-1]
        second = np.zeros(n, np.int64)
        second[: n - size] = low[size:] + 1
        found, inverse = np.unique(low.astype(np.int64) * (n + 1) + second, return_inverse=True)
        levels.append(inverse.astype(np.int32))
        # only suffixes of the given places must be told apart
        if len(np.unique(inverse[places])) == len(places) or 2 * size > n:
            break
        size *= 2
    order = places[np.argsort(levels[-1][places], kind="stable")]
    i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(order) - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, ranks = 1 << level, levels[level]
        live = np.flatnonzero((i < n) & (j < n))
        same = live[ranks[i[live]] == ranks[j[live]]]
        common[same] += step
        i[same] += step
        j[same] += step
    return order, common


def runs_of(ids: np.ndarray, words: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal periodic runs of at least words words and periods periods, in order.

    ids: a number for each word. periods is at least 3, so that what two suffixes of a run share
    is longer than its period and tells the smallest one.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not found")
    # suffixes of a run of period q agree in max(words - q, (periods - 1) q) words at least
    least = min(max(words - q, (periods - 1) * q) for q in range(1, words + 1))
    places = _shared(ids, least)
    if len(places) < 2:
        return []
    order, common = suffix_order(ids, places)
    group = {int(p): int(p) for p in places}  # the class of a place, named by one of its members
    members = {int(p): [int(p)] for p in places}
    found = []

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        length = shared + period
        if length >= max(words, periods * period) and (i == 0 or ids[i - 1] != ids[j - 1]):
            found.append((i, length, period))

    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    for left, right, shared in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist(), strict=True):
        small, large = group[left], group[right]
        if len(members[small]) > len(members[large]):
            small, large = large, small
        few, many = members.pop(small), members[large]
        for k, place in enumerate(few):
            at = bisect_left(many, place)
            if at and (k == 0 or few[k - 1] < many[at - 1]):
                seed(many[at - 1], place, shared)
            if at < len(many) and (k + 1 == len(few) or few[k + 1] > many[at]):
                seed(place, many[at], shared)
        if 8 * len(few) < len(many):
            for place in few:
                insort(many, place)
        else:
            many += few
            many.sort()  # two ordered stretches: linear
        for place in few:
            group[place] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    drop = bytearray(len(words))
    for start, length, period in found:
        drop[start + period : start + length] = b"\x01" * (length - period)
    return b" ".join([w for w, gone in zip(words, drop, strict=True) if not gone])


def _scan(words: int, periods: int):
    def scan(column: pa.Array) -> dict[str, pa.Array]:
        data, offsets = column_bytes(column)
        counts, starts, lengths, sizes, texts, ends = [], [], [], [], [], [0]
        for low, high in zip(offsets[:-1], offsets[1:], strict=True):
            text = data[low:high].tobytes().split()
            numbers: dict[bytes, int] = {}
            ids = np.fromiter(map(numbers.setdefault, text, range(len(text))), np.int64, len(text))
            found = runs_of(ids, words, periods)
            counts.append(len(text))
            starts += [r[0] for r in found]
            lengths += [r[1] for r in found]
            sizes += [r[2] for r in found]
            ends.append(len(starts))
            texts.append(collapsed(text, found).decode("utf-8", "replace"))
        fields = [pa.array(x, pa.int64()) for x in (starts, lengths, sizes)]
        spans = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
        return {
            "n_words": pa.array(counts, pa.int64()),
            "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
            "collapsed": pa.array(texts, pa.string()),
        }

    return scan


def periodic_runs(docs: DataFrame, words: int = WORDS, periods: int = PERIODS, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in carry; None: all) with n_words, runs (start, length, period) and collapsed.

    Words are runs of bytes other than ASCII white space, numbered from 0. A run is a stretch of
    words with smallest period q, at least words words and periods * q long, that no neighbouring
    word extends; runs come by start, then period. collapsed holds the words that no run contains
    after its first q words, joined by spaces.

    Null text has no words, no runs and an empty collapsed text. Rows are independent, so repeated
    rows get equal results; a column of docs with the name of a new one is replaced. A text is worked
    on as a whole: memory follows its words times the logarithm of their number.
    """
    return appended(docs, "text", _scan(words, periods), "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", carry, LOT_BYTES)
