"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.arrays import Words, column_bytes, grams, words
from gapweave.llm.tables import appended, map_batches

SAMPLE_ROWS = 1_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(flags[: offsets[-1]], offsets[:-1][full], dtype=np.int64)
    return out


def _per_part(column: pa.Array, names: Sequence[str], measure: Callable[[Words], Sequence[np.ndarray]]) -> dict[str, np.ndarray]:
    out = {name: np.zeros(len(column), np.int64) for name in names}
    for part in words(column):
        for name, values in zip(names, measure(part), strict=True):
            out[name][part.low : part.low + part.rows] = values
    return out


def _word_counts(part: Words) -> Sequence[np.ndarray]:
    # white space is ASCII, so code points in words are the bytes that neither continue one nor are white space
    points = (part.data & 0xC0) != 0x80
    points &= (part.data != 32) & ~((part.data >= 9) & (part.data <= 13))
    return np.diff(part.first), _sums(points, part.offsets)


def _lettered(part: Words) -> Sequence[np.ndarray]:
    letters = np.concatenate([[0], np.cumsum(_LETTER[part.data])])
    with_letter = letters[part.ends] > letters[part.starts]
    return (_sums(with_letter, part.first),)


def _repeats(part: Words) -> Sequence[np.ndarray]:
    found, at = grams(part, 3)
    row = part.row_of()[at] if len(at) else at
    order = np.lexsort((found, row))
    same = (found[order][1:] == found[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(part.hashes), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return (_sums(covered, part.first),)


def _lines(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = column_bytes(column)
    data = data.tobytes()
    lines, repeated = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for r in range(len(column)):
        found = [x for x in data[offsets[r] : offsets[r + 1]].split(b"\n") if x.strip()]
        lines[r] = len(found)
        repeated[r] = len(found) - len(set(found))
    return {"n_lines": lines, "n_dup_lines": repeated}


def _bytes(names: Sequence[str], tables: Sequence[np.ndarray]) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    def count(column: pa.Array) -> dict[str, np.ndarray]:
        data, offsets = column_bytes(column)
        return {name: _sums(table[data], offsets) for name, table in zip(names, tables, strict=True)}

    return count


#: What one pass over a text column measures: names of the numbers -> function.
MEASURES: dict[tuple[str, ...], Callable[[pa.Array], dict[str, np.ndarray]]] = {
    ("n_words", "word_chars"): lambda c: _per_part(c, ("n_words", "word_chars"), _word_counts),
    ("n_symbols",): _bytes(("n_symbols",), (_SYMBOLS,)),
    ("n_lines", "n_dup_lines"): _lines,
    ("n_repeat_words",): lambda c: _per_part(c, ("n_repeat_words",), _repeats),
    ("n_lettered",): lambda c: _per_part(c, ("n_lettered",), _lettered),
    ("n_upper", "n_letters"): _bytes(("n_upper", "n_letters"), (_UPPER, _LETTER)),
}


@dataclass(frozen=True)
class Rule:
    """rejects takes the numbers named in needs, as arrays, and says which rows fail."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
RULES = BASE_RULES + (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("short_words", ("n_words", "word_chars"), lambda n, c: c < 2 * n),
    Rule("long_words", ("n_words", "word_chars"), lambda n, c: c > 15 * n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n),
    Rule("few_letters", ("n_words", "n_lettered"), lambda n, a: 10 * a < 8 * n),
    Rule("shouting", ("n_letters", "n_upper"), lambda n, u: 2 * u > n),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Numbers:
    """Numbers of a text column, measured only for the rows that are asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.values: dict[str, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        """The number of each of the rows (positions)."""
        if name not in self.values:
            self.values[name] = np.zeros(len(self.column), np.int64)
            self.known[name] = np.zeros(len(self.column), bool)
        missing = rows[~self.known[name][rows]]
        if len(missing):
            names, measure = next((k, f) for k, f in MEASURES.items() if name in k)
            part = self.column if len(missing) == len(self.column) else self.column.take(pa.array(missing))
            for found, values in measure(part).items():
                self.values.setdefault(found, np.zeros(len(self.column), np.int64))[missing] = values
                self.known.setdefault(found, np.zeros(len(self.column), bool))[missing] = True
        return self.values[name][rows]


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per second, both measured on a random sample of about sample_rows rows."""
    share = min(1.0, sample_rows / max(1, docs.count()))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.arange(batch.num_rows)
        out = []
        for k, rule in enumerate(rules):
            numbers = Numbers(batch.column(0))  # each rule pays for all that it needs
            began = time.perf_counter()
            rejected = rule.rejects(*(numbers.get(n, rows) for n in rule.needs)).sum()
            out.append((k, time.perf_counter() - began, int(rejected), batch.num_rows))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["rule", "seconds", "rejected", "rows"])

    found = (
        map_batches(docs.select("text").sample(fraction=share, seed=1), measure, "rule long, seconds double, rejected long, rows long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("rows").alias("rows"))
        .collect()  # a row for each rule
    )
    worth = {r.rule: (r.rejected / max(1, r.rows)) / max(r.seconds / max(1, r.rows), 1e-12) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), k))]


def cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, complete: Sequence[str] = (), carry: list[str] | None = None
) -> DataFrame:
    """docs (its columns in carry; None: all) with kept (no rule rejects the text), and the numbers named in complete.

    The rules run in the order of estimate(); each sees only the rows that all earlier ones
    passed, and a number is measured only for rows whose rules ask for it. The order changes
    the cost, never the verdict. Numbers in complete are measured for every row.

    Null text counts as empty: no words, so it is rejected. Repeated rows get equal verdicts.
    """
    order = estimate(docs, rules, sample_rows)

    def judge(column: pa.Array) -> dict[str, pa.Array]:
        numbers = Numbers(column)
        everything = np.arange(len(column))
        out = {name: pa.array(numbers.get(name, everything)) for name in complete}
        alive = everything
        for rule in order:
            if not len(alive):
                break
            alive = alive[~rule.rejects(*(numbers.get(n, alive) for n in rule.needs))]
        kept = np.zeros(len(column), bool)
        kept[alive] = True
        return out | {"kept": pa.array(kept)}

    return appended(docs, "text", judge, ", ".join([f"{name} long" for name in complete] + ["kept boolean"]), carry)
