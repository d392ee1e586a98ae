"""Byte-level BPE: longest matches of an Aho-Corasick automaton, backtracking by which tokens may stand side by side.

A sequence of tokens is the one that the merges give if and only if every two adjacent
tokens are what the merges give for their own bytes. So the encoding of a text is found
from the left by taking the longest token that fits the one before it, and by going back
where none does.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gapweave.llm.arrays import U64, mix
from gapweave.llm.tables import appended

#: Pieces whose ids a worker remembers, and token pairs; when full it starts anew.
MEMO_PIECES = 1 << 17
MEMO_PAIRS = 1 << 18
#: Slots of the table of pairs that many pieces look up at once; a pair takes the slot of an older one.
SLOTS = 1 << 20
#: Pieces up to so many bytes are encoded side by side and remembered, longer ones alone.
LONGEST = 64
#: Places of a piece whose matches are held at a time.
WINDOW = 1 << 12
#: Pieces of a text that are encoded together at most.
TURN = 1 << 16
#: Bytes of text that are encoded together.
LOT_BYTES = 1 << 20
#: Stands between pieces: no byte, so in no token.
GAP = "\u0100"

_encoders: dict = {}


class BytePairs:
    """Ids of the pieces of a text by the ranks of a file."""

    def __init__(self, data: bytes, pattern: str):
        import ahocorasick

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        single = [bytes([b]) for b in range(256)]
        if not all(b in self.ranks for b in single):
            raise ValueError("a byte-level vocabulary ranks every byte")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        self.sizes[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        self.bytes = np.array([self.ranks[b] for b in single])
        self.longest = int(self.sizes.max())
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []
        self.beside: dict[int, bool] = {}
        self.slot_pairs, self.slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        # each byte is the character with its number, as the automaton works on strings; single bytes need no search
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Ids of data by the merges themselves: the lowest rank first, the leftmost of equals. For short data."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are side by side."""
        pair = left << 32 | right
        known = self.beside.get(pair)
        if known is None:
            if len(self.beside) >= MEMO_PAIRS:
                self.beside.clear()
            known = self.beside[pair] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """fits() of many pairs."""
        pairs = left << 32 | right
        slots = (mix(pairs.view(U64)) & U64(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.slot_pairs[slots] != pairs)
        out = self.slot_fits[slots]
        if len(new):
            unknown, where = np.unique(pairs[new], return_inverse=True)
            known = np.array([self.fits(p >> 32, p & 0xFFFFFFFF) for p in unknown.tolist()], bool)
            out[new] = known[where]
            # of pairs that share a slot one is written whole: its place is found first
            chosen = np.unique(slots[new], return_index=True)[1]
            self.slot_pairs[slots[new][chosen]], self.slot_fits[slots[new][chosen]] = pairs[new][chosen], known[where][chosen]
        return out

    def _found(self, text: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of two bytes and more that start at places low to high of text: (places, tokens), the longest of a place first."""
        stop = min(high + self.longest - 1, len(text))
        flat = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text, low, stop)), np.int64)
        token = flat[1::2]
        start = flat[::2] + 1 - self.sizes[token]
        if stop > high:
            inside = start < high
            start, token = start[inside], token[inside]
        order = np.argsort(start * (self.longest + 1) - self.sizes[token])
        return start[order], token[order]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, as bytes. All take a step at a time: the next shorter token, or back to the place before."""
        text = GAP.join(p.decode("latin-1") for p in pieces)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        start, token = self._found(text, 0, len(text))
        place = np.arange(len(text) + 1)
        turn, stop = np.searchsorted(start, place), np.searchsorted(start, place, "right")
        code = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        single = self.bytes[code & 255]
        last, back = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, np.int64)
        dead = np.zeros(len(text) + 1, bool)
        at, end, active = begins.copy(), ends, np.arange(len(pieces))
        while len(active):
            here = at[active]
            now = turn[here]
            turn[here] += 1
            spent = now > stop[here]  # the single byte was the last to be tried
            if spent.any():
                gone = here[spent]
                dead[gone] = True
                at[active[spent]] = back[gone]
                moving, here, now = active[~spent], here[~spent], now[~spent]
            else:
                moving = active
            taken = single[here] if not len(token) else np.where(now < stop[here], token[np.minimum(now, len(token) - 1)], single[np.minimum(here, len(single) - 1)])
            to = here + self.sizes[taken]
            before = last[here]
            good = ~dead[to]
            checked = np.flatnonzero(good & (before >= 0))
            good[checked] = self.fit(before[checked], taken[checked])
            to, here, taken, moving = to[good], here[good], taken[good], moving[good]
            last[to], back[to], at[moving] = taken, here, to
            if (at[moving] == end[moving]).any():
                active = active[at[active] < end[active]]
        # the chains, from their ends
        chosen = np.full(len(text) + 1, -1)
        at, active = ends.copy(), np.arange(len(pieces))
        while len(active):
            active = active[at[active] > begins[active]]
            here = at[active]
            at[active] = back[here]
            chosen[back[here]] = last[here]
        starts = np.flatnonzero(chosen >= 0)
        ids = chosen[starts].astype("<u4").tobytes()
        low, high = (4 * np.searchsorted(starts, x) for x in (begins, ends))
        return [ids[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern, of any length; a piece that is a token is that token.

        A chain of fitting tokens up to a place is the encoding of the bytes before it, so there is
        one such chain at most: a place that the rest cannot follow is tried once only.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        matches, sizes, fits = self._matches(piece), self.sizes.tolist(), self.fits
        dead, chain = bytearray(len(piece) + 1), []
        at, last, rest = 0, -1, iter(matches(0))
        while at < len(piece):
            for token in rest:
                end = at + sizes[token]
                if not dead[end] and (last < 0 or fits(last, token)):
                    chain.append((token, rest))
                    at, last, rest = end, token, iter(matches(end))
                    break
            else:
                dead[at] = 1
                last, rest = chain.pop()
                at -= sizes[last]
                last = chain[-1][0] if chain else -1
        return [token for token, _ in chain]

    def _matches(self, piece: bytes) -> Callable[[int], list[int]]:
        """place -> the tokens that start there, the longest first; the matches of two windows are held."""
        text = piece.decode("latin-1")
        windows: dict[int, tuple[list, list]] = {}

        def at(place: int) -> list[int]:
            if place >= len(piece):
                return []
            number, place = divmod(place, WINDOW)
            if number not in windows:
                if len(windows) > 1:
                    del windows[min(windows) if number > min(windows) else max(windows)]
                low = number * WINDOW
                start, token = self._found(text, low, min(low + WINDOW, len(text)))
                windows[number] = np.searchsorted(start, np.arange(low, low + WINDOW + 1)).tolist(), token.tolist()
            bounds, token = windows[number]
            return token[bounds[place] : bounds[place + 1]] + [int(self.bytes[piece[number * WINDOW + place]])]

        return at

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The memo with the ids of these pieces in it; long ones of the turn before have left it."""
        known = self.pieces
        for piece in self.long:
            known.pop(piece, None)
        self.long.clear()
        if len(known) > MEMO_PIECES:
            known.clear()
        new = [p for p in pieces if p not in known]
        data = [p.encode("utf-8", "replace") for p in new]
        short = []
        for k, piece in enumerate(data):
            rank = self.ranks.get(piece)
            if rank is None and len(piece) <= LONGEST:
                short.append(k)
            else:
                known[new[k]] = np.array(self.encode_piece(piece) if rank is None else [rank], "<u4").tobytes()
                if len(piece) > LONGEST:
                    self.long.append(new[k])
        if short:
            known.update(zip([new[k] for k in short], self.encode_pieces([data[k] for k in short]), strict=True))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        count = 0

        def flush() -> None:
            known = self.learn(set().union(*(p for _, p in held)))
            for k, found in held:
                out[k].append(b"".join(map(known.__getitem__, found)))
            held.clear()

        for k, text in enumerate(texts):
            matches = (m[0] for m in self.pattern.finditer(text)) if len(text) > TURN else iter(self.pattern.findall(text))
            while found := list(itertools.islice(matches, TURN)):
                held.append((k, found))
                count += len(found)
                if count >= TURN:
                    flush()
                    count = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Coder:
    """Reads the rank file once a worker. A class of this module, so that all tasks of a worker share its encoders."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    @property
    def pairs(self) -> BytePairs:
        key = (self.path, self.pattern)
        if key not in _encoders:
            with open(self.path, "rb") as lines:
                _encoders[key] = BytePairs(lines.read(), self.pattern)
        return _encoders[key]


class _RoundTrip(_Coder):
    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        pairs = self.pairs
        ids = pairs.encode([text or "" for text in column.to_pylist()])
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.binary()),
            "decoded": pa.array([pairs.decode(x) for x in ids], pa.binary()),
        }


class _Decoder(_Coder):
    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        pairs = self.pairs
        return {"decoded": pa.array([pairs.decode(x or b"") for x in column.to_pylist()], pa.binary())}


def encoded(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in carry; None: all) with n_tokens, ids and decoded of every text.

    path: a file of base64 tokens and their ranks, at the same place on every machine; pattern
    splits a text into pieces, which are encoded apart. ids holds little-endian unsigned
    32-bit numbers, decoded the bytes that these stand for. Null text counts as empty: no
    ids, no bytes. Special strings are ordinary text. Rows are independent, so repeated
    rows get equal ids; a column of docs with the name of a new one is replaced.
    """
    return appended(docs, "text", _RoundTrip(path, pattern), "n_tokens long, ids binary, decoded binary", carry, LOT_BYTES)


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """rows with decoded, the bytes that a column of ids stands for; null ids give no bytes."""
    return appended(rows, ids, _Decoder(path, pattern), "decoded binary", carry, LOT_BYTES)
