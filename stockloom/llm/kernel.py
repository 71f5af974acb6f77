"""Vectorised text helpers for Arrow tasks: words, hashes and per-document sums on raw UTF-8 bytes.

Everything here works on one piece of an Arrow string column at a time (a few MB), so memory in a
Python worker is bounded by the piece, not by the partition. A longer text is a piece of its own: hashes and counts over its
bytes are taken in blocks, so that what stays is one number for each of its words. White space is space and U+0009-U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document forms a piece of its own.
PIECE_BYTES = 1 << 19
SLICE_ROWS = 512
#: Bytes that block-wise work takes at once.
BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_RNG = np.random.default_rng(20240229)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
WINDOW_KEYS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """R**i and R**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, r in (("up", _R), ("down", _R_INV)):
                x = np.full(n + n // 4, r, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Piece:
    """Some consecutive texts: ``data`` (uint8), ``offsets`` (n + 1) into it, ``first`` (row of the first text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of every word, and the text each belongs to."""
        inside = ~IS_SPACE[self.data]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[cuts] = False
        after[cuts - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def rolling(self, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
        """Prefix sums for span_hash, one longer than the data."""
        up, _ = _POWERS.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(keys[self.data] * up[: len(self.data)], dtype=np.uint64, out=out[1:])
        return out

    def span_hash(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans get equal hashes wherever they stand."""
        _, down = _POWERS.upto(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
        """Hashes of byte spans in order of their starts, as span_hash gives them, block by block where the data are long."""
        if len(self.data) <= 2 * BLOCK:
            return self.span_hash(self.rolling(keys), starts, ends)
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, base + BLOCK)))
            part = Piece(self.data[base : int(ends[at:to].max())], np.zeros(1, np.int64), 0)
            out[at:to] = part.span_hash(part.rolling(keys), starts[at:to] - base, ends[at:to] - base)
            at = to
        return out

    def hasher(self, keys: np.ndarray = BYTE_KEYS):
        """A function of starts and ends that gives hashes; short data are summed once for all its calls."""
        if len(self.data) > 2 * BLOCK:
            return lambda starts, ends: self.hashes(starts, ends, keys)
        sums = self.rolling(keys)
        return lambda starts, ends: self.span_hash(sums, starts, ends)

    def stretches(self, cut) -> list[tuple[int, Piece]]:
        """(first byte, piece) of the parts of a single long text, cut where ``cut`` (data -> marks of bytes that may begin a part)
        allows it next after every block; the piece itself where it is short or holds several texts."""
        if self.n != 1 or len(self.data) <= 2 * BLOCK:
            return [(0, self)]
        ends, at = [0], BLOCK
        while at < len(self.data):
            window = self.data[at - 1 : at + BLOCK + 1]
            found = np.flatnonzero(cut(window)[1:-1])
            if len(found):
                ends.append(at + int(found[0]))
                at = ends[-1] + BLOCK
            else:
                at += len(window) - 2 if len(window) > 2 else 1
        ends.append(len(self.data))
        return [(a, Piece(self.data[a:b], np.array([0, b - a]), self.first)) for a, b in zip(ends, ends[1:], strict=False)]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of whole texts; null counts as empty. Rows are converted a few at a time, so that a
    large Arrow batch is never copied whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for start in range(0, len(column), SLICE_ROWS):
        part = pc.fill_null(column.slice(start, SLICE_ROWS).cast(pa.large_string()), "")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, len(part))
            yield Piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], start + at)
            at = to


def count_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    if weights is None:
        return np.bincount(owner, minlength=n).astype(np.int64)
    return np.rint(np.bincount(owner, weights=weights, minlength=n)).astype(np.int64)


def byte_count(piece: Piece, table: np.ndarray) -> np.ndarray:
    """For each text, how many of its bytes are marked in a boolean table of 256."""
    if piece.n == 1:
        return np.array([sum(int(np.count_nonzero(table[piece.data[a : a + BLOCK]])) for a in range(0, len(piece.data), BLOCK))], np.int64)
    sums = np.concatenate(([0], np.cumsum(table[piece.data], dtype=np.int64)))
    return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of one text, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        total += hashes[first + j] * WINDOW_KEYS[j]
    return mix(total), first
