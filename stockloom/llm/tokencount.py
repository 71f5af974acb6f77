"""Token counts by compiled finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE vocabulary without tokenising:

* The *splitter* reads code-point classes and emits a bit where a pre-token begins. Text is cut into
  chunks of equal length; each chunk yields a state map (start state -> end state), the maps are
  composed by a parallel prefix scan, and a second pass emits the bits with every start state known.
* The *merger* reads the bytes of a pre-token. After every byte the encoding of what was read so far
  has one last token, and that token is compatible with the one before it; so a state needs only the
  last tokens at those positions from which a longer token could still reach (with counts relative to
  now). Each transition carries the change of the token count, which may be negative as tokens fuse.
  States are compiled when first met and kept in flat numpy tables; all pre-tokens of a piece step
  together. A long pre-token is cut into chunks that step side by side; their state maps are filled where a
  state occurs and composed from left to right. The table is dropped and compiled anew when it has grown past ``MAX_STATES``.

Edge cases: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text
count as that token, as the library does by default; a repeated doc_id is counted for each row.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel

LIMIT = 1024
MAX_STATES = 250_000
CHUNK = 64
#: Bytes of a pre-token that the merger steps through in a row; a longer one is cut into chunks of this size.
SPAN = 256
_SPREAD = 0x9E3779B97F4A7C15

# ---------------------------------------------------------------- splitter

_SP, _WS, _L, _N, _O = range(5)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Symbols: space and other white space, each with / without a printing character next; letter; digit;
#: other; apostrophe before a contraction of one / two letters; then the same for a text's first character; padding.
_SYMBOLS = 9
_PAD = 2 * _SYMBOLS
#: States: nothing read, letters, digits, others, space, white space, one / two contraction letters due, contraction read.
_STATES = 9


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, _O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _L
        elif kind == "N":
            out[c] = _N
    out[WHITE_SPACE] = _WS
    out[32] = _SP
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output bit, both indexed by symbol * _STATES + state."""
    start, letters, digits, others, space, white, due1, due2, done = range(_STATES)
    step, bit = np.zeros((_PAD + 1, _STATES), np.uint8), np.zeros((_PAD + 1, _STATES), np.uint8)
    step[_PAD] = np.arange(_STATES)
    for symbol in range(_PAD):
        kind = symbol % _SYMBOLS
        for state in range(_STATES):
            s = start if symbol >= _SYMBOLS else state
            if s in (due1, due2):
                step[symbol, state] = done if s == due1 else due1
                continue
            if kind < 4:
                b = kind in (0, 2) if s in (space, white) else True
                to = space if kind < 2 else white
            elif kind in (4, 5):
                to = letters if kind == 4 else digits
                b = s not in (to, space)
            elif kind > 6 and s in (start, letters, digits, white, done):
                b, to = True, due1 if kind == 7 else due2
            else:
                b, to = s not in (others, space), others
            step[symbol, state], bit[symbol, state] = to, b
    return step.ravel(), bit.ravel()


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first`` holds the indices where a text (or a stretch of one) begins."""
    kind = classes()[points]
    n = len(kind)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    white = kind <= _WS
    printing_next = np.zeros(n, bool)
    printing_next[:-1] = ~white[1:]
    printing_next &= ~head[1:]
    out = np.where(white, 2 * kind + 1 - printing_next, kind + 2).astype(np.uint8)
    for i in np.flatnonzero(points == 39):
        a = int(points[i + 1]) if i + 1 < n and not head[i + 1] else 0
        b = int(points[i + 2]) if a and i + 2 < n and not head[i + 2] else 0
        if a and chr(a) in "stmd":
            out[i] = 7
        elif b and chr(a) + chr(b) in ("re", "ve", "ll"):
            out[i] = 8
    out[head[:n]] += _SYMBOLS
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of state maps (rows) under composition, in log2(rows) steps."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d], axis=1)
        d *= 2
    return out


def split_bits(symbol: np.ndarray) -> np.ndarray:
    """True where a pre-token begins."""
    step, bit = splitter()
    n = len(symbol)
    rows = -(-n // CHUNK)
    s = np.full(rows * CHUNK, _PAD, np.int64)
    s[:n] = symbol
    s = np.ascontiguousarray((s * _STATES).reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for column in s:
        maps = step[column[:, None] + maps]
    state = np.zeros(rows, np.uint8)
    if rows > 1:
        state[1:] = compose_scan(maps[:-1])[:, 0]
    out = np.empty((CHUNK, rows), np.uint8)
    for k, column in enumerate(s):
        at = column + state
        out[k] = bit[at]
        state = step[at]
    return out.T.ravel()[:n].astype(bool)


# ---------------------------------------------------------------- merger


def _byte_of_symbol() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_symbol()
        ids = {t: i for t, i in spec["model"]["vocab"].items()}
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        special_ids = {t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in ids.items() if i not in special_ids}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.prefixes = {b[:k] for b in self.bytes_of.values() for k in range(1, len(b))}
        self.compatible = functools.lru_cache(1 << 19)(self._compatible)

    def encode(self, text: bytes) -> list[int]:
        """Reference encoding of one pre-token: fuse the pair of lowest rank, leftmost first."""
        parts = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min(((self.merges.get((parts[i], parts[i + 1]), (1 << 60, 0))[0], i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b encodes as exactly these two tokens. a = -1: the pre-token's start."""
        if a < 0:
            return self.encode(self.bytes_of[b]) == [b]
        return self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


class Merger:
    """Lazily compiled transducer. Transitions live in an open-addressing numpy table: the key is state * 256 + byte,
    the value is next state * 2**16 + (change of the count + 2**15)."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES) -> None:
        self.vocabulary, self.max_states = vocabulary, max_states
        self.reset()

    def reset(self) -> None:
        self._room(12)
        # a state: what stands since the furthest open position, and (distance, last token there, count there less count now)
        self.meaning = [(b"", ((0, -1, 0),))]
        self.number = {self.meaning[0]: 0}

    def _room(self, bits: int) -> None:
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.shift, self.used = 64 - bits, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of transitions; -1 where not compiled."""
        slot = self._slots(keys)
        seen = self.keys[slot]
        out = self.values[slot]
        open_ = np.flatnonzero(seen != keys)
        while len(open_):
            empty = seen[open_] < 0
            out[open_[empty]] = -1
            open_ = open_[~empty]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen[open_] = self.keys[slot[open_]]
            out[open_] = self.values[slot[open_]]
            open_ = open_[seen[open_] != keys[open_]]
        return out

    def store(self, key: int, value: int) -> None:
        if 2 * self.used > len(self.keys):
            full = self.keys >= 0
            old_keys, old_values = self.keys[full], self.values[full]
            self._room(66 - self.shift)
            for k, v in zip(old_keys.tolist(), old_values.tolist(), strict=True):
                self.store(k, v)
        slot = ((key * _SPREAD) & 0xFFFFFFFFFFFFFFFF) >> self.shift
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.values[slot] = key, value
        self.used += 1

    def compile(self, state: int, byte: int) -> None:
        v = self.vocabulary
        suffix, entries = self.meaning[state]
        text = suffix + bytes([byte])
        found = None
        for distance, last, rel in entries:
            token = v.id_of.get(text[len(suffix) - distance :])
            if token is not None and v.compatible(last, token):
                found = (token, rel + 1)
                break
        if found is None:
            raise ValueError("the vocabulary is not a proper byte-level BPE vocabulary")
        token, gain = found
        kept = tuple((d + 1, last, rel - gain) for d, last, rel in entries if text[len(suffix) - d :] in v.prefixes)
        kept += ((0, token, 0),)
        meaning = (text[len(text) - kept[0][0] :], kept)
        to = self.number.setdefault(meaning, len(self.meaning))
        if to == len(self.meaning):
            self.meaning.append(meaning)
        self.store(state * 256 + byte, to * 65536 + gain + 32768)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token count of each byte span. Spans longer than SPAN are cut into chunks whose state maps (state before -> state
        after, count) compose from left to right."""
        if len(self.meaning) > self.max_states:
            self.reset()
        out = np.zeros(len(starts), np.int64)
        short = ends - starts <= SPAN
        out[short] = self.run(data, starts[short], ends[short], np.zeros(int(short.sum()), np.int64))[1]
        for i in np.flatnonzero(~short).tolist():
            out[i] = self._composed(data, int(starts[i]), int(ends[i]))
        return out

    def _composed(self, data: np.ndarray, start: int, end: int) -> int:
        """Count of one long span: all chunks step side by side from guessed states, each from the state that its neighbour's last guess
        ends in, until a chain of known map entries leads from the first chunk to the last. A map soon holds the few states
        that occur; every round settles one chunk more at least."""
        begin = np.arange(start, end, SPAN)
        stop = np.minimum(begin + SPAN, end)
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in begin]
        guess = np.zeros(len(begin), np.int64)
        at, state, total = 0, 0, 0  # chunks before ``at`` are settled
        while at < len(begin):
            guess[at] = state
            todo = np.array([i for i in range(at, len(begin)) if int(guess[i]) not in maps[i]], np.int64)
            after, count = self.run(data, begin[todo], stop[todo], guess[todo])
            for i, before, to, n in zip(todo.tolist(), guess[todo].tolist(), after.tolist(), count.tolist(), strict=True):
                maps[i][before] = (to, n)
            ends_in = np.array([maps[i][int(guess[i])][0] for i in range(at, len(begin))], np.int64)
            while at < len(begin) and state in maps[at]:
                state, n = maps[at][state]
                total += n
                at += 1
            guess[len(begin) - len(ends_in) + 1 :] = ends_in[:-1]
        return total

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after and token count of each byte span from a given state, all spans stepping together, the longest first."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        begin, falling = starts[order], -lengths[order]
        state, total = before[order].copy(), np.zeros(len(order), np.int64)
        for j in range(int(-falling[0]) if len(order) else 0):
            n = int(np.searchsorted(falling, -j, side="left"))
            keys = state[:n] * 256 + data[begin[:n] + j]
            value = self.find(keys)
            missing = np.flatnonzero(value < 0)
            if len(missing):
                for key in np.unique(keys[missing]).tolist():
                    self.compile(key >> 8, key & 255)
                value[missing] = self.find(keys[missing])
            total[:n] += (value & 65535) - 32768
            state[:n] = value >> 16
        after, out = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        after[order], out[order] = state, total
        return after, out


@functools.cache
def merger(path: str) -> Merger:
    return Merger(Vocabulary(path))


# ---------------------------------------------------------------- counting


def _special_spans(piece: kernel.Piece, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost non-overlapping occurrences of special strings inside single texts."""
    blob, found = piece.data.tobytes(), []
    for s in specials:
        at = blob.find(s)
        while at >= 0:
            found.append((at, at + len(s)))
            at = blob.find(s, at + 1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, free = [], 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        row = int(piece.owner(np.array([a]))[0])
        if a >= free and b <= piece.offsets[row + 1]:
            kept.append((a, b))
            free = b
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _between_words(data: np.ndarray) -> np.ndarray:
    """Spaces between two ASCII letters: a pre-token begins there, whatever stands around, and no special string runs over it."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    out = np.zeros(len(data), bool)
    out[1:-1] = (data[1:-1] == 32) & letter[:-2] & letter[2:]
    return out


def count_piece(piece: kernel.Piece, path: str) -> np.ndarray:
    """Tokens of every text of a piece; a long text is counted in stretches."""
    machine = merger(path)
    if any(b" " in s for s in machine.vocabulary.specials):
        return _count(piece, machine)
    return sum(_count(p, machine) for _, p in piece.stretches(_between_words))


def _count(piece: kernel.Piece, machine: Merger) -> np.ndarray:
    if not len(piece.data):
        return np.zeros(piece.n, np.int64)
    begin, end = _special_spans(piece, machine.vocabulary.specials)
    points = np.frombuffer(piece.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((piece.data & 0xC0) != 0x80)
    cuts = np.unique(np.concatenate((piece.offsets[:-1], begin, end)))
    cuts = cuts[cuts < len(piece.data)]
    starts = lead[split_bits(symbols(points, np.searchsorted(lead, cuts)))]
    ends = np.concatenate((starts[1:], [len(piece.data)]))
    counts = machine.counts(piece.data, starts, ends)
    owner = piece.owner(starts)
    if len(begin):
        inside = np.searchsorted(begin, starts, side="right") - 1
        counts[(inside >= 0) & (starts < end[np.maximum(inside, 0)])] = 0
    return kernel.count_by(owner, piece.n, counts.astype(float)) + kernel.count_by(piece.owner(begin), piece.n)


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            size, n = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for p in kernel.pieces(column):
                at = slice(p.first, p.first + p.n)
                size[at], n[at] = np.diff(p.offsets), count_piece(p, path)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE_SQL = None
