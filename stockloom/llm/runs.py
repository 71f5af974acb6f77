"""Periodic run detection over the words of a text.

A run is a stretch of words with smallest period q (words q apart are the same) and at least four times q and six words long that no
neighbouring word extends. Every run of period q covers three neighbouring points of the harmonic grid q, 2q, 3q, ..., where words q
apart agree; each such point is extended both ways by longest common extensions (LCE), and runs are told apart by their ends.

LCE of two places: only suffixes that begin at a difference cover modulo 13 are sorted (by their first 13 words, then by doubling).
For any two places some shift below 13 brings both onto the cover, so an LCE compares fewer than 13 words and then asks a sparse
table of minima over the common prefixes of neighbouring sampled suffixes. A second index over the reversed words extends to the left.

Texts of a task are worked in pieces of a few hundred KB, all texts of a piece at once; between two texts stands a word of its own.
One text is never split: for n words the grid takes n log n comparisons, and texts with a grid hit about 60 bytes of memory a word.

Edge cases: null and empty texts have no words and no runs; rows that repeat a doc_id each give a row; a null doc_id is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel, shared

EXPONENT, SHORTEST = 4, 6
#: A perfect difference set: every distance modulo 13 lies between two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: For each distance modulo MODULUS the member from which it leads to another member.
ANCHOR = np.array([next(a for a in COVER if (a + d) % MODULUS in COVER) for d in range(MODULUS)])
PIECE_BYTES = 1 << 21
#: LCE queries answered at once.
QUERIES = 1 << 18
RUN = "array<struct<start: long, length: long, period: long>>"


class Extensions:
    """Longest common extensions to the right between any two places of a sequence of small integers."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.words = np.concatenate((words, np.full(2 * MODULUS, -1, words.dtype)))  # an end that equals only itself
        places = np.arange(self.n)
        self.places = places[np.isin(places % MODULUS, COVER)]
        self.at = np.full(self.n + 1, -1, np.int64)  # sample number of a place
        self.at[self.places] = np.arange(len(self.places))
        self._levels()
        order = np.argsort(self.levels[-1], kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self._minima(self._common(self.places[order[:-1]], self.places[order[1:]]) if len(order) > 1 else np.zeros(0, np.int64))

    def _levels(self) -> None:
        """Ranks of the sampled suffixes by their first 13, 26, 52, ... words, until all differ."""
        window = self.words[self.places[:, None] + np.arange(MODULUS)]
        order = np.lexsort(self._packed(window)) if len(self.places) else np.zeros(0, np.int64)
        rank = np.zeros(len(order), np.int64)
        rank[order[1:]] = np.cumsum((window[order[1:]] != window[order[:-1]]).any(axis=1))
        self.levels, self.widths, width = [rank], [MODULUS], MODULUS
        while len(rank) and int(rank.max()) + 1 < len(rank) and width < self.n:
            after = np.minimum(self.places + width, self.n)
            second = np.where(after < self.n, rank[self.at[after]] + 1, 0)  # a shift by a multiple of 13 stays on the cover
            _, rank = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)
            width *= 2
            self.levels.append(rank)
            self.widths.append(width)

    @staticmethod
    def _packed(window: np.ndarray) -> list[np.ndarray]:
        """Columns of a window put together, as many as fit in 63 bits, the last sort key first."""
        low = int(window.min())
        bits = max(1, (int(window.max()) - low).bit_length())
        each, keys = max(1, 63 // bits), []
        for a in range(0, window.shape[1], each):
            key = np.zeros(len(window), np.int64)
            for j in range(a, min(a + each, window.shape[1])):
                key = (key << bits) | (window[:, j].astype(np.int64) - low)
            keys.append(key)
        return keys[::-1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes: the widest equal blocks first, then word by word."""
        total = np.zeros(len(a), np.int64)
        for rank, width in zip(reversed(self.levels), reversed(self.widths), strict=True):
            inside = (a + total < self.n) & (b + total < self.n)
            x, y = self.at[np.where(inside, a + total, self.n)], self.at[np.where(inside, b + total, self.n)]
            total += np.where(inside & (rank[x] == rank[y]), width, 0)
        return np.minimum(total + self._direct(np.minimum(a + total, self.n), np.minimum(b + total, self.n)), self.n - np.maximum(a, b))

    def _direct(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the next 13 words are the same."""
        out = np.zeros(len(a), np.int64)
        going = np.ones(len(a), bool)
        for j in range(MODULUS):
            going &= self.words[a + j] == self.words[b + j]
            out += going
        return out

    def _minima(self, common: np.ndarray) -> None:
        self.table = [common]
        while len(self.table[-1]) > (half := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from two different places on."""
        shift = (ANCHOR[(j - i) % MODULUS] - i) % MODULUS
        out = np.minimum(self._direct(i, j), shift)
        more = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        a, b = self.rank[self.at[i[more] + shift[more]]], self.rank[self.at[j[more] + shift[more]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(more), np.int64)
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            least[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        out[more] += least
        return np.minimum(out, self.n - np.maximum(i, j))


def grid_hits(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid points from which three steps of the period find the same word. Texts stand in ``words`` from long
    to short, so that a period looks only at those long enough for it; ends: where each of them ends."""
    places, periods = [], []
    for p in range(1, int(lengths.max(initial=0)) // EXPONENT + 1):
        upto = int(ends[np.searchsorted(-lengths, -max(SHORTEST, EXPONENT * p), side="right") - 1]) if lengths[0] >= max(SHORTEST, EXPONENT * p) else 0
        x = words[:upto:p]
        same = x[1:] == x[:-1]
        hit = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(hit):
            places.append(hit * p)
            periods.append(np.full(len(hit), p))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each text (an array of word numbers): rows of start, length, period in order of start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    words, begins, ends = _laid_out([texts[i] for i in order])
    place, _ = grid_hits(words, ends, lengths[order]) if len(texts) else (np.zeros(0, np.int64), None)
    hit = np.unique(np.searchsorted(begins, place, side="right") - 1)  # only texts with a hit are indexed
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    if not len(hit):
        return out
    order = order[hit]
    words, begins, ends = _laid_out([texts[i] for i in order])
    place, period = grid_hits(words, ends, lengths[order])
    right, left, n, found = Extensions(words), Extensions(words[::-1].copy()), len(words), []
    for a in range(0, len(place), QUERIES):
        i, p = place[a : a + QUERIES], period[a : a + QUERIES]
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = left(n - i[inner], n - i[inner] - p[inner])
        start, length = i - back, back + p + right(i, i + p)
        ok = length >= np.maximum(SHORTEST, EXPONENT * p)
        found.append(np.unique(np.stack((start[ok], length[ok], p[ok]), axis=1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of equal stretches the smallest period; the others are its multiples
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows[:, 0] -= begins[owner]
    for k in np.unique(owner).tolist():
        out[order[k]] = rows[owner == k]
    return out


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, behind each of them a word that nothing else equals; where each begins and ends."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    words = np.empty(int((lengths + 1).sum()), np.int64)
    for t, e in zip(texts, ends.tolist(), strict=True):
        words[e - len(t) : e] = t
    words[ends] = -2 - np.arange(len(texts))
    return words, ends - lengths, ends


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _words_of(piece: kernel.Piece) -> tuple[pa.Array, np.ndarray]:
    """The words of a piece as one Arrow array, and where each text's words begin in it."""
    starts, ends, owner = piece.words()
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = piece.data[~kernel.IS_SPACE[piece.data]]
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters))
    return array, np.searchsorted(owner, np.arange(piece.n + 1))


def periodic_runs(documents: DataFrame, rewritten: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period by start, then period; words count from 0), collapsed
    (the text without the words that some run contains after its first period, joined by single spaces).

    ``rewritten`` (doc_id, number of words -> for each word the word that stands there instead, or None) plants repetitions first.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for piece in kernel.pieces(b.column("text"), PIECE_BYTES):
                words, begin = _words_of(piece)
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                doc_ids, stands = ids.slice(piece.first, piece.n), np.arange(len(words))
                for k, doc_id in enumerate(doc_ids.to_pylist() if rewritten else []):
                    moved = rewritten(doc_id, int(begin[k + 1] - begin[k]))
                    if moved is not None:
                        stands[begin[k] : begin[k + 1]] = begin[k] + moved
                numbers = numbers[stands]
                runs = find_runs([numbers[a:z] for a, z in zip(begin, begin[1:], strict=False)])
                gone = [dropped(int(z - a), r) for a, z, r in zip(begin, begin[1:], runs, strict=False)]
                keep = ~np.concatenate(gone)
                upto = np.concatenate(([0], np.cumsum(keep)))[begin]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.take(pa.array(stands[keep]))), " ")
                flat, upto = np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs])))
                cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(begin)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), cells), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return shared.texts(documents).mapInArrow(rows, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The repetitions that the contract of the query plants in a tenth of the documents; none for a null doc_id."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_runs, start, length, period and exponent_milli of the run that repeats most (nulls without a run),
    runs_sha256, collapsed_sha256."""
    found = periodic_runs(shared.read(spark, sf_dir, "documents"), planted)
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  exact; runs are in order of start, then period
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda top, x: F.when(more(x, top), x).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE_SQL = None
