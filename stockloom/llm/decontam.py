"""Benchmark decontamination by template windows.

Texts are cut into tokens (runs of letters and digits; a point or comma between digits belongs to the number).
Numbers become NUM, a unit right after a number UNIT, a capitalised word within a sentence NAME, every other word stays,
A-Z folded; neighbouring tokens of one type are one slot, so that "Mary Ann" may stand for "Tom". A second template leaves names
as the words they are, for copies whose case differs. Windows of eight template tokens, at least five of
them plain words, are hashed on both sides and joined; an item of four to seven tokens is one window of its own length.
Matching windows of one document and one item on the same diagonal are put together: they must cover half of the item's
tokens, or 13 of them, and each slot value of the item must always stand for one value in the document, so that a
question with other numbers or names is caught and a chance match of templates is not; windows whose slots are
unchanged count whatever the other slots say.

Items of one template with the same slots equal to one another form a class: documents are matched with its smallest item_id, and
``n_items`` says how many there are (``item_classes`` has the members), so a template of many items gives no more rows than one.

The windows of documents that no benchmark window can match are dropped inside the scan by a filter built from
the benchmark's hashes; that filter is used only if the benchmark has at most ``FILTER_WINDOWS`` windows,
otherwise all windows take part in the join.

Edge cases: null or empty texts match nothing; a repeated doc_id or item_id is treated as one; items of fewer than
four tokens or without enough plain words cannot be matched; other columns are ignored. A very long text takes 13 bytes of
memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel, shared
from stockloom.llm.secrets import runs

WINDOW = 8
SHORTEST = 4
SHARE = 0.5
ENOUGH = 13
FILTER_WINDOWS = 1_000_000

#: Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles g gram grams kg kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars usd cent cents euro euros degree degrees mph kmh km/h w kw watt watts v volt volts hz mb gb tb".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = _LOWER[128:] = True
_WORD = _DIGIT | _UPPER | _LOWER
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True


def _hashes_of(words: list[str]) -> np.ndarray:
    piece = next(kernel.pieces(pa.array([" ".join(words)])))
    starts, ends, _ = piece.words()
    return np.sort(piece.hashes(starts, ends, kernel.LOWER_KEYS))


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


#: Marks that end a sentence, between tokens.
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True


def _collapsed(kind: np.ndarray, value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value (0 for plain words) and text of every token, a run of neighbouring slots of one kind being one
    token whose value is the hash of the run."""
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    place = np.arange(len(kind)) - np.repeat(at, np.diff(np.append(at, len(kind))))
    run = np.add.reduceat(value * kernel.WINDOW_KEYS[place % 48], at) if len(at) else value
    slot = kind[at] > 0
    return np.where(slot, kernel.WINDOW_KEYS[50 + kind[at]], value[at]), np.where(slot, kernel.mix(run), np.uint64(0)), owner[at]


def templates(piece: kernel.Piece) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The two templates of the texts, with names as slots and with names as words: template hash, value hash (0 for plain
    words) and text of every token."""
    data = piece.data
    inside = _WORD[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    starts, ends = runs(piece, inside)
    owner = piece.owner(starts)
    if not len(starts):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), owner)] * 2
    value = piece.hashes(starts, ends, kernel.LOWER_KEYS)
    number = _DIGIT[data[starts]] | _member(_NUMBER_HASHES, value)
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1] & (owner[1:] == owner[:-1])
    unit = ~number & after_number & _member(_UNIT_HASHES, value)
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    accented = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    long = ends - starts > np.where(accented, 2, 1)
    third = data[np.minimum(starts + 2, len(data) - 1)]
    stops = np.cumsum(_STOP[data], dtype=np.int32)
    opens = np.ones(len(starts), bool)  # a sentence
    opens[1:] = (owner[1:] != owner[:-1]) | (stops[starts[1:]] > stops[ends[:-1] - 1])
    name = ~number & ~opens & long & ((_UPPER[first] & _LOWER[second]) | (accented & _LOWER[third]))
    return [_collapsed(number * 1 + unit * 2 + name * 3, value, owner), _collapsed(number * 1 + unit * 2, value, owner)]


def template_windows(piece: kernel.Piece, sizes: list[int]) -> Iterator[tuple]:
    """For each template and size: (mode, size, hashes, first tokens within their texts, owners, value hashes of all tokens,
    first tokens)."""
    for mode, (shape, value, owner) in enumerate(templates(piece)):
        begin = np.searchsorted(owner, np.arange(piece.n + 1))
        for size in sizes:
            hashes, first = kernel.windows(shape, owner, size)
            hashes = hashes ^ np.uint64(size + 64 * mode)
            yield mode, size, hashes, first - begin[owner[first]], owner[first], value, first


SCHEMA = "{id} long, mode int, size int, hash long, at int, slots array<long>"


def windows(table: DataFrame, column: str, sizes: list[int], keep: np.ndarray | None) -> DataFrame:
    """id, mode, size, hash, at, slots; only hashes in ``keep`` where given."""
    bits = None
    if keep is not None:
        bits = np.zeros(1 << 20, bool)
        bits[(keep >> np.uint64(44)).astype(np.int64)] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            for p in kernel.pieces(batch.column("text")):
                for mode, size, hashes, at, owner, value, first in template_windows(p, sizes):
                    pick = np.arange(len(hashes))
                    if bits is not None:
                        pick = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
                        pick = pick[_member(keep, hashes[pick])]
                    if not len(pick):
                        continue
                    slots = np.stack([value[first[pick] + j] for j in range(size)], axis=1).view(np.int64)
                    lists = pa.ListArray.from_arrays(np.arange(0, (len(pick) + 1) * size, size, dtype=np.int32), pa.array(slots.ravel()))
                    arrays = [ids.take(pa.array(owner[pick] + p.first)), pa.array(np.full(len(pick), mode, np.int32)), pa.array(np.full(len(pick), size, np.int32)), pa.array(hashes[pick].view(np.int64)), pa.array(at[pick].astype(np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(arrays, [column, "mode", "size", "hash", "at", "slots"])

    source = table.select(F.col(column).cast("long").alias(column), F.col("text").cast("string").alias("text")).where(F.col(column).isNotNull())
    return source.mapInArrow(rows, SCHEMA.format(id=column))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id, mode, tokens (of the template), leader (the smallest item_id with the same template and the same slots equal to
    one another), n_items (how many those are). Of several texts of one item_id the one with the longest template counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("item_id").to_pylist()
            for p in kernel.pieces(batch.column("text")):
                for mode, (shape, value, owner) in enumerate(templates(p)):
                    begin = np.searchsorted(owner, np.arange(p.n + 1))
                    for i in range(p.n):
                        at = slice(begin[i], begin[i + 1])
                        slots = value[at]
                        known, number = np.unique(slots[slots > 0], return_inverse=True)
                        order = np.argsort(np.argsort([int(np.flatnonzero(number == k)[0]) for k in range(len(known))])) if len(known) else number
                        pattern = order[number] if len(known) else number
                        digest = hashlib.sha256(shape[at].tobytes() + b"|" + pattern.astype(np.int64).tobytes()).hexdigest()[:32]
                        out.append((ids[p.first + i], mode, int(begin[i + 1] - begin[i]), digest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["item_id", "mode", "tokens", "digest"])

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    found = source.mapInArrow(rows, "item_id long, mode int, tokens long, digest string").groupBy("item_id", "mode").agg(F.max(F.struct("tokens", "digest")).alias("x"))
    flat = shared.written(found.select("item_id", "mode", "x.tokens", "x.digest"))
    led = flat.groupBy("mode", "digest").agg(F.min("item_id").alias("leader"), F.count("*").alias("n_items"))
    return flat.join(led, ["mode", "digest"]).select("item_id", "mode", "tokens", "leader", "n_items")


def matches(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """One row per contaminated document and class of items (doc_id, item_id of its leader): covered (tokens of the item), tokens (its length), n_slots (distinct
    slot values covered), changed (slot values that differ in the document), n_items (items of that class)."""
    classes = shared.written(item_classes(benchmark))
    leaders = classes.where("item_id = leader").select("item_id", "mode", "tokens", "n_items")
    sizes = list(range(SHORTEST, WINDOW + 1))
    plain = F.size(F.filter("slots", lambda v: v == 0))
    fits = (F.col("size") == F.least(F.col("tokens"), F.lit(WINDOW))) & (plain * 8 >= F.col("size") * 5)
    items = shared.written(windows(benchmark, "item_id", sizes, None).join(leaders, ["item_id", "mode"]).where(fits).dropDuplicates(["item_id", "mode", "size", "hash", "at"]))
    keep = None
    if items.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS:
        got = items.select("size", "hash").distinct().toPandas()  # at most FILTER_WINDOWS rows
        keep = np.sort(got["hash"].to_numpy(np.int64).view(np.uint64))
        sizes = sorted(got["size"].unique().tolist())
    found = windows(documents, "doc_id", sizes, keep).withColumnRenamed("at", "doc_at").withColumnRenamed("slots", "doc_slots")
    met = found.join(items, ["mode", "size", "hash"])
    span = F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)
    pairs = F.filter(F.zip_with("slots", "doc_slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda x: x["item"] != 0)
    same = F.when(F.col("slots") == F.col("doc_slots"), span)
    whole = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731  within one item
    runs_ = met.groupBy("doc_id", "item_id", "mode", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.max("tokens").alias("tokens"), F.max("n_items").alias("n_items"), F.size(whole(span)).cast("long").alias("covered"), F.size(whole(same)).cast("long").alias("unchanged"), whole(pairs).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x["item"]))
    reaches = lambda c: (F.col(c) >= share * F.col("tokens")) | (F.col(c) >= enough)
    consistent = F.size("pairs") == F.size(values)
    changed = F.size(F.filter("pairs", lambda x: x["item"] != x["doc"])).cast("long")
    good = runs_.where(reaches("covered") & (consistent | reaches("unchanged"))).select("doc_id", "item_id", "covered", "tokens", F.size(values).cast("long").alias("n_slots"), changed.alias("changed"), "n_items")
    best = F.max(F.struct("covered", "tokens", "n_slots", "changed", "n_items")).alias("best")
    led = classes.where("mode = 0").select("item_id", "leader", F.col("n_items").alias("of_class"))
    named = good.join(led, "item_id").select("doc_id", F.col("leader").alias("item_id"), "covered", "tokens", "n_slots", "changed", F.col("of_class").alias("n_items"))
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that match no item; all columns. Rows are known by a hash of doc_id and text, so of several texts of one doc_id
    only the dirty ones go, and rows without a doc_id are checked as well."""
    keyed = documents.withColumn("__loom_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = matches(keyed.select(F.col("__loom_key").alias("doc_id"), "text"), benchmark, **options)
    dirty = shared.written(found.select(F.col("doc_id").alias("__loom_key")).distinct())
    return shared.join_ids(keyed, dirty, "__loom_key", "left_anti").select(*documents.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))


ORACLE_SQL = None
