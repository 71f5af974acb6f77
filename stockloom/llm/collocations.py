"""Phrase collocations: an FM-index over word ids for each shard, extended interval by interval, sums across shards.

Texts (A-Z folded) are cut at sentence marks and line ends into stretches; a shard is up to half a million words of one language, its words
numbered, with zeros between stretches. ``Index`` holds the Burrows-Wheeler transforms of a shard and of its reverse, sorted as deep as the
phrases are long. An interval of suffixes that begin with a phrase is extended by every word that stands to its left or right, which
narrows both intervals together (``Index.extend``), and the number of rows of an extension is its count in the shard.

Lengths are mined one after the other, so that nothing is enumerated that cannot be frequent: the shards' counts of a length are summed
by Spark, sums below the floor go, and the survivors are joined back to their shards, which keep only stretches whose phrases of that
length all survived (longer phrases of the floor's frequency lie in such stretches). The floor is on whole sums; a shard drops nothing
by its own counts. Phrases are known by their first words' number and their last word's number, dense over the whole corpus, so
shuffled rows are four integers. A shard lies in its table as one row of words and, after it, a row for each of its phrases; its survivors
come to it as rows in that order as well, so no JVM task holds more of a shard than a batch of rows, and a worker no more than one shard.

Edge cases: null text counts as empty, null lang as ``und``; rows that repeat a doc_id count each; ties in rank go by count, then by the
phrase's bytes; an empty table gives an empty result; other columns are ignored. A text without any sentence mark or line end is held
in one task as arrays (30 bytes a letter); others are worked in parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions.ordered import numbered
from stockloom.llm import kernel, shared

LONGEST, FLOOR, TOP = 5, 100, 2000
#: Words of a shard; words of all languages that a task holds before it gives off the largest of them.
SHARD_WORDS, HELD_WORDS = 1 << 19, 1 << 20
#: Ids of phrases joined back by a broadcast at most; beyond, by a shuffle.
BROADCAST_PHRASES = 1 << 20
UND = "und"
#: Tables of shards hold numbers and words that hardly repeat; a task holds one group of their rows.
TABLE = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 25)}
#: Rows of a batch that a worker gives off.
BATCH = 1 << 16

BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------- the index of a shard


class Half:
    """The Burrows-Wheeler transform of a sequence (zeros are breaks, one at either end), its suffixes sorted by ``depth`` words."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        rank, top = words.astype(np.int64), int(words.max(initial=0)) + 1
        for j in range(1, depth):
            rank = np.unique(rank * top + np.concatenate((words[j:], np.zeros(j, words.dtype))), return_inverse=True)[1]
        self.order = np.argsort(rank, kind="stable")
        self.before = words[self.order - 1]  # of the first suffix the last word, a break as well
        by_word = np.argsort(self.before, kind="stable")
        self.moved = np.empty(len(words), np.int64)
        self.moved[by_word] = np.arange(len(words))  # where the suffix one word longer stands: words before it, and the same word above


class Index:
    """Both directions of a shard; intervals of a phrase in the two are kept in step."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        self.words, self.n, self.depth, self.top = words, len(words), depth, int(words.max(initial=0)) + 1
        self.halves: dict[str, Half] = {}

    def half(self, side: str) -> Half:
        """``left``: suffixes and the word before them; ``right``: the same of the reversed words."""
        if side not in self.halves:
            self.halves[side] = Half(self.words if side == "left" else self.words[::-1], self.depth)
        return self.halves[side]

    def single(self) -> dict[str, np.ndarray]:
        """Intervals of all single words."""
        counts = np.bincount(self.words, minlength=self.top)
        ends = np.cumsum(counts)
        there = np.flatnonzero(counts[1:]) + 1
        start = ends[there] - counts[there]
        return {"left": start, "right": start.copy(), "count": counts[there]}

    def extend(self, intervals: dict[str, np.ndarray], side: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """All extensions by one word: their intervals, and each suffix row that has one with the number of its extension."""
        half, other, count = self.half(side), "right" if side == "left" else "left", intervals["count"]
        upto = np.cumsum(count)
        rows = np.repeat(intervals[side] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
        parent, word = np.repeat(np.arange(len(count)), count), half.before[rows]
        zeros = np.bincount(parent, weights=word == 0, minlength=len(count)).astype(np.int64)
        real = word > 0
        rows, keys = rows[real], parent[real] * self.top + word[real]
        keys, first, number, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        of = keys // self.top
        total = np.cumsum(size) - size
        head = np.ones(len(of), bool)
        head[1:] = of[1:] != of[:-1]
        smaller = total - np.repeat(total[head], np.diff(np.append(np.flatnonzero(head), len(of)))) if len(of) else total
        out = {side: half.moved[rows[first]], other: intervals[other][of] + zeros[of] + smaller, "count": size, "of": of, "word": keys % self.top}
        return out, rows, number


def phrases(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All phrases of a length in a shard: for each place of the shard the number of the phrase that begins there (-1: none), for each
    number one place where it begins, and its count. Phrases grow by a word to the left, then to the right, in turn."""
    at = np.full(len(words), -1, np.int64)
    if not (words > 0).any():
        return at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = Index(words, max(1, length - 1))
    intervals = index.single()
    for step in range(length - 2):
        intervals, _, _ = index.extend(intervals, "left" if (length - step) % 2 else "right")
    intervals, rows, number = index.extend(intervals, "right")
    places = index.n + 1 - length - index.half("right").order[rows]  # of the reversed last word but one
    at[places] = number
    place = np.empty(len(intervals["count"]), np.int64)
    place[number] = places
    return at, place, intervals["count"]


# ---------------------------------------------------------------- shards


def _low(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _may_cut(data: np.ndarray) -> np.ndarray:
    return BREAK[data]


def _stretches(piece: kernel.Piece) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a piece, whether each is the first of a stretch, and the text each stands in."""
    data = piece.data
    inside = ~(BLANK | BREAK)[data]
    begins = np.zeros(len(data), bool)
    begins[piece.offsets[:-1][piece.offsets[:-1] < len(data)]] = True
    new = inside & (begins | ~np.concatenate(([False], inside[:-1])))
    starts = np.flatnonzero(new)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    cuts = np.cumsum(BREAK[data] | begins)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = cuts[1:] != cuts[:-1]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_low(data[inside]))])
    return words, first, piece.owner(starts)


#: A shard: the row of slot -1 has its words (and the ids of words, ``gids``), that of slot i its phrase number i.
SHARD = "lang string, shard long, slot int, words binary, gids binary, name string, first long, last long, count long"
KINDS = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("slot", pa.int32()), ("words", pa.binary()), ("gids", pa.binary()), ("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("count", pa.int64())])


def _packed(numbers: np.ndarray) -> bytes:
    """Their count and, compressed, the bytes of the numbers: all lowest ones first, then the next."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b"")


def _numbers(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def _rows(lang: str, shard: int, words: np.ndarray, gids: np.ndarray, **phrases: pa.Array) -> Iterator[pa.RecordBatch]:
    """A shard's words, then its phrases: their names, or their first words and last word, and their counts."""

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        columns |= {"lang": pa.repeat(lang, n), "shard": pa.repeat(pa.scalar(shard, pa.int64()), n)}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in KINDS], schema=KINDS)

    yield batch(1, slot=pa.array([-1]), words=pa.array([_packed(words)]), gids=pa.array([_packed(gids)]))
    for at in range(0, len(phrases["count"]), BATCH):
        part = {k: v.slice(at, BATCH) for k, v in phrases.items()}
        n = len(part["count"])
        yield batch(n, slot=pa.array(np.arange(at, at + n)), **part)


def _with_breaks(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers with a zero before each first one and at the end."""
    out = np.zeros(len(numbers) + int(first.sum()) + 1, numbers.dtype)
    out[np.arange(len(numbers)) + np.cumsum(first)] = numbers
    return out


def _give_back() -> None:
    """What a shard took, at once: a worker lives on beside the JVM of later stages."""
    pa.default_memory_pool().release_unused()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's texts, with their single words."""
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    new = itertools.count(TaskContext.get().partitionId() << 32)

    def given(lang: str) -> Iterator[pa.RecordBatch]:
        parts = held.pop(lang)
        sizes.pop(lang)
        coded = pa.chunked_array([w for w, _ in parts]).combine_chunks().dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        words = _with_breaks(numbers + 1, np.concatenate([f for _, f in parts]))
        yield from _rows(lang, next(new), words, np.zeros(0, np.int64), name=coded.dictionary, count=pa.array(np.bincount(numbers, minlength=len(coded.dictionary))))
        _give_back()

    for b in batches:
        langs = b.column("lang").to_pylist()
        for whole in kernel.pieces(b.column("text")):
            for _, piece in whole.stretches(_may_cut):
                words, first, owner = _stretches(piece)
                of = np.array(langs[whole.first : whole.first + whole.n])
                for lang in dict.fromkeys(of.tolist()):
                    mine = np.flatnonzero(of[owner] == lang)
                    if len(mine):
                        held.setdefault(lang, []).append((words.take(pa.array(mine)), first[mine]))
                        sizes[lang] = sizes.get(lang, 0) + len(mine)
                        if sizes[lang] >= SHARD_WORDS:
                            yield from given(lang)
            if sum(sizes.values()) >= HELD_WORDS:
                yield from given(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from given(lang)


PACKS = "shard long, slot int, slots array<int>, ids array<long>"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The survivors (those with an id) of a batch of shard, slot, id, a row for each shard there, with one of its slots."""
    for b in batches:
        b = b.filter(b.column("id").is_valid())
        order = np.argsort(b.column("shard").to_numpy(), kind="stable")
        shard, slot, id_ = (b.column(c).to_numpy()[order] for c in ("shard", "slot", "id"))
        head = np.flatnonzero(np.diff(shard, prepend=-1))
        offsets = pa.array(np.append(head, len(shard)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(shard[head]), pa.array(slot[head]), pa.ListArray.from_arrays(offsets, pa.array(slot)), pa.ListArray.from_arrays(offsets, pa.array(id_))], ["shard", "slot", "slots", "ids"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bytes, np.ndarray, np.ndarray]]:
    """One shard after the other, of rows in order of shard and slot: lang, shard, words, gids, and slots and ids of its survivors."""
    head, slots, ids = None, [], []
    for b in batches:
        slot = b.column("slot").to_numpy()
        for begin, end in itertools.pairwise([0, *np.flatnonzero(slot < 0).tolist(), len(slot)]):
            if begin < end and slot[begin] < 0:
                if head:
                    yield *head, np.concatenate(slots), np.concatenate(ids)
                head, slots, ids = tuple(b.column(c)[begin].as_py() for c in ("lang", "shard", "words", "gids")), [], []
            slots.append(b.column("slots").slice(begin, end - begin).flatten().to_numpy().astype(np.int64))
            ids.append(b.column("ids").slice(begin, end - begin).flatten().to_numpy().astype(np.int64))
    if head:
        yield *head, np.concatenate(slots), np.concatenate(ids)


def _step(length: int):
    """From shards with numbered phrases of ``length - 1`` words and the survivors among them, to their phrases of ``length`` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard, words, gids, alive, named in _told(batches):
            words = _numbers(words)
            if length > 2:  # numbered anew, as they were; that takes less than to keep and to move a number for every place
                slots, gids = phrases(words, length - 1)[0], _numbers(gids)
            else:
                slots = words - 1
            ids = np.zeros(int(slots.max(initial=0)) + 2, np.int64)  # the last stands for none
            ids[alive] = named
            here = ids[slots]
            if length == 2:  # words are numbered by their ids from now on, the break first
                gids, words = np.unique(here, return_inverse=True)
                gids, words = (gids, words) if len(gids) and gids[0] == 0 else (np.append(0, gids), words + 1)
            kept = np.flatnonzero(here > 0)  # a stretch of them, and the words of the last one
            pair = np.zeros(len(here) + 1, bool)
            pair[kept] = True
            pair = pair[:-1] & (pair[1:] | np.concatenate(([False], pair[:-2])))  # alone, none of them grows
            kept = np.flatnonzero(pair)
            first = np.ones(len(kept), bool)
            first[1:] = np.diff(kept) > 1
            last = np.append(first[1:], True)[: len(kept)]
            lengths = np.where(last, length - 1, 1)
            upto = np.cumsum(lengths)
            source = np.repeat(kept - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)
            begins = np.zeros(len(source), bool)
            begins[(upto - lengths)[first]] = True
            used, local = np.unique(words[source], return_inverse=True)
            whole = np.zeros(len(source), np.int64)
            whole[upto - lengths] = here[kept]
            text, prefix = _with_breaks(local + 1, begins), _with_breaks(whole, begins)
            _, place, count = phrases(text, length)
            gids = np.append(0, gids[used])
            del slots, alive, named, ids, here, kept, source, local, whole, words
            yield from _rows(lang, shard, text, gids, first=pa.array(prefix[place]), last=pa.array(gids[text[place + length - 1]]), count=pa.array(count))
            del text, prefix, place, count, gids
            _give_back()

    return rows


# ---------------------------------------------------------------- phrases


def _joined_back(level: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """Each shard's words, and after them slots and ids of the survivors among its phrases, as rows in that order. A row has those of
    a batch at most."""
    told = shared.join_ids(level.where("slot >= 0").select("shard", "slot", *on), kept, on, "left", BROADCAST_PHRASES)
    alive = told.select("shard", "slot", "id").mapInArrow(_packs, PACKS)
    both = level.where("slot < 0").select("shard", "slot", "lang", "words", "gids").unionByName(alive, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", "slot")


def frequent(documents: DataFrame, longest: int = LONGEST, floor: int = FLOOR) -> DataFrame:
    """lang, phrase, size (words), f: all phrases of up to ``longest`` words with at least ``floor`` occurrences in their language, and
    one row per language of size 0 with the number of its words."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shared.written(docs.mapInArrow(_shards, SHARD), **TABLE)
    level, tables, old, out = shards, [], [shards], None
    for size in range(1, longest + 1):
        key = ["lang", "name"] if size == 1 else ["first", "last"]  # an id is of one language
        rows = level.where("slot >= 0")
        sums = rows.groupBy(*key).agg(F.sum("count").alias("f"))
        if size == 1:
            words = rows.groupBy("lang").agg(F.sum("count").alias("f"))
            tables.append(shared.written(words.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("size"), "f")))
        kept = shared.written(numbered(shared.written(sums.where(F.col("f") >= floor)), [F.col(k) for k in key], "id"))
        if size == 1:
            names = kept.select("id", "lang", F.col("name").alias("phrase"), "f")
            single = names
        else:
            names = kept.join(out.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("__head")), "first").join(single.select(F.col("id").alias("last"), F.col("phrase").alias("__tail")), "last")
            names = shared.written(names.select("id", "lang", F.concat_ws(" ", "__head", "__tail").alias("phrase"), "f"))
        out = names
        tables.append(out.select("lang", "phrase", F.lit(size).alias("size"), "f"))
        if size == longest:
            break
        level = shared.written(_joined_back(level, kept.select(*key, "id"), key).mapInArrow(_step(size + 1), SHARD), **TABLE)
        shared.discard(old.pop())
        old.append(level)
    shared.discard(level)
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def collocations(documents: DataFrame, longest: int = LONGEST, floor: int = FLOOR, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their lowest cut; a phrase that
    only ever stands inside a longer one is left out."""
    f = shared.written(frequent(documents, longest, floor))
    asked = f.where("size > 1")
    split = asked.withColumn("w", F.split("phrase", " ", -1)).select("lang", "phrase", "size", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    parts = split.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("tail"))
    part = f.where("size > 0")
    both = parts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    total = f.where("size = 0").select("lang", F.col("f").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.join(total, "lang").withColumn("top", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(22,0)") * wide("n")).withColumn("base", wide("l") * wide("r"))
    scored = scored.select("lang", "phrase", "a", "cut", "l", "r", "n", F.expr("top div base").alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    # An extension by one word with all the occurrences of a phrase exists wherever a longer phrase with all of them does.
    longer = asked.where("size > 2").withColumn("w", F.split("phrase", " ", -1))
    inner = longer.select("lang", F.col("f").alias("outer"), F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    free = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < 100 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 100),
n AS MATERIALIZED (SELECT lang, SUM(len(w))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n,
             (1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
             JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM y),
d AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON b.lang = s.lang AND b.k > s.k AND 100 * b.a >= 100 * s.a
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
r AS (SELECT z.*, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM z WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = z.lang AND d.phrase = z.phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""
