"""Line dedup by overlapping three-line windows.

Lines that hold a word are numbered within their document. Every three consecutive ones form a window,
hashed to 128 bits. A window that occurs more than once anywhere keeps its first occurrence (smallest
doc_id, then position); the lines of every later occurrence are covered, and overlapping windows merge
into one covered stretch. Covered lines are removed; all others, blank ones included, stay as they are.

Windows are counted with partial aggregation; only hashes that occur twice meet their windows again, in a
join that adaptive execution can split for a hot hash. Positions are gathered per document (never per hash).

Edge cases: null and empty texts, and documents of fewer than three such lines, stay unchanged; rows are known by doc_id and
a digest of their text, so different texts of one doc_id are deduplicated apart (in order of the digest) and equal rows
all keep what the first of them keeps; a null doc_id comes before all others; lines are compared without surrounding
white space; a document whose lines are all covered keeps an empty text.

``dedup_passages`` (the pipeline's form) finds repeats that do not stand on three whole lines as well. Runs of ``GRAM``
words are hashed to 128 bits, and of every ``REACH`` neighbouring runs the one with the least hash is kept, wherever its
text stands; so two places that share ``GRAM + REACH - 1`` = 50 words share a kept run. The first and last runs of a text
and of a line of 50 words or more are kept besides, and a text of fewer than ``GRAM`` words is one run. Words of later
occurrences are removed; up to ``REACH - 1`` words at either edge of a passage within other text stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockloom.llm import kernel, shared

SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
WINDOW = 3
GRAM, REACH = 36, 15


def _lines(text: F.Column) -> F.Column:
    """(i, line) of the lines that hold a word; i is the place among all lines."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, SPACE, "").alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def _tag() -> F.Column:
    """60 bits of the text's digest: with doc_id, what a row is known by."""
    return F.conv(F.substring(F.md5(F.col("text").cast("string")), 1, 15), 16, 10).cast("long")


def _tagged(documents: DataFrame) -> DataFrame:
    return shared.texts(documents).where("text is not null").withColumn("tag", _tag())


def _later(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places (doc_id, tag, at) of repeated hashes that are not the first of their hash; and the written table of those hashes."""
    spot = F.struct("doc_id", "tag", "at")
    counted = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(spot).alias("first"))
    repeated = shared.written(counted.where("n > 1").drop("n"))
    return found.join(repeated.hint("merge"), ["h1", "h2"]).where(spot > F.col("first")), repeated


def windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, tag, at (place of the window's first line among those with a word), places (of its lines), h1, h2."""
    lines = _tagged(documents).select("doc_id", "tag", _lines(F.col("text")).alias("lines")).where(F.size("lines") >= size)

    def window(at: F.Column) -> F.Column:
        here = [F.get("lines", at + j) for j in range(size)]
        words = [x["line"] for x in here]
        return F.struct(at.alias("at"), F.array(*[x["i"] for x in here]).alias("places"), F.xxhash64(*words).alias("h1"), F.xxhash64(F.lit(7), *reversed(words)).alias("h2"))

    starts = F.sequence(F.lit(0), F.size("lines") - size)
    return lines.select("doc_id", "tag", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "tag", "w.*")


def covered(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, tag, covered: places of the lines that later occurrences of repeated windows cover."""
    found = shared.written(windows(documents, size))
    later, repeated = _later(found)
    places = F.array_distinct(F.flatten(F.collect_set("places")))  # of one text, however often its row repeats
    out = shared.written(later.groupBy("doc_id", "tag").agg(places.alias("covered")))
    shared.discard(found, repeated)
    return out


def _with_hits(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents with the columns of hits (doc_id, tag, ...) beside them, null where a row has none."""
    mine = hits.withColumnsRenamed({"doc_id": "__loom_id", "tag": "__loom_tag"}).hint("merge")
    return documents.join(mine, F.col("doc_id").cast("long").eqNullSafe(F.col("__loom_id")) & (_tag() == F.col("__loom_tag")), "left")


def dedup(documents: DataFrame, size: int = WINDOW, counts: bool = True) -> DataFrame:
    """The documents' own columns with covered lines removed from text (and n_chars, if there, made to fit); with ``counts`` also n_lines (with a word) and n_removed."""
    hit = _with_hits(documents, covered(documents, size).withColumnRenamed("covered", "__loom_covered"))
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__loom_covered")), lambda i: F.get(lines, i))
    text = F.when(F.col("__loom_covered").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("__loom_covered").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(documents.dtypes)["n_chars"])
    own = [new.get(c, F.col(c)).alias(c) for c in documents.columns]
    if not counts:
        return hit.select(*own)
    n_lines = F.size(F.filter(F.coalesce(lines, F.array()), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return hit.select(*own, n_lines.cast("long").alias("n_lines"), F.when(F.col("__loom_covered").isNull(), 0).otherwise(F.size("__loom_covered")).cast("long").alias("n_removed"))


def _runs(piece: kernel.Piece) -> tuple[np.ndarray, ...]:
    """Owner, at (word within the text), n (words), h1, h2 of the kept runs of a piece."""
    starts, ends, owner = piece.words()
    up, down = kernel._POWERS.upto(len(starts) + 1)

    def hasher(keys: np.ndarray):
        sums = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(piece.hashes(starts, ends, keys) * up[:-1], dtype=np.uint64, out=sums[1:])
        return lambda a, n: kernel.mix((sums[a + n] - sums[a]) * down[a])

    one, two = hasher(kernel.BYTE_KEYS), hasher(kernel.BYTE_KEYS[::-1].copy())
    begin = np.searchsorted(owner, np.arange(piece.n + 1))
    n_words = np.diff(begin)
    first = np.flatnonzero(np.arange(len(starts)) + GRAM <= begin[1:][owner]) if len(starts) else np.zeros(0, np.int64)
    # least of every REACH neighbours; REACH - 1 blanks between texts make the first and last run of a text least of some
    place = np.arange(len(first)) + (REACH - 1) * (owner[first] + 1)
    wide = np.full(len(first) + (REACH - 1) * (piece.n + 1), np.iinfo(np.uint64).max)
    wide[place] = one(first, GRAM)
    least = wide[: len(wide) - REACH + 1].copy()
    for j in range(1, REACH):
        np.minimum(least, wide[j : len(wide) - REACH + 1 + j], out=least)
    kept = np.zeros(len(first), bool)
    for j in range(REACH):
        kept |= least[place - j] == wide[place]
    # the ends of long lines
    breaks = np.concatenate(([0], np.cumsum(piece.data == 10)))
    line = breaks[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(starts)))
    head, length = head[length >= GRAM + REACH - 1], length[length >= GRAM + REACH - 1]
    short = np.flatnonzero((n_words > 0) & (n_words < GRAM))
    at = np.unique(np.concatenate((first[kept], head, head + length - GRAM)))
    at, n = np.concatenate((at, begin[short])), np.concatenate((np.full(len(at), GRAM), n_words[short]))
    return owner[at], at - begin[owner[at]], n, one(at, n), two(at, n)


def passages(documents: DataFrame) -> DataFrame:
    """doc_id, tag, at, n, h1, h2 of the runs of words that stand for a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for p in kernel.pieces(batch.column("text")):
                owner, at, n, h1, h2 = _runs(p)
                row = pa.array(owner + p.first)
                numbers = [pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.take(row), tags.take(row), *numbers], ["doc_id", "tag", "at", "n", "h1", "h2"])

    return _tagged(documents).mapInArrow(rows, "doc_id long, tag long, at int, n int, h1 long, h2 long")


def _cut(p: kernel.Piece, lines: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts of a piece without the given lines and runs of words (at, n); a line that loses all its words goes."""
    starts, ends, owner = p.words()
    begin = np.searchsorted(owner, np.arange(p.n + 1))
    row, flat = np.repeat(np.arange(p.n), runs.value_lengths().fill_null(0)), runs.flatten()
    at = begin[row] + flat.field("at").to_numpy()
    to = np.minimum(at + flat.field("n").to_numpy(), begin[row + 1])
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, np.minimum(at, to), 1)
    np.add.at(mark, to, -1)
    hit = np.cumsum(mark[:-1]) > 0
    # a line runs from its text's start or the newline before it to the next line's
    is_start = np.zeros(len(p.data) + 1, bool)
    is_start[p.offsets[:-1]] = is_start[np.flatnonzero(p.data == 10)] = True
    # a text that starts with a newline has an empty first line, which needs no entry of its own to be kept
    head = np.flatnonzero(is_start[:-1])
    tail = np.append(head[1:], len(p.data))
    text_of = p.owner(head)
    empty_first = (p.data[head] == 10) & (head == p.offsets[text_of]) if len(head) else np.zeros(0, bool)
    first_line = np.searchsorted(head, p.offsets[:-1])
    shift = np.zeros(p.n, np.int64)
    shift[text_of[empty_first]] = 1
    row, i = np.repeat(np.arange(p.n), lines.value_lengths().fill_null(0)), lines.flatten().to_numpy()
    place = first_line[row] + i - shift[row]
    gone = np.zeros(len(head), bool)
    gone[place[(place >= first_line[row]) & (place < np.append(first_line, len(head))[row + 1])]] = True
    line = np.searchsorted(head, starts, side="right") - 1
    words, lost = np.bincount(line, minlength=len(head)), np.bincount(line, weights=hit, minlength=len(head))
    gone |= (words > 0) & (words == lost)
    follow = np.append(starts[1:], len(p.data)) if len(starts) else starts
    cut_end = np.minimum(follow, tail[line])
    drop = np.zeros(len(p.data) + 1, np.int64)
    np.add.at(drop, np.concatenate((starts[hit], head[gone])), 1)
    np.add.at(drop, np.concatenate((cut_end[hit], tail[gone])), -1)
    keep = np.cumsum(drop[:-1]) == 0
    # the first line left has no newline before it
    left = np.flatnonzero(~gone)
    top = left[np.unique(text_of[left], return_index=True)[1]]
    top = top[(p.data[head[top]] == 10) & (shift[text_of[top]] == 0)]
    keep[head[top]] = False
    offsets = np.concatenate(([0], np.cumsum(keep)))[p.offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(p.n, pa.py_buffer(offsets), pa.py_buffer(p.data[keep].tobytes())).cast(pa.string())


@F.arrow_udf(StringType())
def _without(text: pa.Array, lines: pa.Array, runs: pa.Array) -> pa.Array:
    out = [_cut(p, lines.slice(p.first, p.n), runs.slice(p.first, p.n)) for p in kernel.pieces(text)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def dedup_passages(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents' own columns without later occurrences of repeated line windows and passages; n_chars, if there, made to fit."""
    found = shared.written(passages(documents))
    later, repeated = _later(found)
    runs = later.select("doc_id", "tag", F.lit(None).cast("array<int>").alias("lines"), F.struct("at", "n").alias("run"))
    whole = covered(documents, size)
    lines = whole.select("doc_id", "tag", F.col("covered").alias("lines"), F.lit(None).cast("struct<at:int,n:int>").alias("run"))
    of_one_text = F.flatten(F.collect_set("lines")).alias("__loom_lines"), F.collect_set("run").alias("__loom_runs")
    both = shared.written(runs.union(lines).groupBy("doc_id", "tag").agg(*of_one_text))
    shared.discard(found, repeated, whole)
    hit = _with_hits(documents, both)
    held = F.col("__loom_tag").isNull()
    new = {"text": F.when(held, F.col("text")).otherwise(_without(F.when(~held, F.col("text")), "__loom_lines", "__loom_runs"))}
    out = hit.select(*[new.get(c, F.col(c)).alias(c) for c in documents.columns], held.alias("__loom_held"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__loom_held"), F.col("n_chars")).otherwise(F.length("text")).cast(dict(documents.dtypes)["n_chars"]))
    return out.drop("__loom_held")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(shared.read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS tag FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, tag, unnest(str_split(text, chr(10))) AS raw, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM d),
t AS (SELECT doc_id, tag, i, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
n AS (SELECT doc_id, tag, i, line, ROW_NUMBER() OVER (PARTITION BY doc_id, tag ORDER BY i) AS r FROM t WHERE line <> ''),
w AS (SELECT doc_id, tag, r, [i, LEAD(i, 1) OVER p, LEAD(i, 2) OVER p] AS places,
             line || chr(10) || LEAD(line, 1) OVER p || chr(10) || LEAD(line, 2) OVER p AS three
      FROM n WINDOW p AS (PARTITION BY doc_id, tag ORDER BY r)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY three ORDER BY doc_id NULLS FIRST, tag, r) AS nth FROM w WHERE three IS NOT NULL),
c AS (SELECT DISTINCT doc_id, tag, i FROM (SELECT doc_id, tag, unnest(places) AS i FROM k WHERE nth > 1)),
m AS (SELECT l.*, c.i IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.tag = c.tag AND l.i = c.i),
o AS (SELECT doc_id, tag, COALESCE(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, COUNT(*) FILTER (gone) AS n_removed,
             COUNT(*) FILTER (regexp_matches(raw, '[^\x20\x09-\x0D]')) AS n_lines FROM m GROUP BY doc_id, tag)
SELECT x.doc_id, o.text, COALESCE(o.n_lines, 0)::BIGINT AS n_lines, COALESCE(o.n_removed, 0)::BIGINT AS n_removed
FROM documents x LEFT JOIN o ON x.doc_id IS NOT DISTINCT FROM o.doc_id AND ('0x' || substr(md5(x.text), 1, 15))::BIGINT = o.tag
"""
