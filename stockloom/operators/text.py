"""Text operators over filings and news, from extracted sections."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from stockloom.functions.sizes import small
from stockloom.operators.sequences import best_of_lists
from stockloom.session import written


def tokens(c: Column) -> Column:
    """Alphabetic tokens, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)


def bags(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, token, c: bag of words, counted before the shuffle."""
    return docs.select(id_, F.explode(tokens(F.col("text"))).alias("token")).groupBy(id_, "token").agg(F.count("*").alias("c"))


def _repeated(docs: DataFrame, id_: str = "doc_id") -> DataFrame | None:
    """Ids that stand in several rows; None if there is none."""
    twice = docs.groupBy(id_).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_).alias("__again"))
    return None if twice.isEmpty() else small(twice)


def bag_sizes(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, kinds, words of every bag that has a word. A text is counted in its own row, so that no word is shuffled; only rows that share
    an id are put together word by word."""
    def counted(rows: DataFrame) -> DataFrame:
        words = F.transform(F.array(tokens(F.col("text"))), lambda t: F.struct(F.size(F.array_distinct(t)).cast("long").alias("kinds"), F.size(t).cast("long").alias("words")))
        return rows.where("text is not null").select(id_, F.inline(words)).where("words > 0")

    twice = _repeated(docs, id_)
    if twice is None:
        return counted(docs)
    same = docs[id_].eqNullSafe(twice["__again"])
    shared = bags(docs.join(twice, same, "left_semi"), id_).groupBy(id_).agg(F.count("*").alias("kinds"), F.sum("c").alias("words"))
    return counted(docs.join(twice, same, "left_anti")).union(shared)


@F.pandas_udf(DoubleType())
def bag_cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bag-of-words cosine of two texts in lower case; NULL where either has no token."""
    def bag(text: str | None) -> Counter:
        return Counter(re.findall("[a-z]+", text or ""))

    def value(x: Counter, y: Counter) -> float | None:
        if not x or not y:
            return None
        few, many = (x, y) if len(x) <= len(y) else (y, x)
        return min(1.0, sum(n * many[t] for t, n in few.items() if t in many) / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))))

    for a, b in batches:
        yield pd.Series([value(bag(x), bag(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def cosine(pairs: DataFrame, docs: DataFrame, a: str, b: str) -> DataFrame:
    """Bag-of-words cosine of given document pairs; NULL where either side has no token. The two texts of a pair meet in one row and
    are counted there, so that no word is shuffled; pairs of an id that stands in several rows go word by word."""
    twice = _repeated(docs)
    pairs, apart = pairs.select(a, b), None
    if twice is not None:
        mark = lambda c: twice.select(F.col("__again").alias(c), F.lit(1).alias(f"__{c}"))
        marked = pairs.join(mark(a), a, "left").join(mark(b), b, "left")
        shared = F.col(f"__{a}").isNotNull() | F.col(f"__{b}").isNotNull()
        pairs, apart = marked.where(~shared).select(a, b), marked.where(shared).select(a, b)
    text = lambda c, name: docs.select(F.col("doc_id").alias(c), F.lower("text").alias(name))
    met = pairs.join(text(a, "__x"), a, "left").join(text(b, "__y"), b, "left")
    out = met.select(a, b, bag_cosine("__x", "__y").alias("similarity"))
    return out if apart is None else out.union(_cosine_by_words(apart, docs, a, b))


def _cosine_by_words(pairs: DataFrame, docs: DataFrame, a: str, b: str) -> DataFrame:
    """The same with every token a row: documents learn which pairs they belong to, and on which side; norms and dot product are sums of
    the counts of a pair's tokens."""
    side = lambda c, n: pairs.select(F.col(c).alias("doc_id"), F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(n).alias("side")).alias("pair"))
    placed = docs.select("doc_id", "text").join(side(a, 0).union(side(b, 1)), "doc_id")
    words = placed.select("pair", F.explode(tokens(F.col("text"))).alias("token"))
    own = lambda n: F.count_if(F.col("pair.side") == n)
    counts = words.groupBy(F.col("pair.a").alias(a), F.col("pair.b").alias(b), "token").agg(own(0).alias("x"), own(1).alias("y"))
    total = lambda p, q: F.sum(F.col(p) * F.col(q))
    g = counts.groupBy(a, b).agg(total("x", "y").alias("dot"), F.sqrt(total("x", "x")).alias("nx"), F.sqrt(total("y", "y")).alias("ny"))
    value = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.least(F.lit(1.0), F.col("dot") / (F.col("nx") * F.col("ny"))))
    return pairs.select(a, b).join(g.select(a, b, value.alias("similarity")), [a, b], "left").select(a, b, "similarity")


#: White space, no-break and typographic spaces included.
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def blocks(c: Column) -> Column:
    """Blank-line separated blocks, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def block_key(c: Column, length: int | None = 160) -> Column:
    """A block's start (None: the whole block) in lower case with single spaces, without digits, currency and stops: a changed amount or
    year is no new block."""
    part = c if length is None else F.substring(c, 1, length)
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(part, SPACES, " "))), r"[0-9$%,.\-]", "")


def numbered_blocks(docs: DataFrame, length: int | None = 160) -> DataFrame:
    """doc_id, pos, block, key (a table function)."""
    return docs.select("doc_id", F.posexplode(blocks(F.col("text"))).alias("pos", "block")).withColumn("key", block_key(F.col("block"), length))


def new_blocks(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks of the current document whose key is not among the prior document's."""
    return _added(pairs, numbered_blocks(docs))


def _added(pairs: DataFrame, b: DataFrame) -> DataFrame:
    now = pairs.join(b, "doc_id")
    before = pairs.join(b.select(F.col("doc_id").alias("prior_doc_id"), "key"), "prior_doc_id").select("doc_id", "key").distinct()
    return now.where("key <> ''").join(before, ["doc_id", "key"], "left_anti")


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks similarity of two strings; use it on blocked pairs only."""
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def block_ratios(pairs: DataFrame, docs: DataFrame, part: int = 64) -> DataFrame:
    """doc_id, pos, ratio: the best sequence ratio of every added block over all blocks of its prior document, 0 without any.
    Whole blocks are compared, to tell which are added and how alike they are. Both documents' keys come in lists of ``part``, so that a long filing is no single row and no key travels once a pair. Texts are cut
    into keys once, and the lists are dealt out evenly: matching costs far more than their bytes tell."""
    blocks_ = written(numbered_blocks(docs, None).select("doc_id", "pos", "key"))
    prior = blocks_.groupBy(F.col("doc_id").alias("prior_doc_id"), F.floor(F.col("pos") / part).alias("part")).agg(F.collect_set("key").alias("others"))  # at most part
    own = _added(pairs, blocks_).groupBy("doc_id", "prior_doc_id", F.floor(F.col("pos") / part).alias("own_part")).agg(F.collect_list(F.struct("pos", "key")).alias("own"))
    lists = own.join(prior, "prior_doc_id", "left")
    return best_of_lists(lists.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id", "own_part", "part"))


def added_blocks(pairs: DataFrame, docs: DataFrame, threshold: float = 0.5, most_blocks: int = 4, most_chars: int = 12_000) -> DataFrame:
    """doc_id, pos, ratio, block: blocks of a document that are like none of its prior document's (best ratio below the threshold),
    the first ``most_blocks`` of them, cut where all of them together (two line ends between) reach ``most_chars``. A prior document
    without blocks is no baseline, so nothing is new against it."""
    fresh = block_ratios(pairs, docs).where(F.col("ratio") < threshold)
    based = numbered_blocks(docs).select(F.col("doc_id").alias("prior_doc_id")).distinct()
    known = pairs.join(based, "prior_doc_id", "left_semi").select("doc_id")
    rows = fresh.join(known, "doc_id", "left_semi").join(numbered_blocks(docs, None).where("key <> ''").select("doc_id", "pos", "block"), ["doc_id", "pos"])
    w = Window.partitionBy("doc_id").orderBy("pos")
    first = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most_blocks)
    before = F.coalesce(F.sum(F.length("block") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("__left", F.lit(most_chars) - before).where("__left > 0").select("doc_id", "pos", "ratio", F.substring(F.col("block"), F.lit(1), F.col("__left").cast("int")).alias("block"))


def select_notes(notes: DataFrame, families: list[tuple[str, str, str | None]], most: int, chars: int, budget: int) -> DataFrame:
    """Notes (filing, pos, title, text) by title families (name, pattern, pattern of exclusions), in order: a note belongs to the first
    family that takes it; per filing the first ``most`` by family and place, each cut to ``chars`` and all of a filing to ``budget``."""
    title = F.lower("title")
    takes = [F.when(title.rlike(p) & (~title.rlike(x) if x else F.lit(True)), F.lit(i)) for i, (_, p, x) in enumerate(families)]
    rows = notes.withColumn("__f", F.coalesce(*takes)).where("__f is not null")
    w = Window.partitionBy("filing").orderBy("__f", "pos")
    kept = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("__size", F.least(F.length("text"), F.lit(chars)))
    before = F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.least(F.col("__size"), F.lit(budget) - before)).cast("int")
    name = F.get(F.array(*[F.lit(n) for n, _, _ in families]), F.col("__f"))
    return kept.select("filing", "pos", name.alias("family"), "place", F.substring(F.col("text"), F.lit(1), room).alias("text")).where("text <> ''")


def rank_reports(reports: DataFrame, priority: list[str], since: Column, most: int) -> DataFrame:
    """Exact 8-K reports (filer, id, form, filed, items) filed since a day that hold a wanted item: filer, id, filed, hits (wanted items,
    in order of priority), rank (of the best), place: by rank, then the newest, then the id; ``most`` of each filer."""
    order = F.array(*map(F.lit, priority))
    hits = F.filter(order, lambda x: F.array_contains("items", x))
    rows = reports.where((F.col("form") == "8-K") & (F.col("filed") >= since)).withColumn("hits", hits).where(F.size("hits") > 0)
    rows = rows.withColumn("rank", F.array_position(order, F.get("hits", F.lit(0))) - 1)
    w = Window.partitionBy("filer").orderBy("rank", F.desc("filed"), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("filer", "id", "filed", "hits", "rank", "place")


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of sequence_ratio by lengths alone."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))


def _keys(c: Column, gram: int = 4) -> Column:
    """What similar names meet by: their words, and their letters in groups of ``gram``, so that a misspelt word is no end."""
    flat = F.replace(c, F.lit(" "), F.lit(""))
    grams = F.when(F.length(flat) >= gram, F.transform(F.sequence(F.lit(1), F.length(flat) - gram + 1), lambda i: F.substring(flat, i, F.lit(gram)))).otherwise(F.array(flat))
    return F.array_distinct(F.concat(F.transform(F.split(c, " "), lambda w: F.concat(F.lit("w"), w)), grams))


def fuzzy_names(left: DataFrame, right: DataFrame, least: float, aliases: DataFrame | None = None, spread: int = 16) -> DataFrame:
    """For each left name (id, key: normalised) the most similar right one at or above ``least``: other, ratio.

    Distinct names meet by shared words and letter groups, a key of very many names being dealt out ``spread`` ways on the
    left; the best partner is found once for each distinct name, and ids, dealt out first, take over that of their name. Two
    strings whose ratio is 0.6 or more and that have eight letters or more share a run of four letters unless differences stand in
    every group; the tests measure recall against all pairs. Aliases (id of a right name, phrase) lift a left name that holds the
    phrase as whole words to 1."""
    a = left.select("id", F.col("key").alias("a")).repartition("id").where("a <> ''")
    b = right.where("key <> ''").groupBy(F.col("key").alias("b")).agg(F.min("id").alias("other"))  # alike, so the smallest id stands for all
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(spread)).cast("int")
    x = left.select(F.col("key").alias("a")).where("a <> ''").distinct().select("a", F.explode(_keys(F.col("a"))).alias("k"), salt("a").alias("s"))
    y = b.select("b").distinct().select("b", F.explode(_keys(F.col("b"))).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("s"))
    met = x.join(y, ["k", "s"]).where(length_bound(F.col("a"), F.col("b")) >= least).select("a", "b").distinct()
    scored = met.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= least)
    best = F.min_by(F.struct("other", "ratio"), F.struct((-F.round("ratio", 9)).alias("r"), F.col("other").alias("o"))).alias("x")
    found = written(scored.join(b, "b").groupBy("a").agg(best).select("a", "x.other", "x.ratio"))  # one row a distinct name
    pairs = a.join(small(found), "a").select("id", "other", "ratio")
    if aliases is not None:
        words = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        first = lambda c: F.split(c, " ")[0]
        known = aliases.select(F.col("id").alias("other"), "phrase", first("phrase").alias("w"))
        lifted = a.select("id", "a", F.explode(F.array_distinct(F.split("a", " "))).alias("w")).join(known, "w").where(F.contains(words("a"), words("phrase")))
        pairs = pairs.union(lifted.select("id", "other", F.lit(1.0)))
    return pairs.groupBy("id").agg(best).select("id", "x.other", "x.ratio")


def idf(docs: DataFrame) -> DataFrame:
    """token, df, idf over all documents."""
    n = docs.agg(F.count("*").alias("n"))
    seen = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return seen.join(F.broadcast(n)).select("token", "df", F.log((1 + F.col("n")) / (1 + F.col("df"))).alias("idf"))  # n is one row


#: Adverse conclusions on controls, in order; words that date a conclusion by the report itself; dates.
ADVERSE = [
    "internal control over financial reporting was not effective", "internal controls over financial reporting were not effective",
    "did not maintain effective internal control over financial reporting", "disclosure controls and procedures were not effective",
]
SELF_REFERENCE = "end of the period covered by this (annual )?report"
AS_OF, AS_OF_FORMAT = r"as of ([a-z]+ \d{1,2},? \d{4})", "MMMM d yyyy"


def conclusions(docs: DataFrame, phrases: list[str] = ADVERSE, self_reference: str = SELF_REFERENCE, dated: str = AS_OF, date_format: str = AS_OF_FORMAT, window: int = 240, tolerance: int = 20, most: int = 600, least: int = 40) -> DataFrame:
    """Documents (doc_id, text, period_end) with an adverse conclusion about their own period: phrase (its number), place, as_of,
    quote (the sentence around it). Every place of every phrase is looked at; one counts if the words around it refer to the
    report itself, or if the nearest date there lies within the tolerance of the period's end. The first phrase, then the
    first place wins. Documents without any phrase drop out before the work; nothing without a period is returned."""
    flat = docs.where(F.col("period_end").isNotNull()).select("doc_id", "period_end", F.regexp_replace("text", r"[\s\x{A0}]+", " ").alias("flat")).withColumn("low", F.lower("flat"))
    some = F.lit(False)
    for p in phrases:
        some = some | F.col("low").contains(p)

    def places(phrase: str) -> Column:
        lengths = F.transform(F.split("low", "\\Q" + phrase + "\\E", -1), F.length)
        start = lambda n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x) + (n - 1) * len(phrase)
        return F.when(F.size(lengths) > 1, F.transform(F.sequence(F.lit(1), F.size(lengths) - 1), start))

    def numbered(k: int, phrase: str) -> Column:
        return F.transform(places(phrase), lambda i: F.struct(F.lit(k).alias("phrase"), i.alias("place")))

    found = F.flatten(F.filter(F.array(*[numbered(k, p) for k, p in enumerate(phrases)]), lambda x: x.isNotNull()))
    hits = flat.where(some).select("doc_id", "period_end", "flat", F.explode(found).alias("h")).select("doc_id", "period_end", "flat", "h.*")
    begin = F.greatest(F.col("place") - window, F.lit(0))
    around = hits.withColumn("around", F.substring("flat", begin + 1, F.col("place") + window - begin))
    day = lambda x: F.to_date(F.try_to_timestamp(F.initcap(F.replace(x, F.lit(","), F.lit(""))), F.lit(date_format)))
    days = F.filter(F.transform(F.regexp_extract_all("around", F.lit(f"(?i){dated}"), 1), day), lambda x: x.isNotNull())
    near = F.array_min(F.transform(days, lambda x, i: F.struct(F.abs(F.datediff(x, F.col("period_end"))).alias("gap"), i.alias("i"), x.alias("d"))))
    as_of = F.when(F.col("around").rlike(f"(?i){self_reference}"), F.col("period_end")).when(near["gap"] <= tolerance, near["d"])
    from_ = F.greatest(F.col("place") - most, F.lit(0))
    head = F.substring("flat", from_ + 1, F.col("place") - from_)
    back = F.instr(F.reverse(head), " .")
    start = F.when(back > 0, from_ + F.length(head) - back + 1).otherwise(0)
    stop = F.expr("locate('. ', flat, place + 1)")
    end = F.least(F.when(stop > 0, stop).otherwise(F.length("flat")), start + most)
    quote = F.trim(F.substring(F.col("flat"), start + 1, end - start))
    good = around.withColumn("as_of", as_of).withColumn("quote", quote).where(F.col("as_of").isNotNull() & (F.length("quote") >= least))
    first = F.min_by(F.struct("phrase", "place", "as_of", "quote"), F.struct("phrase", "place")).alias("x")
    return good.groupBy("doc_id").agg(first).select("doc_id", "x.*")


def caps(c: Column, limits: dict[str, int]) -> list[Column]:
    """A cut and a stub mark for each section limit."""
    return [x for name, n in limits.items() for x in (F.substring(c, 1, n).alias(name), (F.length(F.trim(c)) < n / 10).alias(f"{name}_stub"))]


def fair_budget(rows: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Characters allowed to each part: equal shares, what small parts leave goes to the larger ones, in order of size."""
    w = Window.partitionBy(key).orderBy(size, "doc_id")
    left = F.lit(total) - F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(w) + 1
    share = F.floor(left / parts)
    # once a part exceeds its share, every larger one gets that share too
    first_cut = F.min(F.when(F.col(size) > F.col("__share"), F.col("__share"))).over(w)
    return rows.withColumn("__share", share).withColumn("allowed", F.greatest(F.lit(0), F.least(F.col(size), F.coalesce(first_cut, F.col(size))))).drop("__share")


#: Typographic characters and what a quote has in their place; the last goes.
FOLDED, PLAIN = "’‘“”–—−\u00a0\u2007\u202f\u00ad", "''\"\"---   "
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")]


def folded(c: Column) -> Column:
    """A text as quotes are compared: typography folded, white space single, lower case."""
    out = F.translate(c, FOLDED, PLAIN)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def _met(segments: DataFrame, quotes: list[tuple], item_id: DataType) -> DataFrame:
    """(item_id, doc_id) of all quotes in all segments (doc_id, body), by one automaton over the quotes in every task."""
    spread = segments.sparkSession.sparkContext.broadcast(quotes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, items = ahocorasick.Automaton(), {}
        for item, quote in spread.value:
            items.setdefault(quote, []).append(item)
        for quote, own in items.items():
            machine.add_word(quote, own)
        machine.make_automaton()
        for b in batches:
            found = [(item, doc) for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True) for item in {i for _, own in machine.iter(body or "") for i in own}]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], out[0]), pa.array([d for _, d in found], out[1])], ["item_id", "doc_id"])

    schema = StructType([StructField("item_id", item_id), StructField("doc_id", segments.schema["doc_id"].dataType)])
    out = [to_arrow_type(f.dataType) for f in schema]
    return segments.select("doc_id", "body").mapInArrow(rows, schema)


def grounded(claims: DataFrame, segments: DataFrame, least: int = 12, gram: int = 4, small: int = 100_000) -> DataFrame:
    """Claims (item_id, text) found in segments (doc_id, text): item_id, doc_id (the smallest), places (segments that hold it).

    A claim's first whole words meet the segments' word groups in a hash join, then the folded quote must be contained. The
    claims' groups are sent to the scan, where they are few (counted, ``small`` at most), so that only groups that a claim
    has are ever shuffled. Claims too short for a group are looked for together, by one automaton that reads each segment once; more than
    ``small`` of them go in blocks of about that many, each with a scan of its own."""

    def grams(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - gram), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))

    inner = F.slice(F.split("quote", " "), 2, gram)  # whole words: the first may be glued to what stands before
    quotes = claims.select("item_id", folded(F.col("text")).alias("quote")).where(F.length("quote") >= least)
    long = F.size(F.split("quote", " ")) >= gram + 2
    c = quotes.where(long).withColumn("g", F.xxhash64(*[F.get(inner, F.lit(j)) for j in range(gram)]))
    wanted = c.select("g").distinct()
    s = segments.select("doc_id", folded(F.col("text")).alias("body"))
    place = s.select("doc_id", F.split("body", " ").alias("w")).where(F.size("w") >= gram).select("doc_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
    few = wanted.limit(small + 1).count() <= small
    place = place.join(F.broadcast(wanted) if few else wanted, "g", "left_semi")
    near = place.join(c.select("item_id", "g"), "g").select("item_id", "doc_id").distinct()
    found = near.join(s, "doc_id").join(c.select("item_id", "quote"), "item_id").where(F.contains("body", "quote")).select("item_id", "doc_id")
    short = quotes.where(~long)
    n = short.count()
    blocks = n // small + 1
    for i in range(blocks if n else 0):
        part = [(r[0], r[1]) for r in short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]  # about ``small`` short quotes
        found = found.union(_met(s, part, claims.schema["item_id"].dataType))
    return found.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("places"))
