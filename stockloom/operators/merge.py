"""Many sources of one entity into one record; identity of names, tickers and filers.

Rules: the first source in priority that has a value wins, field by field; zero and false are values; unknown sources
come last; ties go to the earliest position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that do not tell companies apart, and placeholders that are no ticker.
LEGAL_WORDS = "inc incorporated corp corporation co company ltd limited llc lp plc sa ag nv holdings holding group trust the".split()
NO_TICKER = ["", "N/A", "NONE", "NULL", "-"]


def ranked_sources(rows: DataFrame, priority: list[str]) -> DataFrame:
    """Adds ``rank`` by place in the priority list; unknown sources rank after all."""
    return rows.withColumn("rank", F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(priority)], F.lit(len(priority))))


def merge_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key: each field's first present value by rank, and the sources that gave any."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("rank", "source"))).alias(c)
    given = F.array_sort(F.array_distinct(F.filter(F.array(*[F.min(F.when(F.col(c).isNotNull(), F.struct("rank", "source")))["source"] for c in fields]), lambda x: x.isNotNull())))
    return rows.groupBy(key).agg(*[first(c) for c in fields], given.alias("sources"))


def pick_first(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The whole row of the first source with any of the fields."""
    w = Window.partitionBy(key).orderBy("rank", "source")
    return rows.where(F.coalesce(*[F.col(c) for c in fields]).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def backfill_years(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Yearly series: the best source of a key gives its years; a series it does not supply at all is filled from the next
    sources by fiscal year."""
    best = Window.partitionBy(key)
    supplied = [F.max(F.when(F.col("rank") == F.col("__best"), F.col(c).isNotNull())).over(best).alias(f"__has_{c}") for c in fields]
    marked = rows.withColumn("__best", F.min("rank").over(best)).select("*", *supplied)
    spine = F.max(F.when(F.col("rank") == F.col("__best"), 1)).over(Window.partitionBy(key, "fiscal_year"))
    kept = marked.withColumn("__spine", spine).where("__spine = 1")

    def fill(c: str) -> Column:
        own = F.max(F.when(F.col("rank") == F.col("__best"), F.col(c)))
        other = F.min_by(F.when((F.col("rank") > F.col("__best")), F.col(c)), F.when((F.col("rank") > F.col("__best")) & F.col(c).isNotNull(), F.col("rank")))
        return F.when(F.max(f"__has_{c}"), own).otherwise(other).alias(c)

    return kept.groupBy(key, "fiscal_year").agg(*[fill(c) for c in fields])


def merge_snapshots(rows: DataFrame, key: str, priority: list[str], flat: dict[str, list[str]], whole: dict[str, list[str]], errors: str = "error") -> DataFrame:
    """One record per key from the partial ones of all sources, unknown sources ranked last.

    Fields of a ``flat`` section come each from the first source that has it; a ``whole`` section comes as it stands from the first source
    with any of its fields. <section>_sources lists who contributed, in rank order for flat sections; errors of all sources are kept,
    in rank order. One pass: every pick is an aggregate of the same group."""
    ranked = ranked_sources(rows, priority)
    at = F.struct("rank", "source")

    def flat_section(name: str, fields: list[str]) -> list[Column]:
        seen = lambda c: F.when(F.col(c).isNotNull(), at)
        sources = F.array_distinct(F.array_sort(F.array_compact(F.array(*[F.min(seen(c)) for c in fields]))))
        return [*[F.min_by(c, seen(c)).alias(c) for c in fields], F.transform(sources, lambda x: x["source"]).alias(f"{name}_sources")]

    def whole_section(name: str, fields: list[str]) -> list[Column]:
        best = F.min_by(F.struct(*fields, "source"), F.when(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull(), at))
        return [*[best[c].alias(c) for c in fields], best["source"].alias(f"{name}_source")]

    picks = [c for n, f in flat.items() for c in flat_section(n, f)] + [c for n, f in whole.items() for c in whole_section(n, f)]
    said = F.array_sort(F.collect_list(F.when(F.col(errors).isNotNull(), F.struct("rank", "source", F.col(errors).alias("said")))))  # one a source
    return ranked.groupBy(key).agg(*picks, F.transform(said, lambda x: F.concat_ws(": ", x["source"], x["said"])).alias("errors"))


def normal_name(c: Column) -> Column:
    """Lower case, letters and digits only, legal words dropped."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(LEGAL_WORDS)), " ")


def real_ticker(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(~t.isin(NO_TICKER), t)


def well_formed(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z][A-Z0-9.\-]{0,5}$"), F.lit(False))


def not_common(c: Column) -> Column:
    """Five letters ending in a suffix of funds, foreign shares, units, warrants or rights."""
    return c.rlike("^[A-Z]{4}[FYWURQX]$")


def name_keys(directory: DataFrame) -> DataFrame:
    """Normalised name to ticker: the first per issuer; a name shared by two issuers is dropped."""
    g = directory.withColumn("key", normal_name(F.col("name"))).groupBy("key").agg(F.min_by("ticker", "pos").alias("ticker"), F.min("cik").alias("lo"), F.max("cik").alias("hi"))
    return g.where((F.col("lo") == F.col("hi")) & (F.col("key") != "")).select("key", "ticker")


def latest_symbol(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cusip").agg(F.max_by("symbol", F.struct("settled", "symbol")).alias("symbol"))


Resolver = Callable[[DataFrame], DataFrame]


def resolved(rows: DataFrame, key: str, resolvers: list[Resolver], name: str = "ticker") -> DataFrame:
    """Rows with the answer of the first resolver that knows their key, and its number (by), both NULL where none does. A resolver is
    given the rows of distinct keys that are still open and returns (key, answer): a join, a look-up table, a rule; never a call per
    row. An answer that is NULL, or two answers for one key, leave the key open for the next."""
    asked = [c for c in rows.columns]
    keys = rows.dropDuplicates([key])
    found = None
    for i, f in enumerate(resolvers):
        open_ = keys if found is None else keys.join(found, key, "left_anti")
        got = f(open_).select(F.col(key), F.col(name).alias("__a")).where("__a is not null").groupBy(key).agg(F.min("__a").alias(name), F.max("__a").alias("__b")).where(F.col(name) == F.col("__b"))
        got = got.select(key, name, F.lit(i).alias("by"))
        found = got if found is None else found.unionByName(got)
    return rows.join(found, key, "left").select(*asked, name, "by")


def validity(rows: DataFrame, key: str = "cik", day: str = "seen") -> DataFrame:
    """Snapshots of a directory to intervals [from_day, to_day)."""
    return rows.withColumn("from_day", F.col(day)).withColumn("to_day", F.lead(day).over(Window.partitionBy(key).orderBy(day)))


def resolve(asks: DataFrame, overrides: DataFrame, live: DataFrame, archive: DataFrame) -> DataFrame:
    """cik on a day to a ticker: override, then live, then the archive interval that holds the day; and where it came from."""
    a = asks.join(overrides.select("cik", F.col("ticker").alias("o")), "cik", "left").join(live.select("cik", F.col("ticker").alias("l")), "cik", "left")
    in_time = (F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    old = a.join(validity(archive).select("cik", F.col("ticker").alias("h"), "from_day", "to_day"), "cik", "left").groupBy("cik", "day", "o", "l").agg(F.max(F.when(in_time, F.col("h"))).alias("h"))
    return old.select("cik", "day", F.coalesce("o", "l", "h").alias("ticker"), F.when(F.col("o").isNotNull(), "override").when(F.col("l").isNotNull(), "live").when(F.col("h").isNotNull(), "archive").otherwise("none").alias("origin"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def already_reported(trades: DataFrame, identity: list[str]) -> DataFrame:
    """Trades without those an earlier filing reports with the same identity (a missing part never matches)."""
    earlier = trades.groupBy(*identity).agg(F.min("accession").alias("__first"))
    complete = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(True)) for c in identity], F.lit(False))
    return trades.join(earlier, identity, "left").where(complete | F.col("__first").isNull() | (F.col("accession") == F.col("__first"))).drop("__first")


def co_present(signals: DataFrame, names: list[str]) -> DataFrame:
    """Cells in which every named signal is there."""
    return signals.where(F.col("signal").isin(names)).groupBy("m", "ticker").agg(F.count_distinct("signal").alias("n")).where(F.col("n") == len(names)).drop("n")
