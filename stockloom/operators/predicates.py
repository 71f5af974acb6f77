"""Predicates and small projections over names, filings, prices and calendars."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockloom.functions.columns import ratio
from stockloom.functions.sizes import small

#: Words that mark a blank-cheque company or shell; words that do not tell filers apart; known activists by fragments.
SHELL_WORDS = ["acquisition corp", "acquisition company", "acquisition holdings", "blank check", "spac"]
GENERIC_WORDS = "llc lp inc corp co company capital management mgmt partners holdings holding group fund funds trust ltd plc the and advisors associates investment investments value global master".split()
MARQUEE = {
    "Elliott": ("elliott",), "Icahn": ("icahn",), "Starboard": ("starboard",), "Trian": ("trian",), "Pershing Square": ("pershing square", "pershing"), "ValueAct": ("valueact", "value act"), "Third Point": ("third point",),
    "Jana": ("jana partners", "jana"), "Engine Capital": ("engine capital",), "Engaged Capital": ("engaged capital",), "Sachem Head": ("sachem head",), "Corvex": ("corvex",), "Ancora": ("ancora",), "Legion": ("legion partners",), "Politan": ("politan",),
}
INITIAL_FORMS, AMENDED_FORMS = ("SCHEDULE 13D", "SC 13D"), ("SCHEDULE 13D/A", "SC 13D/A")


def plain_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "))


def shell_name(c: Column, words: list[str] = SHELL_WORDS) -> Column:
    return plain_name(c).rlike("|".join(words))


def affiliate(a: Column, b: Column, generic: list[str] = GENERIC_WORDS, least: int = 3) -> Column:
    """Two names that share a distinctive word: of three letters or more and not one of the generic ones."""
    words = lambda c: F.filter(F.split(plain_name(c), " +"), lambda w: (F.length(w) >= least) & ~w.isin(generic))
    return F.arrays_overlap(words(a), words(b))


def marquee(c: Column, known: dict[str, tuple[str, ...]] = MARQUEE) -> Column:
    """The first known activist of whose fragments the name holds one, or NULL."""
    n = plain_name(c)
    return F.coalesce(*[F.when(n.rlike("|".join(parts)), F.lit(name)) for name, parts in known.items()])


def initial_form(form: Column, forms: tuple[str, ...] = INITIAL_FORMS) -> Column:
    return F.coalesce(F.upper(F.trim(form)).isin(*forms), F.lit(False))


def amended_form(form: Column) -> Column:
    return initial_form(form, AMENDED_FORMS)


def trade_kind(code: Column) -> Column:
    return F.when(code == "P", "buy").when(code == "S", "sell").when(code.isin("A", "M", "F", "G"), "award").otherwise("other")


def role_tier(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("chief") | t.contains("ceo") | t.contains("cfo") | t.contains("urgent"), 3).when(t.contains("director") | t.contains("high"), 2).otherwise(1)


#: Where documents state a percentage of a class, tagged and in text.
TAGGED_PERCENT = r"(?i)<(?:\w+:)?percentOfClass>\s*([0-9]{1,3}(?:\.[0-9]+)?)\s*%?\s*<"
WRITTEN_PERCENT = r"(?is)PERCENT\s+OF\s+CLASS[^%]{0,400}?([0-9]{1,3}(?:\.[0-9]+)?)\s*%"


def stake_percent(c: Column, tagged: str = TAGGED_PERCENT, written: str = WRITTEN_PERCENT) -> Column:
    """Largest percentage in (0, 100] that a document states: its tagged ones if it has any, else those in its text, tags
    stripped. NULL rather than a guess."""
    best = lambda found: F.array_max(F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: (x > 0) & (x <= 100)))
    xml = F.regexp_extract_all(c, F.lit(tagged), 1)
    plain = F.regexp_extract_all(F.regexp_replace(c, "<[^>]+>", " "), F.lit(written), 1)
    return F.when(F.size(xml) > 0, best(xml)).otherwise(best(plain))


@F.pandas_udf(StringType())
def _unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded once, then NFKC: neither has a built-in."""
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def safe_text(c: Column, limit: int) -> Column:
    """Third-party text made safe: entities decoded, NFKC, white space collapsed, control and format characters removed, cut
    with an ellipsis. Only texts with an entity or a character outside ASCII pass through Python."""
    odd = c.rlike(r"&[#A-Za-z]|[^\x00-\x7F]")
    whole = F.when(odd, _unescaped(F.when(odd, c))).otherwise(c)
    out = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(whole, F.lit("")), r"[\s\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "), r"[\p{Cc}\p{Cf}]", ""))
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(F.rtrim(F.substring(out, 1, limit - 1)), F.lit("…")))


def safe_url(c: Column) -> Column:
    """An http(s) address without white space, control or format characters; else empty."""
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.when(u.rlike(r"(?i)^https?://\S+$") & ~u.rlike(r"[\p{Cc}\p{Cf}]"), u).otherwise("")


def change_key(*cs: Column) -> Column:
    """Digest of quantised values: equal until something moves materially."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]), 256)


def sessions(days: DataFrame, holidays: DataFrame, back: int = 10) -> DataFrame:
    """day, open, last_session: weekdays that are no holiday, and the latest such calendar day on or before, whether or not it
    is among the days; NULL if there is none within ``back`` days. Each day meets its own few predecessors, so the calendar
    is never put in one order."""
    asked = days.select("day").distinct()
    near = asked.select("day", F.explode(F.sequence(F.lit(0), F.lit(back - 1))).alias("age")).withColumn("at", F.date_sub("day", F.col("age")))
    marked = near.join(small(holidays.select(F.col("day").alias("at"), F.lit(True).alias("shut"))), "at", "left")
    trades = F.dayofweek("at").between(2, 6) & F.col("shut").isNull()
    return marked.groupBy("day").agg(F.bool_or(trades & (F.col("age") == 0)).alias("open"), F.max(F.when(trades, F.col("at"))).alias("last_session"))


def upside(target: Column, price: Column) -> Column:
    return F.when(target != 0, ratio(target, price) - 1)


def inventory_days(inventory: Column, cost: Column) -> Column:
    return F.when(cost > 0, F.try_divide(inventory * 365, cost))


def share_class_twins(members: DataFrame) -> DataFrame:
    """Members of a group without later ones of equal size and growth (nulls never equal)."""
    w = Window.partitionBy("sector", "cap", "growth").orderBy("ticker")
    twin = F.col("cap").isNotNull() & F.col("growth").isNotNull() & (F.row_number().over(w) > 1)
    return members.withColumn("twin", twin).where(~F.col("twin")).drop("twin")
