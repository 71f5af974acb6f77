"""Ownership, filing and attention events to per-name aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio
from stockloom.functions.sizes import small
from stockloom.operators import merge as M
from stockloom.operators import predicates as Q


def flow(trades: DataFrame, floor: float = 0.0) -> DataFrame:
    """Per ticker: signed net value, counts of buys and sells, distinct buyers whose buys together reach the floor. Two
    levels, so that a hot ticker is first summed by buyer."""
    buy, sell = F.col("code") == "P", F.col("code") == "S"
    by_owner = trades.groupBy("ticker", "owner").agg(F.sum(F.when(buy, F.col("value")).otherwise(0.0)).alias("bought"), F.sum(F.when(sell, F.col("value")).otherwise(0.0)).alias("sold"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"))
    return by_owner.groupBy("ticker").agg((F.sum("bought") - F.sum("sold")).alias("net_value"), F.sum("buys").alias("buys"), F.sum("sells").alias("sells"), F.count_if((F.col("buys") > 0) & (F.col("bought") >= floor)).alias("buyers"))


def trade_months(trades: DataFrame) -> DataFrame:
    return trades.select("owner", F.year("d").alias("y"), F.month("d").alias("m")).distinct()


def owner_tier(months: DataFrame, year: int, lookback: int = 3) -> DataFrame:
    """routine, opportunistic or unclassified per owner, seen from ``year``. Unclassified: fewer than ``lookback`` years of
    trades anywhere in the record, or none in the last ones; routine: one calendar month in each of the last ``lookback`` years."""
    back = F.lit(year) - F.col("y")
    per_month = months.groupBy("owner", "m").agg(
        F.count_if(back.between(1, lookback)).alias("recent"), F.max("y").alias("latest"), F.collect_set("y").alias("years"))  # years of a record
    g = per_month.groupBy("owner").agg(F.max("recent").alias("same"), F.max("latest").alias("latest"), F.size(F.array_distinct(F.flatten(F.collect_set("years")))).alias("years"))
    judged = (F.col("years") >= lookback) & (F.lit(year) - F.col("latest") <= lookback)
    return g.select("owner", F.when(~judged, "unclassified").when(F.col("same") == lookback, "routine").otherwise("opportunistic").alias("tier"))


#: Weights of the buyer's role by words of the title.
TITLE_WEIGHTS = [(("chief financial", "cfo"), 1.00), (("chief executive", "ceo", "president"), 0.90)]
OTHER_TITLE = 0.80


def title_weight(title: Column, rules: list = TITLE_WEIGHTS, other: float = OTHER_TITLE) -> Column:
    t, out = F.lower(F.coalesce(title, F.lit(""))), None
    for words, w in rules:
        hit = t.rlike("|".join(words))
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out.otherwise(other)


def qualifying(trades: DataFrame, tiers: DataFrame, least: float = 100_000.0, roles: tuple[str, ...] = ("officer", "director")) -> DataFrame:
    """Purchases that count: not by a routine buyer, a joint filing or a plan, by one of the roles, of the least value each.
    Columns joint, planned and roles are used where they are there. An owner without a record is unclassified."""
    known = trades.where("code = 'P'").join(tiers.select("owner", "tier"), "owner", "left").withColumn("tier", F.coalesce("tier", F.lit("unclassified")))
    keep = (F.col("tier") != "routine") & (F.col("value") >= least)
    for column in ("joint", "planned"):
        if column in trades.columns:
            keep = keep & ~F.coalesce(F.col(column), F.lit(False))
    if "roles" in trades.columns:
        keep = keep & F.arrays_overlap("roles", F.array(*map(F.lit, roles)))
    return known.where(keep)


def strength(buys: DataFrame, rules: list = TITLE_WEIGHTS, tiers: dict[str, float] | None = None) -> DataFrame:
    """One row per ticker from qualifying buys (owner, issuer, title, tier, value): (0.5 + size + cluster) x role x tier, at
    most 1. A ticker whose buys name two issuers is left out. Buys are first summed by owner, so a hot ticker stays small."""
    of_tier = {"opportunistic": 1.0, "unclassified": 0.6} | (tiers or {})
    by_owner = buys.groupBy("ticker", "owner").agg(
        F.sum("value").alias("value"), F.max(title_weight(F.col("title"), rules)).alias("role"), F.bool_or(F.col("tier") == "opportunistic").alias("open_"),
        F.min("issuer").alias("least"), F.max("issuer").alias("most"))
    g = by_owner.groupBy("ticker").agg(
        F.count("*").alias("owners"), F.sum("value").alias("value"), F.max("role").alias("role"), F.bool_or("open_").alias("open_"), F.min("least").alias("issuer"), F.max("most").alias("most"))
    one = g.where(F.col("issuer").isNull() | (F.col("issuer") == F.col("most")))
    size, cluster = F.least(F.lit(0.30), F.col("value") / 5_000_000), F.least(F.lit(0.20), 0.10 * (F.col("owners") - 1))
    tier = F.when(F.col("open_"), of_tier["opportunistic"]).otherwise(of_tier["unclassified"])
    total = F.least(F.lit(1.0), (0.50 + size + cluster) * F.col("role") * tier)
    return one.select("ticker", "issuer", "owners", "value", F.when(F.col("open_"), "opportunistic").otherwise("unclassified").alias("tier"), F.round(total, 4).alias("strength"))


def weights(book: DataFrame) -> DataFrame:
    return book.withColumn("weight", ratio(F.col("value"), F.sum("value").over(Window.partitionBy("fund", "q"))))


def _prior(book: DataFrame) -> DataFrame:
    return book.select("fund", (F.col("q") + 1).alias("q"), "cusip", F.col("value").alias("prior_value"), F.col("shares").alias("prior_shares"), F.col("weight").alias("prior_weight"))


def new_positions(book: DataFrame, floor: float, full: float) -> DataFrame:
    """Positions not held the quarter before (by a fund with a book then), above a weight floor, with a capped strength."""
    w = weights(book)
    had = book.select("fund", (F.col("q") + 1).alias("q")).distinct()
    fresh = w.join(_prior(w).select("fund", "q", "cusip"), ["fund", "q", "cusip"], "left_anti").join(had, ["fund", "q"], "left_semi")
    return fresh.where(F.col("weight") >= floor).withColumn("strength", F.least(F.lit(1.0), F.col("weight") / full))


def material_adds(book: DataFrame, least: float) -> DataFrame:
    """Share counts grown by ``least`` or more over the quarter, with the change of weight."""
    w = weights(book)
    both = w.join(_prior(w), ["fund", "q", "cusip"]).where(F.col("prior_shares") > 0)
    return both.withColumn("growth", F.col("shares") / F.col("prior_shares") - 1).withColumn("weight_change", F.col("weight") - F.col("prior_weight")).where(F.col("growth") >= least)


def top_kept(rows: DataFrame, directory: DataFrame, denied: DataFrame, n: int) -> DataFrame:
    """Resolve, drop denied names, one row per name, then the first n per fund and quarter; unresolved rows take no place."""
    named = rows.join(directory, "cusip").join(denied, "ticker", "left_anti")
    one = named.withColumn("__n", F.row_number().over(Window.partitionBy("fund", "q", "ticker").orderBy(F.desc("strength"), "cusip"))).where("__n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("fund", "q").orderBy(F.desc("strength"), "ticker"))).where(F.col("place") <= n).drop("__n")


def item_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\.\d{2})"), 1))


def matched_items(items: Column, sets: list[list[str]]) -> Column:
    """Sorted codes of the first set of which all are there; NULL if none is."""
    return F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, s)), items)) == 0, F.array(*map(F.lit, sorted(s)))) for s in sets])


def stakes(records: DataFrame, drop_shells: bool = True, drop_affiliates: bool = True, boost: float = 0.2) -> DataFrame:
    """Initial stakes (ticker, cik, subject, activist, form, accession, pos, pct) to one row per ticker: activists, marquee (the
    first known one by name), strength, cik and subject of the first record, stake (of the first with one). Placeholder
    tickers, amendments, shells and filers that share a distinctive word with the subject drop out."""
    keep = Q.initial_form(F.col("form")) & M.real_ticker(F.col("ticker")).isNotNull()
    if drop_shells:
        keep = keep & ~Q.shell_name(F.col("subject"))
    if drop_affiliates:
        keep = keep & ~Q.affiliate(F.col("activist"), F.col("subject"))
    rows = records.where(keep).withColumn("ticker", M.real_ticker(F.col("ticker"))).withColumn("activist", F.coalesce("activist", F.lit("")))
    by_name = rows.groupBy("ticker", "activist").agg(
        F.min(F.struct("pos", "cik", "subject")).alias("first"), F.min(F.when(F.col("pct").isNotNull(), F.struct("pos", "pct"))).alias("stake"))  # a hot ticker is first summed by filer
    known = by_name.withColumn("marquee", Q.marquee(F.col("activist")))
    g = known.groupBy("ticker").agg(F.count("*").alias("activists"), F.min_by("marquee", F.when(F.col("marquee").isNotNull(), F.col("activist"))).alias("marquee"), F.min("first").alias("first"), F.min("stake").alias("stake"))
    more = F.when(F.col("marquee").isNotNull(), boost).otherwise(0.0) + F.least(F.lit(0.1), 0.05 * (F.col("activists") - 1))
    return g.select("ticker", "first.cik", "first.subject", "activists", "marquee", F.least(F.lit(1.0), 0.7 + more).alias("strength"), F.col("stake.pct").alias("pct"))


#: Items of which all must be there, items that veto, and the code of blank-cheque companies.
POCKET_ITEMS = [["1.01", "3.03"]]
VETO_ITEMS = ["1.03", "2.04", "2.05", "2.06", "3.01", "4.02", "5.01"]
BLANK_CHEQUE = "6770"


def _reports(rows: DataFrame) -> DataFrame:
    """Exact 8-K rows with an accession, the first of each."""
    return M.first_by(rows.where("file_type = '8-K' and adsh <> ''"), ["adsh"], ["pos"])


def pocket(rows: DataFrame, directory: DataFrame, denied: DataFrame, item_sets: list[list[str]] = POCKET_ITEMS, drop_shells: bool = True) -> DataFrame:
    """Reports (adsh, file_type, items, sics, name, cik, file_date, pos) to one event per ticker and day: ticker, file_date, adsh,
    cik, matched. In this order: amendments drop, repeated accessions, reports without an item set, blank-cheque codes, shell
    names, filers that the directory (cik, ticker) does not resolve, denied tickers and those with a suffix of uncommon stock,
    then all but the first of a ticker and day."""
    matched = _reports(rows).withColumn("matched", all_matched(item_codes(F.col("items")), item_sets)).where("matched is not null")
    clean = matched.where(~F.coalesce(F.array_contains("sics", BLANK_CHEQUE), F.lit(False)))
    if drop_shells:
        clean = clean.where(~Q.shell_name(F.col("name")))
    named = clean.join(directory.select("cik", F.upper("ticker").alias("ticker")), "cik").where(~M.not_common(F.col("ticker")))
    allowed = named.join(denied.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_anti")
    return M.first_by(allowed, ["ticker", "file_date"], ["pos"]).select("ticker", "file_date", "adsh", "cik", "matched")


def vetoes(rows: DataFrame, directory: DataFrame, items: list[str] = VETO_ITEMS) -> DataFrame:
    """Reports with a negative item: ticker, cik, adsh, file_date, items; only amendments, repeats and unresolved filers drop."""
    hit = F.array_sort(F.array_intersect(item_codes(F.col("items")), F.array(*map(F.lit, items))))
    return _reports(rows).withColumn("hit", hit).where(F.size("hit") > 0).join(directory.select("cik", F.upper("ticker").alias("ticker")), "cik").select("ticker", "cik", "adsh", "file_date", F.col("hit").alias("items"))


def all_matched(items: Column, sets: list[list[str]]) -> Column:
    """Sorted codes of all sets that are there in full; NULL if none is."""
    found = F.array_distinct(F.flatten(F.filter(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, s)), items)) == 0, F.array(*map(F.lit, s))) for s in sets]), lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, F.array_sort(found))


def earnings_summary(reports: DataFrame, calendar: DataFrame, today: Column, newest: int = 8) -> DataFrame:
    """Per ticker from reports (ticker, period, surprise) and a calendar (ticker, day, actual): surprises newest first (``newest`` at
    most), quarters, beats, last_surprise; next_day (first of today or later without an actual), last_report (last calendar
    day up to today with an actual, else the newest period, then estimated)."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period"))
    placed = reports.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= newest)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("surprise").isNotNull(), F.struct("__n", "surprise")))), lambda x: x["surprise"])  # `newest` at most
    r = placed.groupBy("ticker").agg(items.alias("surprises"), F.count_if(F.col("surprise") > 0).alias("beats"), F.max("period").alias("period"))
    c = calendar.groupBy("ticker").agg(F.min(F.when((F.col("day") >= today) & F.col("actual").isNull(), F.col("day"))).alias("next_day"), F.max(F.when((F.col("day") <= today) & F.col("actual").isNotNull(), F.col("day"))).alias("told"))
    j = r.join(c, "ticker", "full")
    some = F.size(F.coalesce("surprises", F.array().cast("array<double>"))) > 0
    return j.select("ticker", "surprises", F.when(some, F.size("surprises")).alias("quarters"), F.when(some, F.col("beats")).alias("beats"), F.get("surprises", F.lit(0)).alias("last_surprise"), "next_day", F.coalesce("told", "period").alias("last_report"), F.col("told").isNull().alias("estimated"))


def form_flag(form: Column, rules: list[tuple[str, str]]) -> Column:
    """The flag of the first prefix that fits; amendments count with their form."""
    return F.coalesce(*[F.when(form.startswith(p), F.lit(flag)) for p, flag in rules])


def attention(news: DataFrame, days: DataFrame) -> DataFrame:
    """Per ticker and day: articles of the last 7 days, the 7 before, of 30, and whether they rise. Articles are first
    counted by day, then placed into the days they reach: no range join."""
    daily = news.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.count("*").alias("c"))
    reach = daily.select("ticker", "d", "c", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("age")).withColumn("day", F.date_add("d", F.col("age")))
    met = reach.join(small(days), "day")
    g = met.groupBy("ticker", "day").agg(F.sum(F.when(F.col("age") < 7, F.col("c")).otherwise(0)).alias("last_7"), F.sum(F.when((F.col("age") >= 7) & (F.col("age") < 14), F.col("c")).otherwise(0)).alias("prior_7"), F.sum("c").alias("last_30"))
    return g.withColumn("rising", F.col("last_7") > F.col("prior_7"))


def section(events: DataFrame, since: Column, flags: dict[str, str], newest: int) -> DataFrame:
    """Per ticker inside the look-back: a flag per kind, the newest event ids first, the last day of a kind."""
    rows = events.where(F.col("ts") >= since).withColumn("__n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("event_id"))))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= newest, F.struct("__n", "event_id")))), lambda x: x["event_id"])  # at most `newest`
    return rows.groupBy("ticker").agg(*[F.bool_or(F.col("event_type") == kind).alias(name) for name, kind in flags.items()], ids.alias("newest"), F.max(F.when(F.col("event_type") == next(iter(flags.values())), F.to_date("ts"))).alias("last_day"))


def trailing_sums(rows: DataFrame, as_of: Column, key: str, day: str, value: str) -> DataFrame:
    """Sums over the trailing year and the year before it, distinct counterparts and the largest row."""
    age = F.datediff(as_of, F.col(day))
    last, before = (age >= 0) & (age < 365), (age >= 365) & (age < 730)
    return rows.groupBy(key).agg(F.sum(F.when(last, F.col(value)).otherwise(0.0)).alias("ttm"), F.sum(F.when(before, F.col(value)).otherwise(0.0)).alias("prior"), F.count_distinct(F.when(last, F.col("owner"))).alias("counterparts"), F.max_by("accession", F.struct(F.abs(value).alias("v"), F.col("accession").alias("a"))).alias("largest"), F.max(F.when(age >= 0, F.col(day))).alias("latest"))


def quarter_label(d: Column) -> Column:
    return F.concat(F.date_format(d, "yyyy"), F.lit("q"), F.quarter(d).cast("string"))


def capture_class(rows: DataFrame, floor: int) -> DataFrame:
    """captured, thin or failed per (ticker, day) by the number of parts seen."""
    return rows.withColumn("class", F.when(F.col("parts") == 0, "failed").when(F.col("parts") < floor, "thin").otherwise("captured"))


def readiness(rows: DataFrame, least_names: int) -> DataFrame:
    """Names and rows per day, and a total row (day NULL) by rollup; broad: enough names that day."""
    g = rows.rollup("day").agg(F.count_distinct("ticker").alias("names"), F.count("*").alias("n"))
    return g.withColumn("broad", F.col("names") >= least_names)
