"""Point-in-time facts. A fact is (cik, tag, fy_end, filed, val, pos); it counts on a date only if filed and ended by then.

Versions are resolved by windows inside (filer, as_of) cells, so one job serves every date. Nothing dated later can
change an earlier answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio
from stockloom.functions.sizes import surely_small


def known(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """Every fact with every as_of on which it is known. ``dates`` is a short list (a grid); its size is
    checked before it is broadcast."""
    return facts.join(surely_small(dates, "dates"), (F.col("filed") <= F.col("as_of")) & (F.col("fy_end") <= F.col("as_of")))


def select(known_facts: DataFrame, family: dict[str, int]) -> DataFrame:
    """One value per (cik, as_of, fy_end): the first tag of the family that has one, its latest filing, the first row on ties."""
    prio = F.coalesce(*[F.when(F.col("tag") == t, F.lit(p)) for t, p in family.items()])
    rows = known_facts.withColumn("prio", prio).where("prio is not null")
    best = F.row_number().over(Window.partitionBy("cik", "as_of", "fy_end").orderBy("prio", F.desc("filed"), "pos"))
    return rows.withColumn("__n", best).where("__n = 1").select("cik", "as_of", "fy_end", "tag", "filed", "val")


def per_tag(known_facts: DataFrame) -> DataFrame:
    """One value per (cik, as_of, tag, fy_end)."""
    pick = F.min_by(F.struct("filed", "val"), F.struct((-F.unix_date("filed")).alias("f"), F.col("pos").alias("p")))
    return known_facts.groupBy("cik", "as_of", "tag", "fy_end").agg(pick.alias("x")).select("cik", "as_of", "tag", "fy_end", "x.filed", "x.val")


def sum_family(tags: DataFrame, family: list[str]) -> DataFrame:
    return tags.where(F.col("tag").isin(family)).groupBy("cik", "as_of", "fy_end").agg(F.sum("val").alias("val"))


def panel(tags: DataFrame, names: dict[str, str]) -> DataFrame:
    """Wide form: one column per tag, one row per (cik, as_of, fy_end)."""
    return tags.groupBy("cik", "as_of", "fy_end").agg(*[F.max(F.when(F.col("tag") == t, F.col("val"))).alias(c) for t, c in names.items()])


def latest_ratio(wide: DataFrame, num: str, den: str, positive: bool = False) -> DataFrame:
    """num / den at the latest end at which both are there; NULL for a zero (or, if asked, non-positive) denominator."""
    both = wide.where(F.col(num).isNotNull() & F.col(den).isNotNull())
    last = both.groupBy("cik", "as_of").agg(F.max_by(F.struct(num, den), "fy_end").alias("x"), F.max("fy_end").alias("fy_end"))
    r = ratio(F.col(f"x.{num}"), F.col(f"x.{den}"))
    return last.select("cik", "as_of", "fy_end", (F.when(F.col(f"x.{den}") > 0, r) if positive else r).alias("ratio"))


def newest_first(wide: DataFrame, value: str) -> DataFrame:
    items = F.reverse(F.array_sort(F.collect_list(F.struct("fy_end", value))))
    return wide.where(F.col(value).isNotNull()).groupBy("cik", "as_of").agg(F.transform(items, lambda x: x[value]).alias("series"))


def gross_profit(gp: str, revenue: str, cost: str, *by: str) -> Column:
    """Revenue less cost only where no gross profit exists at all in the cell."""
    none = F.max(gp).over(Window.partitionBy(*by)).isNull()
    return F.when(none, F.col(revenue) - F.col(cost)).otherwise(F.col(gp))


def taxed_return(income: Column, tax: Column, pretax: Column, debt: Column, equity: Column) -> Column:
    """Return on capital (debt and equity, both there and together positive) at the effective rate; 21% on a loss, without a tax
    and where the rate lies outside [0, 1/2]."""
    rate = F.when(pretax > 0, F.try_divide(tax, pretax))
    capital = debt + equity
    return F.when(capital > 0, F.try_divide(income * (1 - F.coalesce(F.when(rate.between(0.0, 0.5), rate), F.lit(0.21))), capital))


def fiscal_bucket(end: Column) -> Column:
    return F.year(F.date_sub(end, 182))


def by_bucket(wide: DataFrame) -> DataFrame:
    """The row of the later end where two ends fall into one fiscal bucket."""
    place = F.row_number().over(Window.partitionBy("cik", "as_of", fiscal_bucket(F.col("fy_end"))).orderBy(F.desc("fy_end")))
    return wide.withColumn("bucket", fiscal_bucket(F.col("fy_end"))).withColumn("__n", place).where("__n = 1").drop("__n")


def year_status(wide: DataFrame, income: str, debt: list[str], equity: str, floor: float) -> DataFrame:
    """roic at 21% flat tax and status ok / low_capital / missing; debt is the sum of its parts, 0 where no tag is there."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in debt), F.lit(0.0))
    capital = total + F.col(equity)
    status = F.when(F.col(income).isNull() | F.col(equity).isNull(), "missing").when(capital < floor, "low_capital").otherwise("ok")
    return wide.withColumn("status", status).withColumn("roic", F.when(status == "ok", ratio(F.col(income) * 0.79, capital)))


def own_snapshots(facts: DataFrame, lag_days: int = 120) -> DataFrame:
    """Each fiscal end seen ``lag_days`` later: as_of = fy_end + lag, per filer (an equi-join on the filer)."""
    dates = facts.select("cik", "fy_end").distinct().select("cik", F.date_add("fy_end", lag_days).alias("as_of"))
    return facts.join(dates, "cik").where((F.col("filed") <= F.col("as_of")) & (F.col("fy_end") <= F.col("as_of")))


def filings_before(filings: DataFrame, as_of: Column) -> DataFrame:
    """Latest and prior filing of each filer on or before a date: doc_id, prior_id."""
    place = F.row_number().over(Window.partitionBy("filer").orderBy(F.desc("filed"), F.desc("doc_id")))
    rows = filings.where(F.col("filed") <= as_of).withColumn("__n", place).where("__n <= 2")
    return rows.groupBy("filer").agg(F.max(F.when(F.col("__n") == 1, F.col("doc_id"))).alias("doc_id"), F.max(F.when(F.col("__n") == 2, F.col("doc_id"))).alias("prior_id"))


def completeness(df: DataFrame, fields: list[str]) -> list[Column]:
    """coverage (share of fields present) and missing (their names)."""
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in fields), F.lit(0))
    return [(n / len(fields)).alias("coverage"), F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull()).alias("missing")]


def filed_before_end(facts: DataFrame) -> DataFrame:
    return facts.groupBy("tag").agg(F.count_if(F.col("filed") < F.col("fy_end")).alias("early"), F.count("*").alias("n"))


#: The series of a full panel; every one has its own tags in a mapping of the caller.
SERIES = (
    "revenue", "net_income", "ocf", "capex", "diluted_eps", "gross_profit_tagged", "cost", "total_equity", "long_debt", "short_debt", "operating_income", "interest_expense", "pretax_income", "income_tax", "shares_out",
    "diluted_shares", "dep_amort", "cash", "assets", "dividends_paid", "repurchases", "debt_repayments", "debt_issuance")
SUMMED = ("dividends_paid", "repurchases", "debt_repayments", "debt_issuance")


def full_panel(known_facts: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """All series of a panel, one row per (cik, as_of, fy_end): the first tag of a family that reports the end owns it, a summed
    family adds all its members; then fcf, total_debt (both parts reported) and gross_profit (revenue less cost only where no
    gross profit is tagged at all). One shuffle resolves versions, one pivots."""
    member = lambda names: F.col("tag").isin(names)
    order = lambda names: F.coalesce(*[F.when(F.col("tag") == t, F.lit(i)) for i, t in enumerate(names)])

    def column(name: str) -> Column:
        names = tags[name]
        if name in SUMMED:
            return F.sum(F.when(member(names), F.col("val"))).alias(name)
        return F.min_by(F.when(member(names), F.col("val")), order(names)).alias(name)

    wide = per_tag(known_facts).groupBy("cik", "as_of", "fy_end").agg(*[column(n) for n in SERIES])
    tagged = F.max("gross_profit_tagged").over(Window.partitionBy("cik", "as_of")).isNotNull()
    return wide.select(
        "*", (F.col("ocf") - F.col("capex")).alias("fcf"), (F.col("long_debt") + F.col("short_debt")).alias("total_debt"),
        F.when(tagged, F.col("gross_profit_tagged")).otherwise(F.col("revenue") - F.col("cost")).alias("gross_profit"))


def _series(name: str | Column) -> Column:
    """A series of a cell, newest first, absent values left out (aggregate over the years of a filer)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.transform(F.reverse(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("fy_end", c.alias("v")))))), lambda x: x["v"])


def _latest(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("fy_end")))


def _ratio_latest(num: str | Column, den: str | Column, positive: bool = False) -> Column:
    """num / den at the latest end that both report; NULL for a zero denominator, or a negative one where asked."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    last = F.max_by(F.struct(n.alias("n"), d.alias("d")), F.when(n.isNotNull() & d.isNotNull(), F.col("fy_end")))
    return F.when((last["d"] != 0) & ((last["d"] >= 0) if positive else F.lit(True)), F.try_divide(last["n"], last["d"]))


def _cagr(name: str, least: int = 3) -> Column:
    c, at = F.col(name), F.when(F.col(name).isNotNull(), F.col("fy_end"))
    a, z, n = F.min_by(c, at), F.max_by(c, at), F.count(c)
    return F.when((n >= least) & (a > 0) & (z > 0), F.pow(F.try_divide(z, a), F.try_divide(F.lit(1.0), n - 1)) - 1)


def _mean_of(values: Column, least: int) -> Column:
    return F.when(F.size(values) >= least, F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)))


def panel_metrics(panel_: DataFrame, prices_then: DataFrame, prices_now: DataFrame) -> DataFrame:
    """A full panel and prices (then: cik, as_of, fy_end, px; now: cik, as_of, price) to one row of screen inputs per (cik, as_of).
    Every ratio is taken at one fiscal end, and what misses an input is NULL. One aggregation per cell; the arrays are the
    years of one filer."""
    ends = F.array_sort(F.collect_set(F.when(F.coalesce("net_income", "ocf", "total_debt", "gross_profit", "revenue").isNotNull(), F.col("fy_end"))))
    year = {n: F.map_from_entries(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("fy_end", n)))) for n in ("net_income", "ocf", "total_debt", "gross_profit", "revenue", "assets")}
    margins = _series(F.when(F.col("revenue") != 0, F.try_divide("gross_profit", "revenue")))
    roic = taxed_return(F.col("operating_income"), F.col("income_tax"), F.col("pretax_income"), F.col("total_debt"), F.col("total_equity"))
    ebitda, net_debt = F.col("operating_income") + F.col("dep_amort"), F.col("total_debt") - F.col("cash")
    pe = F.when((F.col("px") != 0) & (F.col("diluted_eps") != 0), F.try_divide("px", "diluted_eps"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("fy_end")))
    g = panel_.join(prices_then, ["cik", "as_of", "fy_end"], "left").groupBy("cik", "as_of").agg(
        _ratio_latest("net_income", "revenue").alias("net_margin"), _ratio_latest("net_income", "total_equity").alias("roe"), _ratio_latest("total_debt", "total_equity").alias("debt_to_equity"),
        _ratio_latest("operating_income", "interest_expense").alias("interest_coverage"), _ratio_latest("gross_profit", "revenue").alias("gross_margin"), margins.alias("__margins"), _series(roic).alias("__roic"),
        _cagr("revenue").alias("revenue_cagr"), _cagr("fcf").alias("fcf_cagr"), _cagr("net_income").alias("eps_cagr"), _cagr("diluted_eps").alias("eps_cagr_ps"), _cagr("diluted_shares").alias("share_count_cagr"),
        _series("revenue").alias("__revenue"), ends.alias("__ends"), *[m.alias(f"__{n}_by") for n, m in year.items()], _latest("fcf").alias("__fcf"), (F.max(F.when(F.col("fcf").isNotNull(), F.col("fy_end"))) == F.max(F.when(F.col("ocf").isNotNull(), F.col("fy_end")))).alias("__fresh"),
        *[_latest(n).alias(f"__{n}") for n in ("dividends_paid", "repurchases", "debt_repayments", "debt_issuance", "diluted_eps", "shares_out", "operating_income")], _latest("revenue").alias("revenue"), _latest("cash").alias("cash"),
        _series(pe).alias("__pe"), last(ebitda).alias("ebitda"), _ratio_latest(net_debt, ebitda, True).alias("net_debt_to_ebitda"), last(net_debt).alias("__net_debt")).join(prices_now, ["cik", "as_of"], "left")
    at = lambda n, i: F.element_at(f"__{n}_by", F.get("__newest", F.lit(i)))
    g = g.withColumn("__newest", F.reverse("__ends")).withColumn("market_cap", F.when((F.col("price") != 0) & (F.col("__shares_out") != 0), F.col("price") * F.col("__shares_out")))
    two = F.size("__newest") >= 2
    sold = two & (at("revenue", 0) > 0) & (at("revenue", 1) > 0)
    per = lambda n, i: F.try_divide(at(n, i), at("revenue", i))
    tests = [at("net_income", 0) > 0, at("ocf", 0) > 0, at("ocf", 0) > at("net_income", 0), F.when(sold, per("net_income", 0) > per("net_income", 1)), F.when(sold, per("total_debt", 0) < per("total_debt", 1)), F.when(sold, per("gross_profit", 0) > per("gross_profit", 1))]
    won, legs = (sum((F.when(t if yes else t.isNotNull(), 1).otherwise(0) for t in tests), F.lit(0)) for yes in (True, False))
    held = F.reverse(F.array_sort(F.map_keys("__assets_by")))
    a0, a1 = F.get(held, F.lit(0)), F.get(held, F.lit(1))
    apart = F.datediff(a0, a1).between(350, 380)
    x0, x1 = F.element_at("__assets_by", a0), F.element_at("__assets_by", a1)
    rises = F.aggregate(F.sequence(F.lit(0), F.size("__revenue") - 2), F.lit(0), lambda acc, i: acc + F.when(F.get("__revenue", i) > F.get("__revenue", i + 1), 1).otherwise(0))
    mean = _mean_of(F.col("__margins"), 3)
    spread = F.sqrt(F.aggregate("__margins", F.lit(0.0), lambda acc, x: acc + F.pow(x - mean, F.lit(2.0))) / F.size("__margins"))
    pes = F.array_sort(F.filter("__pe", lambda x: x != 0))
    n = F.size(pes)
    median = (F.get(pes, F.floor((n - 1) / 2).cast("int")) + F.get(pes, F.floor(n / 2).cast("int"))) / 2
    size = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(0.0))
    paid = size("__dividends_paid") + size("__repurchases") + size("__debt_repayments") - size("__debt_issuance")
    any_paid = F.coalesce("__dividends_paid", "__repurchases", "__debt_repayments", "__debt_issuance").isNotNull()
    value = F.col("market_cap") + F.col("__net_debt")
    return g.select(
        "cik", "as_of", "price", "net_margin", "roe", "debt_to_equity", "interest_coverage", "gross_margin", F.when(mean > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(spread, mean))).alias("gross_margin_stability"),
        F.get("__roic", F.lit(0)).alias("roic"), _mean_of(F.col("__roic"), 2).alias("roic_5y_avg"), "revenue_cagr", "fcf_cagr", "eps_cagr", "eps_cagr_ps", "share_count_cagr",
        F.when(F.size("__revenue") >= 3, F.try_divide(rises, F.size("__revenue") - 1)).alias("revenue_growth_persistence"), F.when(apart & (x1 != 0), F.try_divide(x0, x1) - 1).alias("asset_growth"),
        F.when(apart & (x0 + x1 != 0), F.try_divide(F.element_at("__net_income_by", a0) - F.element_at("__ocf_by", a0), (x0 + x1) / 2)).alias("accruals"), F.when(legs > 0, won).alias("piotroski_won"), F.when(legs > 0, legs).alias("piotroski_legs"),
        "market_cap", F.when(F.col("__fresh"), F.col("__fcf") > 0).alias("fcf_positive"), F.when(F.col("market_cap") != 0, F.try_divide("__fcf", "market_cap")).alias("fcf_yield"), F.when(any_paid & (F.col("market_cap") > 0), F.try_divide(paid, F.col("market_cap"))).alias("shareholder_yield"),
        F.when((F.col("price") != 0) & (F.col("__diluted_eps") != 0), F.try_divide("price", "__diluted_eps")).alias("pe_ttm"), F.when(n >= 2, median).alias("pe_median"), "revenue", "ebitda", "cash", "net_debt_to_ebitda",
        F.when((F.col("__operating_income") > 0) & (value > 0), F.try_divide("__operating_income", value)).alias("ebit_ev_yield"))
