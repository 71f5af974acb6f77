"""Yearly statements to per-entity measures. Statements are long: (entity, fiscal_year, measures...), one row a year.

Missing is never zero: absent years and values drop out, and a measure is NULL below its least number of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio


def median_multiple(c: Column, least: int = 2) -> Column:
    """Median of the values that are neither missing nor zero (aggregate)."""
    kept = F.when(c != 0, c)
    return F.when(F.count(kept) >= least, F.median(kept))


def mean_at_least(c: Column, least: int = 2) -> Column:
    return F.when(F.count(c) >= least, F.avg(c))


def cagr(value: str, year: str = "fiscal_year", least: int = 3) -> Column:
    """Growth a step between the first and last present value, both positive (aggregate)."""
    v, y = F.col(value), F.when(F.col(value).isNotNull(), F.col(year))
    first, last, n = F.min_by(v, y), F.max_by(v, y), F.count(v)
    return F.when((n >= least) & (first > 0) & (last > 0), F.pow(last / F.when(first > 0, first), 1 / F.when(n > 1, n - 1)) - 1)


def risen(stmts: DataFrame, value: str, key: str = "entity") -> DataFrame:
    """Adds ``up``: 1 where a present value is above the one present before it, 0 where not; NULL on the first."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, -1))
    return stmts.withColumn("up", (F.col(value) > before).cast("double"))


def persistent(value: str, least: int = 3) -> Column:
    """Share of the steps between present values that rise (an aggregate over rows of ``risen``)."""
    return F.when(F.count(value) >= least, F.avg("up"))


def persistence(stmts: DataFrame, value: str, key: str = "entity", least: int = 3) -> DataFrame:
    """Share of the steps between present values that rise."""
    return risen(stmts.where(F.col(value).isNotNull()), value, key).groupBy(key).agg(persistent(value, least).alias("persistence"))


def stability(c: Column, least: int = 3) -> Column:
    """max(0, 1 - population deviation / mean), for a positive mean (aggregate)."""
    return F.when((F.count(c) >= least) & (F.avg(c) > 0), F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_pop(c), F.avg(c))))


def latest_two(stmts: DataFrame, measures: list[str], key: str = "entity") -> DataFrame:
    """One row per entity: every measure of the newest year as m_t and of the row before it as m_p."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fiscal_year")))
    rows = stmts.withColumn("__n", place).where("__n <= 2")
    pick = lambda m, n: F.max(F.when(F.col("__n") == n, F.col(m)))
    return rows.groupBy(key).agg(F.max(F.when(F.col("__n") == 1, F.col("fiscal_year"))).alias("year_t"), F.max(F.when(F.col("__n") == 2, F.col("fiscal_year"))).alias("year_p"), *[pick(m, n).alias(f"{m}_{s}") for m in measures for n, s in ((1, "t"), (2, "p"))])


def six_tests(stmts: DataFrame) -> DataFrame:
    """won and evaluated of six tests: three levels of the latest year, three changes against the year before (with
    positive revenue in both); both NULL where none can be evaluated."""
    two = latest_two(stmts, ["net_income", "operating_cash_flow", "total_debt", "gross_profit", "revenue"])
    sold = (F.col("revenue_t") > 0) & (F.col("revenue_p") > 0)
    per = lambda m, s: F.try_divide(F.col(f"{m}_{s}"), F.col(f"revenue_{s}"))
    tests = [
        F.col("net_income_t") > 0,
        F.col("operating_cash_flow_t") > 0,
        F.col("operating_cash_flow_t") > F.col("net_income_t"),
        F.when(sold, per("net_income", "t") > per("net_income", "p")),
        F.when(sold, per("total_debt", "t") < per("total_debt", "p")),
        F.when(sold, per("gross_profit", "t") > per("gross_profit", "p")),
    ]
    won = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    legs = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in tests), F.lit(0))
    return two.select("entity", F.when(legs > 0, won).alias("won"), F.when(legs > 0, legs).alias("evaluated"))


def net_debt(debt: Column, cash: Column) -> Column:
    return F.when(debt.isNotNull() | cash.isNotNull(), F.coalesce(debt, F.lit(0.0)) - F.coalesce(cash, F.lit(0.0)))


def ebit_yield(ebit: Column, cap: Column, debt: Column) -> Column:
    ev = cap + debt
    return F.when((ebit > 0) & (ev > 0), F.try_divide(ebit, ev))


def growth_and_accruals(stmts: DataFrame, assets: str, income: str, cash: str) -> DataFrame:
    """asset_growth and accruals over the two newest years, only where they follow each other."""
    two = latest_two(stmts.where(F.col(assets).isNotNull()), [assets, income, cash])
    next_to = F.col("year_t") - F.col("year_p") == 1
    a, b = F.col(f"{assets}_t"), F.col(f"{assets}_p")
    return two.select("entity", F.when(next_to, ratio(a, b) - 1).alias("asset_growth"), F.when(next_to, ratio(F.col(f"{income}_t") - F.col(f"{cash}_t"), (a + b) / 2)).alias("accruals"))


def shareholder_yield(dividends: Column, repurchases: Column, repaid: Column, issued: Column, cap: Column) -> Column:
    legs = (dividends, repurchases, repaid, issued)
    any_ = F.coalesce(*legs).isNotNull()
    size = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    return F.when(any_ & (cap > 0), F.try_divide(size(dividends) + size(repurchases) + size(repaid) - size(issued), cap))


def dispersion(c: Column, least: int = 3) -> Column:
    return F.when(F.count(c) >= least, F.stddev_pop(c))


def decayed(surprise: Column, sigma: Column, days: Column, span: float = 60.0, floor: float = 1.0) -> Column:
    """Standardised surprise, fading linearly over ``span`` days. NULL below the floor of sigma; a report without an age or
    dated in the future does not fade."""
    fade = F.when(days.isNull() | (days < 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - days / span))
    return F.when(sigma >= floor, F.try_divide(surprise, sigma)) * fade


def implied_growth(cash: Column, cap: Column, year: Column, discount: float = 0.10, newest: int = 3) -> Column:
    """Discount rate less the median of the newest positive cash flows over market value (aggregate)."""
    flows = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.when(cash > 0, F.struct(year.alias("y"), cash.alias("v")))))), 1, newest), lambda x: x["v"])
    ranked = F.array_sort(flows)
    n = F.size(ranked)
    middle = (F.get(ranked, ((n - 1) / 2).cast("int")) + F.get(ranked, (n / 2).cast("int"))) / 2
    return F.when((n > 0) & (F.max(cap) > 0), discount - middle / F.max(cap))


def newest_run(stmts: DataFrame, needed: list[str], key: str = "entity") -> DataFrame:
    """The rows of the newest unbroken run of years that have all needed inputs (gaps and islands)."""
    have = stmts.where(" AND ".join(f"{c} IS NOT NULL" for c in needed))
    island = F.col("fiscal_year") + F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fiscal_year")))
    return have.withColumn("__i", island).withColumn("__m", F.max("__i").over(Window.partitionBy(key))).where("__i = __m").drop("__i", "__m")


def capital_table(run: DataFrame) -> DataFrame:
    """Sums over a run of years, payout share, change of the share count, and return on added capital (NULL unless capital grew by 5%)."""
    capital = F.col("total_debt") + F.col("total_equity")
    first, last = (lambda c: F.min_by(c, "fiscal_year")), (lambda c: F.max_by(c, "fiscal_year"))
    g = run.groupBy("entity").agg(F.count("*").alias("years"), F.sum("operating_cash_flow").alias("cash"), F.sum("net_income").alias("income"), first("diluted_shares").alias("s0"), last("diluted_shares").alias("s1"), first(capital).alias("c0"), last(capital).alias("c1"), first(F.col("net_income")).alias("i0"), last(F.col("net_income")).alias("i1"))
    grown = (F.col("c0") > 0) & (F.col("c1") >= 1.05 * F.col("c0")) & (F.col("years") >= 2)
    return g.select("entity", "years", "cash", ratio(F.col("income"), F.col("cash")).alias("share_of_cash"), (ratio(F.col("s1"), F.col("s0")) - 1).alias("share_change"), F.when(grown, ratio(F.col("i1") - F.col("i0"), F.col("c1") - F.col("c0"))).alias("added_return"),
        F.when(F.col("years") < 2, "one_year").when(~grown, "no_growth").otherwise("ok").alias("reason"))


def regime(series: DataFrame, off_above: dict[str, float], off_below: dict[str, float], on_below: dict[str, float], *by: str) -> DataFrame:
    """risk_off, risk_on or neutral from the latest value of every series (name, d, value), for each group ``by``: any series
    beyond its limit is enough, risk_off goes first, and a missing series trips nothing."""
    last = series.groupBy(*by, "name").agg(F.max_by("value", "d").alias("value"))

    def hit(rules: list[tuple[str, Column]]) -> Column:
        any_ = F.lit(False)
        for name, trips in rules:
            any_ = any_ | ((F.col("name") == name) & trips)
        return F.coalesce(F.bool_or(any_), F.lit(False))

    v = F.col("value")
    off = hit([(k, v > x) for k, x in off_above.items()] + [(k, v < x) for k, x in off_below.items()])
    on = hit([(k, v < x) for k, x in on_below.items()])
    out = last.groupBy(*by).agg(off.alias("off"), on.alias("on"))
    return out.withColumn("regime", F.when(F.col("off"), "risk_off").when(F.col("on"), "risk_on").otherwise("neutral"))
