"""Price series: joins in time and trailing-window features. Series are keyed (ticker, d), one row a day.

Windows count rows (trading days), never calendar days. A value is NULL where the history is too short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio
from stockloom.functions.sizes import small

YEAR = 252


def by_ticker(key: str = "ticker", day: str = "d"):
    return Window.partitionBy(key).orderBy(day)


def monthly_last(prices: DataFrame) -> DataFrame:
    """Last close of every calendar month."""
    return prices.where("close is not null").groupBy("ticker", F.trunc("d", "month").alias("month")).agg(F.max_by("close", "d").alias("close"), F.max("d").alias("d"))


def join_on_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series joined by date: d, close_a, close_b. Repeated dates: the smallest pos on the left, the largest on the right. Few
    dates (counted) go to the rows, so that no task gathers all rows of a date; else both sides are shuffled."""
    left = a.groupBy("ticker", "d").agg(F.min_by("close", "pos").alias("close_a"))
    right = b.groupBy("d").agg(F.max_by("close", "pos").alias("close_b"))
    return left.join(small(right), "d")


def as_of(targets: DataFrame, prices: DataFrame, at: str = "ask") -> DataFrame:
    """For every (ticker, ask) of targets the latest close on or before it: union, then the last value seen in order.
    One shuffle by ticker; no range join."""
    rows = prices.select("ticker", F.col("d").alias("__t"), F.lit(0).alias("__side"), F.struct("d", "close").alias("__p"))
    asks = targets.select("ticker", F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("struct<d:date,close:double>").alias("__p"))
    seen = F.last("__p", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(asks).withColumn("__seen", seen).where("__side = 1")
    return both.select("ticker", F.col("__t").alias(at), F.col("__seen.d").alias("d"), F.col("__seen.close").alias("close"))


def nearest(targets: DataFrame, prices: DataFrame, tolerance: int, at: str = "ask") -> DataFrame:
    """For every (ticker, ask) the close of the nearest day within ``tolerance`` days, the earlier one on a tie. The
    tolerance is exploded to dates, so the join is an equi-join."""
    days = targets.select("ticker", at, F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("gap")).withColumn("d", F.date_add(at, F.col("gap")))
    met = days.join(prices.select("ticker", "d", "close"), ["ticker", "d"])
    best = F.min_by(F.struct("d", "close"), F.struct(F.abs("gap").alias("a"), F.col("d").alias("b"))).alias("best")
    return met.groupBy("ticker", at).agg(best).select("ticker", at, "best.d", "best.close")


def history_counts(targets: DataFrame, prices: DataFrame, at: str = "ask") -> DataFrame:
    """Truncated history: how many closes, their sum, and the first of them on or before each date, whatever the distance. One
    running aggregate per ticker over the union of closes and dates answers all dates; nothing is joined by range."""
    rows = prices.select("ticker", "d", "close", F.lit(0).alias("asked")).union(targets.select("ticker", at, F.lit(None).cast("double"), F.lit(1)))
    w = Window.partitionBy("ticker").orderBy("d", "asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("ticker", F.col("d").alias(at), "asked", F.count("close").over(w).alias("n"), F.sum("close").over(w).alias("sum_close"), F.min(F.when(F.col("asked") == 0, F.col("d"))).over(w).alias("first_d"))
    return seen.where("asked = 1").drop("asked").distinct()


# ---------------------------------------------------------------- trailing features; `w` is the series in order


def sma(n: int, w=None) -> Column:
    w = (w or by_ticker()).rowsBetween(1 - n, 0)
    return F.when(F.count("close").over(w) >= n, F.avg("close").over(w))


def over_sma(n: int) -> Column:
    return ratio(F.col("close"), sma(n)) - 1


def back(n: int) -> Column:
    """The close n places from the end, counting the latest as 1."""
    return F.lag("close", n - 1).over(by_ticker()) if n > 1 else F.col("close")


def return_between(start: int, end: int) -> Column:
    return ratio(back(end), back(start)) - 1


def return_over(n: int) -> Column:
    return return_between(n + 1, 1)


def daily_return() -> Column:
    """NULL on the first row, 0 where the prior close is not positive."""
    prior = F.lag("close", 1).over(by_ticker())
    return F.when(prior > 0, F.try_divide(F.col("close"), prior) - 1).when(prior.isNotNull(), 0.0)


def nonzero_return() -> Column:
    return ratio(F.col("close"), F.lag("close", 1).over(by_ticker())) - 1


def volatility(window: int = YEAR, ret: str = "ret") -> Column:
    """Annualised sample deviation of the last ``window`` returns in column ``ret``."""
    w = by_ticker().rowsBetween(1 - window, 0)
    return F.when(F.count(ret).over(w) >= 2, F.stddev_samp(ret).over(w) * F.sqrt(F.lit(float(YEAR))))


def high_nearness(window: int = YEAR, least: int = 200) -> Column:
    w = by_ticker().rowsBetween(1 - window, 0)
    top = F.max("close").over(w)
    return F.when((F.count("close").over(by_ticker()) >= least) & (top > 0), F.try_divide(F.col("close"), top))


def largest_return(window: int = 21, ret: str = "ret") -> Column:
    w = by_ticker().rowsBetween(1 - window, 0)
    return F.when(F.count("close").over(by_ticker()) >= window + 1, F.max(ret).over(w))


def trailing(rows: DataFrame, n: int, **of: tuple[str, str]) -> DataFrame:
    """Adds what the last ``n`` rows of a series hold, for each name a (column, kind): the ``mean`` of n values, the sample ``deviation`` of two or
    more, the ``top``. A long frame that slides would take every row n times. Here a series is cut into stretches of n rows, and the
    last n rows are the end of one stretch and the start of the next: each row enters two running aggregates, however long the
    frame, and nothing is ever subtracted, so that a flat series has a deviation of zero after a lively one."""
    held = {"mean": (F.count, F.sum), "deviation": (F.count, F.avg, F.var_pop), "top": (F.max,)}
    key = by_ticker("ticker", "__i")
    inside = lambda order: Window.partitionBy("ticker", "__cut").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def part(side: str, order) -> list[Column]:
        out = []
        for name, (c, kind) in of.items():
            out.append(F.struct(*[f(c).over(inside(order)).alias(x) for x, f in zip("nmv", held[kind], strict=False)]).alias(f"__{side}_{name}"))
        return out

    cut = rows.withColumn("__i", F.row_number().over(by_ticker()) - 1).withColumn("__cut", F.floor(F.col("__i") / n))
    ends = cut.select("*", *part("end", F.desc("__i")))
    both = ends.select("*", *part("start", F.col("__i")))
    before = lambda name: F.when(F.col("__i") % n < n - 1, F.lag(f"__end_{name}", n - 1).over(key)).alias(f"__end_{name}")
    met = both.select(*rows.columns, *[f"__start_{k}" for k in of], *[before(k) for k in of])

    def merged(name: str, kind: str) -> Column:
        a, b = F.col(f"__end_{name}"), F.col(f"__start_{name}")
        if kind == "top":
            return F.greatest(a["n"], b["n"])
        na, nb = F.coalesce(a["n"], F.lit(0)), b["n"]
        if kind == "mean":
            return F.when(na + nb >= n, (F.coalesce(a["m"], F.lit(0.0)) + F.coalesce(b["m"], F.lit(0.0))) / (na + nb))
        apart = F.when((na > 0) & (nb > 0), (b["m"] - a["m"]) * (b["m"] - a["m"]) * na * nb / (na + nb)).otherwise(0.0)
        own = lambda x, k: F.coalesce(x["v"] * k, F.lit(0.0))
        return F.when(na + nb >= 2, F.sqrt((own(a, na) + own(b, nb) + apart) / (na + nb - 1)))

    return met.select(*rows.columns, *[merged(k, kind).alias(k) for k, (_, kind) in of.items()])


def latest(prices: DataFrame, n: int, key: str = "ticker", day: str = "d") -> DataFrame:
    """The last n rows of every series, with ``rn`` counting back from 1."""
    return prices.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))).where(F.col("rn") <= n)


def max_drawdown(prices: DataFrame, window: int = YEAR) -> DataFrame:
    """Deepest fall from a running peak within each ticker's last ``window`` rows."""
    peak = F.max("close").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    falls = latest(prices, window).withColumn("fall", ratio(F.col("close"), peak) - 1)
    return falls.groupBy("ticker").agg(F.when(F.count("*") >= 2, F.least(F.lit(0.0), F.min("fall"))).alias("max_drawdown"))


def standing(prices: DataFrame, n: int = 200, window: int = YEAR) -> DataFrame:
    """One row a ticker as of its last day: close, over_sma (against the mean of the last n closes) and max_drawdown. Only the last
    rows of a series are ordered, once, and no window slides over the rest."""
    top = F.max(F.when(F.col("rn") <= window, F.col("close"))).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    rows = latest(prices, max(n, window)).withColumn("fall", F.when(F.col("rn") <= window, ratio(F.col("close"), top) - 1))
    near = F.when(F.col("rn") <= n, F.col("close"))
    g = rows.groupBy("ticker").agg(
        F.max_by("close", "d").alias("close"), F.when(F.count(near) >= n, F.avg(near)).alias("mean"), F.when(F.count_if(F.col("rn") <= window) >= 2, F.least(F.lit(0.0), F.min("fall"))).alias("max_drawdown"))
    return g.select("ticker", "close", (ratio(F.col("close"), F.col("mean")) - 1).alias("over_sma"), "max_drawdown")


def over_mean(prices: DataFrame, n: int = 200) -> DataFrame:
    """over_200: the close against the mean of the last n, as over_sma, in running aggregates."""
    return trailing(prices, n, __mean=("close", "mean")).withColumn("over_200", ratio(F.col("close"), F.col("__mean")) - 1).drop("__mean")


def volatilities(rows: DataFrame, ret: str = "ret", **windows: int) -> DataFrame:
    """Annualised sample deviation of the last returns, as volatility, for each name over so many rows."""
    for name, window in windows.items():
        rows = trailing(rows, window, **{name: (ret, "deviation")}).withColumn(name, F.col(name) * F.sqrt(F.lit(float(YEAR))))
    return rows


def features(prices: DataFrame, *names: str) -> DataFrame:
    """Trailing features of every (ticker, d), all or those named."""
    names = names or ("sma_20", "over_200", "mom_6m", "mom_12_1", "vol", "vol_126", "near_high", "max_ret", "vol_scaled")
    rows = prices.select("ticker", "d", "close").withColumn("ret", daily_return())
    if {"vol", "near_high"} & set(names):
        rows = trailing(rows, YEAR, __vol=("ret", "deviation"), __top=("close", "top"))
    if {"vol_126", "vol_scaled"} & set(names):
        rows = volatilities(rows, vol_126=126)
    if "over_200" in names:
        rows = over_mean(rows)
    made = {
        "sma_20": sma(20), "mom_6m": return_over(126), "mom_12_1": return_between(274, 22), "vol": F.col("__vol") * F.sqrt(F.lit(float(YEAR))), "max_ret": largest_return(),
        "near_high": F.when((F.count("close").over(by_ticker()) >= 200) & (F.col("__top") > 0), F.try_divide(F.col("close"), F.col("__top")))}
    made = {k: v for k, v in made.items() if k in names or (k == "mom_12_1" and "vol_scaled" in names)}
    rows = rows.select("*", *[v.alias(k) for k, v in made.items()])
    if "vol_scaled" in names:
        rows = rows.withColumn("vol_scaled", F.when(F.col("vol_126") > 1e-4, F.try_divide(F.col("mom_12_1"), F.col("vol_126"))))
    return rows.select("ticker", "d", "close", *names)


def feature_panel(targets: DataFrame, prices: DataFrame, names: list[str], at: str = "ask") -> DataFrame:
    """For every (ticker, ask) the features of the latest day on or before it: one ordering of days and dates carries them along, so
    prices are neither looked up first nor joined again."""
    rows = features(prices, *names).select("ticker", F.col("d").alias("__t"), F.lit(0).alias("__side"), F.struct("d", *names).alias("__f"))
    asks = targets.select("ticker", F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(rows.dtypes)["__f"]).alias("__f"))
    seen = F.last("__f", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(asks).withColumn("__f", seen).where("__side = 1 and __f is not null")
    return both.select("ticker", F.col("__t").alias(at), "__f.*")


def relative_strength(prices: DataFrame, market: DataFrame, n: int = 126) -> DataFrame:
    """Each ticker's latest n-row return less the market's, each by its own rows."""
    def last_return(df: DataFrame, key: str) -> DataFrame:
        ends = latest(df, n + 1, key).groupBy(key).agg(F.max_by("close", "d").alias("z"), F.min_by("close", "d").alias("a"), F.count("*").alias("n"))
        return ends.select(key, F.when(F.col("n") == n + 1, ratio(F.col("z"), F.col("a")) - 1).alias("r"))

    one = last_return(market.withColumn("ticker", F.lit(0)), "ticker").select(F.col("r").alias("m"))
    return last_return(prices, "ticker").join(F.broadcast(one)).select("ticker", (F.col("r") - F.col("m")).alias("rel_strength"))  # one row


def residual_momentum(prices: DataFrame, market: DataFrame, lookback: int = 252, skip: int = 21, least: int = 120) -> DataFrame:
    """Mean over deviation of the residuals of a market regression, the most recent ``skip`` left out."""
    joined = prices.join(market.select("d", F.col("close").alias("m_close")), "d")
    recent = latest(joined, lookback + 1)
    w = Window.partitionBy("ticker").orderBy("d")
    prior, m_prior = F.lag("close").over(w), F.lag("m_close").over(w)
    rets = recent.select("ticker", "rn", F.when(prior > 0, F.col("close") / prior - 1).when(prior.isNotNull(), 0.0).alias("r"), F.when(m_prior > 0, F.col("m_close") / m_prior - 1).when(m_prior.isNotNull(), 0.0).alias("m")).where("r is not null")
    fit = rets.groupBy("ticker").agg(F.count("*").alias("n"), F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha"))
    resid = rets.join(fit, "ticker").where(F.col("n") >= least).withColumn("e", F.when(F.col("rn") > skip, F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")))
    return resid.groupBy("ticker").agg(F.when((F.count("e") >= 2) & (F.stddev_pop("e") > 0), F.try_divide(F.avg("e"), F.stddev_pop("e"))).alias("residual_momentum"), F.max("beta").alias("beta"))


def announcement_moves(announcements: DataFrame, prices: DataFrame, newest: int = 6) -> DataFrame:
    """Move from the last close on or before each announcement to the first close after it; the newest few per ticker.
    Validity intervals by lead(), then an as-of lookup."""
    steps = prices.select("ticker", "d", F.struct("close", F.lead("d").over(by_ticker()).alias("next_d"), F.lead("close").over(by_ticker()).alias("next_close")).alias("s"))
    rows = steps.select("ticker", F.col("d").alias("t"), F.lit(0).alias("side"), "s")
    asks = announcements.select("ticker", F.col("ask").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(dict(steps.dtypes)["s"]).alias("s"))
    seen = F.last("s", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    moves = rows.unionByName(asks).withColumn("s", seen).where("side = 1").select("ticker", F.col("t").alias("ask"), (ratio(F.col("s.next_close"), F.col("s.close")) - 1).alias("move")).where("move is not null")
    return moves.withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ask")))).where(F.col("nth") <= newest)
