"""Option surfaces, expiry selection and proxy tables. A chain is (ticker, expiry, side, strike, bid, ask, delta, iv, spot, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio


def quotes(chain: DataFrame) -> DataFrame:
    """Two-sided quotes of live expiries, with mid, relative width and days to expiry."""
    mid = (F.col("bid") + F.col("ask")) / 2
    dte = F.datediff("expiry", "day")
    return chain.where((F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))).withColumn("mid", mid).withColumn("width", ratio(F.col("ask") - F.col("bid"), mid)).withColumn("dte", dte).where("dte > 0")


def at_delta(rows: DataFrame, target: float, tolerance: float) -> DataFrame:
    """The contract nearest to |delta| = target on each (ticker, expiry, side), within the tolerance; the lower strike on ties."""
    gap = F.abs(F.abs(F.col("delta")) - target)
    pick = F.min_by(F.struct("strike", "mid", "width", "iv", "dte", "spot"), F.struct(gap.alias("g"), F.col("strike").alias("s")))
    return rows.where(gap <= tolerance).groupBy("ticker", "expiry", "side").agg(pick.alias("c")).select("ticker", "expiry", "side", "c.*")


def both_sides(rows: DataFrame) -> DataFrame:
    side = lambda s: rows.where(F.col("side") == s).select("ticker", "expiry", *[F.col(c).alias(f"{s}_{c}") for c in ("mid", "width", "iv", "dte", "spot")])
    return side("call").join(side("put"), ["ticker", "expiry"])


def surface(chain: DataFrame, widest: float = 0.5, skew_days: int = 30) -> DataFrame:
    """Per (ticker, expiry): at-the-money volatility and implied move (NULL if a leg's quote is too wide); per ticker the skew
    of the 25-delta contracts at the expiry nearest to ``skew_days``, on that expiry's row."""
    live = quotes(chain)
    atm = both_sides(at_delta(live, 0.5, 0.15))
    tight = (F.col("call_width") <= widest) & (F.col("put_width") <= widest)
    rows = atm.select("ticker", "expiry", F.col("call_dte").alias("dte"), ((F.col("call_iv") + F.col("put_iv")) / 2).alias("iv"), F.when(tight, ratio(F.col("call_mid") + F.col("put_mid"), F.col("call_spot"))).alias("move"))
    wings = both_sides(at_delta(live, 0.25, 0.1)).select("ticker", "expiry", (F.col("put_iv") - F.col("call_iv")).alias("skew"))
    near = F.row_number().over(Window.partitionBy("ticker").orderBy(F.abs(F.col("dte") - skew_days), "dte"))
    return rows.join(wings, ["ticker", "expiry"], "left").withColumn("__n", near).withColumn("skew", F.when(F.col("__n") == 1, F.col("skew"))).drop("__n")


def earnings_expiry(expiries: DataFrame, days: DataFrame, buffer: int = 1, gap: int = 20) -> DataFrame:
    """The first expiry inside [days + buffer, days + gap] of each ticker's next report."""
    met = expiries.join(days, "ticker").where(F.col("dte").between(F.col("days") + buffer, F.col("days") + gap))
    return met.groupBy("ticker").agg(F.min_by("expiry", "dte").alias("expiry"), F.min("dte").alias("dte"))


def pay_direction(rows: DataFrame) -> DataFrame:
    """Yearly pay and return, newest first: did both move the same way over the years shown?"""
    g = rows.where("pay is not null and total_return is not null").groupBy("ticker").agg(F.count("*").alias("years"), (F.max_by("pay", "year") - F.min_by("pay", "year")).alias("pay_change"), (F.max_by("total_return", "year") - F.min_by("total_return", "year")).alias("return_change"))
    return g.withColumn("aligned", F.when(F.col("years") >= 2, F.signum("pay_change") == F.signum("return_change")))


def concentrated(holders: DataFrame, least: float = 5.0, control: float = 50.0) -> DataFrame:
    """Holders of at least 5% by size, their sum, and whether it means control."""
    big = holders.where(F.col("percent") >= least)
    return big.groupBy("ticker").agg(F.count("*").alias("holders"), F.sum("percent").alias("total"), F.max_by("name", F.struct("percent", "name")).alias("largest")).withColumn("controlled", F.col("total") >= control)


def option_symbol(c: Column) -> list[Column]:
    """Parts of a contract symbol: root, expiry, side, strike."""
    pattern = r"^([A-Z.]{1,6})(\d{6})([CP])(\d{8})$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    ok = c.rlike(pattern)
    return [F.when(ok, part(1)).alias("root"), F.when(ok, F.to_date(F.try_to_timestamp(part(2), F.lit("yyMMdd")))).alias("expiry"), F.when(ok, F.when(part(3) == "C", "call").otherwise("put")).alias("side"), F.when(ok, part(4).try_cast("double") / 1000).alias("strike")]
