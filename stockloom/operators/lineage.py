"""The screen's inputs from raw tables: prices, a market series, statements and insider trades to one wide row per name.

One pass over the price history gives all trailing measures (``prices.features``), the rest are grouped sums; the wide rows join on
the name alone, so that the whole goes from scans to cards in one job and scans read just the columns that some measure names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio
from stockloom.operators import events, fundamentals, prices

#: Trailing measures of the last day, by the names that the screen gives them.
TRAILING = {"over_200": "price_vs_200dma", "vol": "realized_vol", "near_high": "pct_to_52w_high", "max_ret": "max_daily_return", "vol_scaled": "vol_scaled_momentum", "close": "close"}
YEARLY = ["revenue", "gross_profit", "net_income", "operating_cash_flow", "total_debt", "total_equity", "diluted_shares"]


def price_inputs(history: DataFrame, market: DataFrame) -> DataFrame:
    """ticker and every measure of its prices: the last day's value of each (the last one there is of the long average)."""
    f = prices.features(history, *[c for c in TRAILING if c != "close"])
    last = f.groupBy("ticker").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("d")) if c == "over_200" else F.col("d")).alias(n) for c, n in TRAILING.items()])
    strength = prices.relative_strength(history, market).withColumnRenamed("rel_strength", "rel_strength_6m")
    residual = prices.residual_momentum(history, market).drop("beta")
    return last.join(prices.max_drawdown(history), "ticker", "left").join(strength, "ticker", "left").join(residual, "ticker", "left")


def statement_inputs(statements: DataFrame) -> DataFrame:
    """ticker, its newest year and what several years say."""
    g = statements.groupBy(F.col("entity").alias("ticker")).agg(
        *[F.max_by(c, "fiscal_year").alias(c) for c in YEARLY], fundamentals.cagr("revenue").alias("revenue_cagr"), fundamentals.cagr("operating_cash_flow").alias("fcf_cagr"), fundamentals.cagr("diluted_shares").alias("share_count_cagr"),
        fundamentals.stability(ratio(F.col("gross_profit"), F.col("revenue"))).alias("gross_margin_stability"))
    return g.join(fundamentals.persistence(statements, "revenue").select(F.col("entity").alias("ticker"), F.col("persistence").alias("revenue_growth_persistence")), "ticker", "left")


def insider_inputs(trades: DataFrame, floor: float = 0.0) -> DataFrame:
    """ticker, net flow, distinct buyers and the balance of buys and sells in -1..1."""
    f = events.flow(trades, floor)
    balance = ratio((F.col("buys") - F.col("sells")).cast("double"), (F.col("buys") + F.col("sells")).cast("double"))
    return f.select("ticker", F.col("net_value").alias("insider_net_6m"), F.col("buyers").cast("double").alias("insider_distinct_buyers"), balance.alias("insider_sentiment"))


def screen_inputs(history: DataFrame, market: DataFrame, statements: DataFrame, trades: DataFrame, sectors: DataFrame, lot: float = 1.0) -> DataFrame:
    """One row per name with prices and statements: everything that ``scoring.score`` reads of them. Market value is the last close
    times diluted shares times ``lot``."""
    m = price_inputs(history, market).join(statement_inputs(statements), "ticker").join(insider_inputs(trades), "ticker", "left").join(sectors, "ticker", "left")
    m = m.withColumn("market_cap", F.col("close") * F.col("diluted_shares") * lot)
    over = lambda a, b: ratio(F.col(a), F.col(b))
    return m.withColumns({
        "net_margin": over("net_income", "revenue"), "gross_margin": over("gross_profit", "revenue"), "debt_to_equity": over("total_debt", "total_equity"), "roe": over("net_income", "total_equity"),
        "roic": ratio(F.col("net_income"), F.col("total_debt") + F.col("total_equity")), "fcf": F.col("operating_cash_flow"), "fcf_yield": over("operating_cash_flow", "market_cap")})
