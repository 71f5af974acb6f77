"""Queries over price series (time joins and trailing features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.bindings import cte, view
from stockloom.catalog import register
from stockloom.operators import prices as P

_W = "PARTITION BY ticker ORDER BY d"


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _prices(s, d):
    return view(s, d, "prices")


def _targets(s, d):
    """Quarter-end days for every ticker."""
    return _prices(s, d).select("ticker", F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("ask")).distinct()


_TARGETS = "t AS (SELECT DISTINCT ticker, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ask FROM prices)"


@register("src02_month_end_close", cte("prices") + " SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS month, ARG_MAX(close, d) AS close, MAX(d) AS d FROM prices GROUP BY 1, 2")
def month_end(s, d):
    return P.monthly_last(_prices(s, d))


@register("jn01_join_on_dates", cte("prices", "market") + " SELECT p.d, p.ticker, p.close AS close_a, m.close AS close_b FROM prices p JOIN market m USING (d)")
def join_dates(s, d):
    a = _prices(s, d).withColumn("pos", F.lit(0))
    return P.join_on_dates(a, view(s, d, "market").withColumn("pos", F.lit(0))).select("d", "ticker", "close_a", "close_b")


@register("jn02_as_of_close", cte("prices") + f", {_TARGETS} SELECT t.ticker, t.ask, p.d, p.close FROM t ASOF LEFT JOIN prices p ON t.ticker = p.ticker AND t.ask >= p.d")
def as_of_close(s, d):
    return P.as_of(_targets(s, d), _prices(s, d))


@register("jn03_nearest_day", cte("prices") + f""", {_TARGETS},
n AS (SELECT t.ticker, t.ask, p.d, p.close, ROW_NUMBER() OVER (PARTITION BY t.ticker, t.ask ORDER BY abs(p.d - t.ask), p.d) AS k
      FROM t JOIN prices p ON t.ticker = p.ticker AND p.d BETWEEN t.ask - 5 AND t.ask + 5)
SELECT ticker, ask, d, close FROM n WHERE k = 1""")
def nearest_day(s, d):
    return P.nearest(_targets(s, d), _prices(s, d), 5)


@register("jn04_month_close_near", cte("prices") + f""", {_TARGETS},
m AS (SELECT ticker, ARG_MAX(close, d) AS close, MAX(d) AS d FROM prices GROUP BY ticker, date_trunc('month', d)),
n AS (SELECT t.ticker, t.ask, m.d, m.close, ROW_NUMBER() OVER (PARTITION BY t.ticker, t.ask ORDER BY abs(m.d - t.ask), m.d) AS k
      FROM t JOIN m ON t.ticker = m.ticker AND abs(m.d - t.ask) <= 45)
SELECT ticker, ask, d, close FROM n WHERE k = 1""")
def month_close_near(s, d):
    return P.nearest(_targets(s, d), P.monthly_last(_prices(s, d)), 45)


@register("jn05_truncated_history", cte("prices") + f""", {_TARGETS}
SELECT t.ticker, t.ask, COUNT(p.close) AS n, ROUND(SUM(close) + 0.0000123, 3) AS sum_close, MIN(p.d) AS first_d FROM t LEFT JOIN prices p ON t.ticker = p.ticker AND p.d <= t.ask GROUP BY ALL""")
def truncated(s, d):
    return P.history_counts(_targets(s, d), _prices(s, d)).select("ticker", "ask", "n", F.round(F.col("sum_close") + 0.0000123, 3).alias("sum_close"), "first_d")


@register("ts01_sma", cte("prices") + f""" SELECT ticker, d, ROUND(CASE WHEN COUNT(close) OVER w >= 20 THEN AVG(close) OVER w END, 6) AS sma_20,
ROUND(CASE WHEN COUNT(close) OVER v >= 200 THEN close / AVG(close) OVER v - 1 END, 6) AS over_200 FROM prices
WINDOW w AS ({_W} ROWS 19 PRECEDING), v AS ({_W} ROWS 199 PRECEDING)""")
def sma(s, d):
    return P.features(_prices(s, d), "sma_20", "over_200").select("ticker", "d", _r("sma_20"), _r("over_200"))


@register("ts02_returns", cte("prices") + f""" SELECT ticker, d, ROUND(close / NULLIF(LAG(close, 63) OVER w, 0) - 1, 6) AS ret_63, ROUND(close / NULLIF(LAG(close, 126) OVER w, 0) - 1, 6) AS mom_6m,
ROUND(LAG(close, 21) OVER w / NULLIF(LAG(close, 273) OVER w, 0) - 1, 6) AS mom_12_1 FROM prices WINDOW w AS ({_W})""")
def returns(s, d):
    return _prices(s, d).select("ticker", "d", F.round(P.return_over(63), 6).alias("ret_63"), F.round(P.return_over(126), 6).alias("mom_6m"), F.round(P.return_between(274, 22), 6).alias("mom_12_1"))


_RET = f"r AS (SELECT *, CASE WHEN LAG(close) OVER w > 0 THEN close / LAG(close) OVER w - 1 WHEN LAG(close) OVER w IS NOT NULL THEN 0 END AS ret FROM prices WINDOW w AS ({_W}))"


@register("ts03_daily_returns", cte("prices") + f", {_RET} SELECT ticker, d, ROUND(ret, 6) AS ret FROM r WHERE ret IS NOT NULL")
def daily(s, d):
    return _prices(s, d).select("ticker", "d", F.round(P.daily_return(), 6).alias("ret")).where("ret is not null")


@register("ts04_volatility", cte("prices") + f", {_RET} SELECT ticker, d, ROUND(CASE WHEN COUNT(ret) OVER w >= 2 THEN STDDEV_SAMP(ret) OVER w * SQRT(252) END, 6) AS vol FROM r WINDOW w AS ({_W} ROWS 251 PRECEDING)")
def vol(s, d):
    return P.volatilities(_prices(s, d).withColumn("ret", P.nonzero_return()), vol=P.YEAR).select("ticker", "d", _r("vol"))


@register("ts05_max_drawdown", cte("prices") + f""", l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM prices),
f AS (SELECT ticker, close / MAX(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM l WHERE rn <= 252)
SELECT ticker, ROUND(CASE WHEN COUNT(*) >= 2 THEN LEAST(0.0, MIN(fall)) END, 6) AS max_drawdown FROM f GROUP BY ticker""")
def drawdown(s, d):
    return P.max_drawdown(_prices(s, d)).select("ticker", _r("max_drawdown"))


@register("ts06_near_high", cte("prices") + f" SELECT ticker, d, ROUND(CASE WHEN COUNT(*) OVER ({_W}) >= 200 THEN close / MAX(close) OVER ({_W} ROWS 251 PRECEDING) END, 6) AS near_high FROM prices")
def near_high(s, d):
    return P.features(_prices(s, d), "near_high").select("ticker", "d", _r("near_high"))


@register("ts07_largest_return", cte("prices") + f", {_RET} SELECT ticker, d, ROUND(CASE WHEN COUNT(*) OVER ({_W}) >= 22 THEN MAX(ret) OVER ({_W} ROWS 20 PRECEDING) END, 6) AS max_ret FROM r")
def largest(s, d):
    return _prices(s, d).withColumn("ret", P.daily_return()).select("ticker", "d", F.round(P.largest_return(), 6).alias("max_ret"))


@register("ts08_vol_scaled_momentum", cte("prices") + f""", {_RET}, v AS (SELECT ticker, d, LAG(close, 21) OVER ({_W}) / NULLIF(LAG(close, 273) OVER ({_W}), 0) - 1 AS mom,
CASE WHEN COUNT(ret) OVER ({_W} ROWS 125 PRECEDING) >= 2 THEN STDDEV_SAMP(ret) OVER ({_W} ROWS 125 PRECEDING) * SQRT(252) END AS vol FROM r)
SELECT ticker, d, ROUND(CASE WHEN vol > 1e-4 THEN mom / vol END, 6) AS vol_scaled FROM v""")
def vol_scaled(s, d):
    return P.features(_prices(s, d), "vol_scaled").select("ticker", "d", _r("vol_scaled"))


@register("ts09_relative_strength", cte("prices", "market") + """, a AS (SELECT ticker, d, close FROM prices UNION ALL SELECT NULL, d, close FROM market),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM a),
e AS (SELECT ticker, CASE WHEN COUNT(*) = 127 THEN ARG_MAX(close, d) / ARG_MIN(close, d) - 1 END AS r FROM l WHERE rn <= 127 GROUP BY ticker)
SELECT e.ticker, ROUND(e.r - m.r, 6) AS rel_strength FROM e, (SELECT r FROM e WHERE ticker IS NULL) m WHERE e.ticker IS NOT NULL""")
def rel_strength(s, d):
    return P.relative_strength(_prices(s, d), view(s, d, "market")).select("ticker", _r("rel_strength"))


@register("ts10_residual_momentum", cte("prices", "market") + f""", j AS (SELECT p.ticker, p.d, p.close, m.close AS mc, ROW_NUMBER() OVER (PARTITION BY p.ticker ORDER BY p.d DESC) AS rn FROM prices p JOIN market m USING (d)),
r AS (SELECT ticker, rn, close / LAG(close) OVER ({_W}) - 1 AS r, mc / LAG(mc) OVER ({_W}) - 1 AS m FROM j WHERE rn <= 253),
f AS (SELECT ticker, COUNT(*) AS n, REGR_SLOPE(r, m) AS beta, REGR_INTERCEPT(r, m) AS alpha FROM r WHERE r IS NOT NULL GROUP BY ticker),
e AS (SELECT ticker, beta, CASE WHEN rn > 21 THEN r - alpha - beta * m END AS e FROM r JOIN f USING (ticker) WHERE r IS NOT NULL AND n >= 120)
SELECT ticker, ROUND(AVG(e) / STDDEV_POP(e), 6) AS residual_momentum, ROUND(MAX(beta), 6) AS beta FROM e GROUP BY ticker""")
def residual(s, d):
    return P.residual_momentum(_prices(s, d), view(s, d, "market")).select("ticker", _r("residual_momentum"), _r("beta"))


@register("ts11_feature_panel", cte("prices") + f""", {_RET}, {_TARGETS}, f AS (SELECT ticker, d, close, CASE WHEN COUNT(close) OVER v >= 200 THEN close / AVG(close) OVER v - 1 END AS over_200,
close / LAG(close, 126) OVER w - 1 AS mom_6m, CASE WHEN COUNT(ret) OVER y >= 2 THEN STDDEV_SAMP(ret) OVER y * SQRT(252) END AS vol FROM r
WINDOW w AS ({_W}), v AS ({_W} ROWS 199 PRECEDING), y AS ({_W} ROWS 251 PRECEDING))
SELECT t.ticker, t.ask, f.d, ROUND(over_200, 6) AS over_200, ROUND(mom_6m, 6) AS mom_6m, ROUND(vol, 6) AS vol FROM t ASOF JOIN f ON t.ticker = f.ticker AND t.ask >= f.d""")
def panel(s, d):
    f = P.feature_panel(_targets(s, d), _prices(s, d), ["over_200", "mom_6m", "vol"])
    return f.select("ticker", "ask", "d", *(F.round(c, 6).alias(c) for c in ("over_200", "mom_6m", "vol")))


@register("ts12_announcement_moves", cte("prices") + f""", {_TARGETS}, s AS (SELECT *, LEAD(close) OVER ({_W}) AS nc FROM prices),
m AS (SELECT t.ticker, t.ask, s.nc / s.close - 1 AS move FROM t ASOF JOIN s ON t.ticker = s.ticker AND t.ask >= s.d WHERE s.nc IS NOT NULL),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ask DESC) AS nth FROM m) SELECT ticker, ask, ROUND(move, 6) AS move, nth FROM n WHERE nth <= 6""")
def moves(s, d):
    return P.announcement_moves(_targets(s, d), _prices(s, d)).select("ticker", "ask", _r("move"), "nth")
