"""Queries over yearly statements, and the ranked screen built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.functions.columns import ratio
from stockloom.operators import fundamentals as U
from stockloom.operators import prices as P
from stockloom.operators import scoring as S


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _stmts(s, d):
    return view(s, d, "stmts")


@register("fn01_median_multiple", cte("stmts") + ", x AS (SELECT entity, revenue / NULLIF(net_income, 0) AS pe FROM stmts) SELECT entity, ROUND(CASE WHEN COUNT(pe) FILTER (pe <> 0) >= 2 THEN MEDIAN(pe) FILTER (pe <> 0) END, 6) AS median_pe FROM x GROUP BY entity")
def median_multiple(s, d):
    x = _stmts(s, d).withColumn("pe", ratio(F.col("revenue"), F.col("net_income")))
    return x.groupBy("entity").agg(F.round(U.median_multiple(F.col("pe")), 6).alias("median_pe"))


@register("fn02_mean_return", cte("stmts") + " SELECT entity, ROUND(CASE WHEN COUNT(*) >= 2 THEN AVG(net_income / NULLIF(total_debt + total_equity, 0)) END, 6) AS mean_roic FROM stmts GROUP BY entity")
def mean_return(s, d):
    return _stmts(s, d).groupBy("entity").agg(F.round(U.mean_at_least(ratio(F.col("net_income"), F.col("total_debt") + F.col("total_equity"))), 6).alias("mean_roic"))


@register("fn03_cagr", cte("stmts") + """, g AS (SELECT entity, COUNT(revenue) AS n, ARG_MIN(revenue, fiscal_year) AS a, ARG_MAX(revenue, fiscal_year) AS z FROM stmts GROUP BY entity)
SELECT entity, ROUND(CASE WHEN n >= 3 AND a > 0 AND z > 0 THEN POW(z / a, 1.0 / (n - 1)) - 1 END, 6) AS revenue_cagr FROM g""")
def cagr(s, d):
    return _stmts(s, d).groupBy("entity").agg(F.round(U.cagr("revenue"), 6).alias("revenue_cagr"))


@register("fn04_persistence", cte("stmts") + """, g AS (SELECT entity, CAST(revenue > LAG(revenue) OVER (PARTITION BY entity ORDER BY fiscal_year) AS DOUBLE) AS up FROM stmts)
SELECT entity, ROUND(CASE WHEN COUNT(*) >= 3 THEN AVG(up) END, 6) AS persistence FROM g GROUP BY entity""")
def persistence(s, d):
    return U.persistence(_stmts(s, d), "revenue").select("entity", _r("persistence"))


@register("fn05_margin_stability", cte("stmts") + ", g AS (SELECT entity, gross_profit / NULLIF(revenue, 0) AS gm FROM stmts) SELECT entity, ROUND(CASE WHEN COUNT(gm) >= 3 AND AVG(gm) > 0 THEN GREATEST(0, 1 - STDDEV_POP(gm) / AVG(gm)) END, 6) AS stability FROM g GROUP BY entity")
def stability(s, d):
    return _stmts(s, d).groupBy("entity").agg(F.round(U.stability(ratio(F.col("gross_profit"), F.col("revenue"))), 6).alias("stability"))


_TWO = """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY fiscal_year DESC) AS k FROM stmts),
t AS (SELECT a.entity, a.fiscal_year AS yt, b.fiscal_year AS yp, a.net_income AS nt, b.net_income AS np, a.operating_cash_flow AS ct, a.total_debt AS dt, b.total_debt AS dp, a.gross_profit AS gt, b.gross_profit AS gp, a.revenue AS rt, b.revenue AS rp, a.total_debt + a.total_equity AS at_, b.total_debt + b.total_equity AS ap
      FROM n a LEFT JOIN n b ON a.entity = b.entity AND b.k = 2 WHERE a.k = 1)"""


@register("fn06_six_tests", cte("stmts") + _TWO + """, x AS (SELECT entity, [nt > 0, ct > 0, ct > nt, CASE WHEN rt > 0 AND rp > 0 THEN nt / rt > np / rp END, CASE WHEN rt > 0 AND rp > 0 THEN dt / rt < dp / rp END, CASE WHEN rt > 0 AND rp > 0 THEN gt / rt > gp / rp END] AS tests FROM t)
SELECT entity, CAST(len(list_filter(tests, lambda x: x)) AS INT) AS won, CAST(len(list_filter(tests, lambda x: x IS NOT NULL)) AS INT) AS evaluated FROM x""")
def six_tests(s, d):
    return U.six_tests(_stmts(s, d))


@register("fn07_net_debt_and_yield", cte("stmts") + " SELECT entity, fiscal_year, ROUND(total_debt - operating_cash_flow, 2) AS net_debt, ROUND(CASE WHEN net_income > 0 AND total_equity + total_debt - operating_cash_flow > 0 THEN net_income / (total_equity + total_debt - operating_cash_flow) END, 6) AS ebit_yield FROM stmts")
def ebit_yield(s, d):
    nd = U.net_debt(F.col("total_debt"), F.col("operating_cash_flow"))
    return _stmts(s, d).select("entity", "fiscal_year", F.round(nd, 2).alias("net_debt"), F.round(U.ebit_yield(F.col("net_income"), F.col("total_equity"), nd), 6).alias("ebit_yield"))


@register("fn08_growth_and_accruals", cte("stmts") + _TWO + " SELECT entity, ROUND(CASE WHEN yt - yp = 1 THEN at_ / NULLIF(ap, 0) - 1 END, 6) AS asset_growth, ROUND(CASE WHEN yt - yp = 1 THEN (nt - ct) / NULLIF((at_ + ap) / 2, 0) END, 6) AS accruals FROM t")
def accruals(s, d):
    stmts = _stmts(s, d).withColumn("assets", F.col("total_debt") + F.col("total_equity"))
    return U.growth_and_accruals(stmts, "assets", "net_income", "operating_cash_flow").select("entity", _r("asset_growth"), _r("accruals"))


@register("fn09_shareholder_yield", cte("stmts") + " SELECT entity, fiscal_year, ROUND(CASE WHEN total_equity > 0 THEN (ABS(net_income) + ABS(operating_cash_flow) + ABS(total_debt) - ABS(gross_profit)) / total_equity END, 6) AS yield FROM stmts")
def holder_yield(s, d):
    c = F.col
    return _stmts(s, d).select("entity", "fiscal_year", F.round(U.shareholder_yield(c("net_income"), c("operating_cash_flow"), c("total_debt"), c("gross_profit"), c("total_equity")), 6).alias("yield"))


@register("fn10_surprise", cte("stmts") + """, g AS (SELECT entity, CASE WHEN COUNT(*) >= 3 THEN STDDEV_POP(100 * net_income / revenue) END AS sigma, ARG_MAX(100 * net_income / revenue, fiscal_year) AS last
  FROM stmts WHERE revenue <> 0 GROUP BY entity), a AS (SELECT *, CASE WHEN entity % 4 <> 0 THEN entity % 90 - 10 END AS days FROM g)
SELECT entity, ROUND(sigma, 6) AS sigma, ROUND(CASE WHEN sigma >= 1.0 THEN last / sigma * CASE WHEN days IS NULL OR days < 0 THEN 1 WHEN days >= 60 THEN 0 ELSE 1 - days / 60.0 END END, 6) AS sue FROM a""")
def surprise(s, d):
    x = 100 * ratio(F.col("net_income"), F.col("revenue"))
    g = _stmts(s, d).where("revenue <> 0").groupBy("entity").agg(U.dispersion(x).alias("sigma"), F.max_by(x, "fiscal_year").alias("last"))
    days = F.when(F.col("entity") % 4 != 0, F.col("entity") % 90 - 10)
    return g.select("entity", _r("sigma"), F.round(U.decayed(F.col("last"), F.col("sigma"), days), 6).alias("sue"))


@register("fn12_implied_growth", cte("stmts") + """, p AS (SELECT entity, operating_cash_flow AS v, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY fiscal_year DESC) AS k FROM stmts WHERE operating_cash_flow > 0),
c AS (SELECT entity, MAX(total_equity) AS cap FROM stmts GROUP BY entity)
SELECT c.entity, ROUND(CASE WHEN cap > 0 THEN 0.10 - MEDIAN(v) / cap END, 6) AS implied_growth FROM c LEFT JOIN p ON p.entity = c.entity AND k <= 3 GROUP BY c.entity, cap""")
def implied(s, d):
    return _stmts(s, d).groupBy("entity").agg(F.round(U.implied_growth(F.col("operating_cash_flow"), F.col("total_equity"), F.col("fiscal_year")), 6).alias("implied_growth"))


_RUN = """, h AS (SELECT * FROM stmts WHERE operating_cash_flow IS NOT NULL AND net_income IS NOT NULL AND total_debt > 0), i AS (SELECT *, fiscal_year + ROW_NUMBER() OVER (PARTITION BY entity ORDER BY fiscal_year DESC) AS g FROM h),
r AS (SELECT * FROM i QUALIFY g = MAX(g) OVER (PARTITION BY entity))"""


def _run(s, d):
    rows = _stmts(s, d).withColumn("owed", F.when(F.col("total_debt") > 0, F.col("total_debt")))
    return U.newest_run(rows, ["operating_cash_flow", "net_income", "owed"])


@register("fn14_newest_run", cte("stmts") + _RUN + " SELECT entity, COUNT(*) AS years, MIN(fiscal_year) AS first_year, MAX(fiscal_year) AS last_year FROM r GROUP BY entity")
def newest_run(s, d):
    return _run(s, d).groupBy("entity").agg(F.count("*").alias("years"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


@register("fn15_capital_table", cte("stmts") + _RUN + """, g AS (SELECT entity, COUNT(*) AS years, SUM(operating_cash_flow) AS cash, SUM(net_income) AS income, ARG_MIN(diluted_shares, fiscal_year) AS s0, ARG_MAX(diluted_shares, fiscal_year) AS s1,
ARG_MIN(total_debt + total_equity, fiscal_year) AS c0, ARG_MAX(total_debt + total_equity, fiscal_year) AS c1, ARG_MIN(net_income, fiscal_year) AS i0, ARG_MAX(net_income, fiscal_year) AS i1 FROM r GROUP BY entity)
SELECT entity, years, ROUND(cash, 2) AS cash, ROUND(income / NULLIF(cash, 0), 4) AS share_of_cash, ROUND(s1 / NULLIF(s0, 0) - 1, 6) AS share_change,
ROUND(CASE WHEN c0 > 0 AND c1 >= 1.05 * c0 AND years >= 2 THEN (i1 - i0) / (c1 - c0) END, 6) AS added_return, CASE WHEN years < 2 THEN 'one_year' WHEN c0 > 0 AND c1 >= 1.05 * c0 THEN 'ok' ELSE 'no_growth' END AS reason FROM g""")
def capital(s, d):
    return U.capital_table(_run(s, d)).select("entity", "years", _r("cash", 2), _r("share_of_cash", 4), _r("share_change"), _r("added_return"), "reason")


@register("fn16_regime", """WITH l AS (SELECT user_id, event_type AS name, ARG_MAX(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
h AS (SELECT user_id, COALESCE(BOOL_OR(name = 'click' AND v > 80 OR name = 'error' AND v > 90 OR name = 'view' AND v < 15), FALSE) AS off, COALESCE(BOOL_OR(name = 'purchase' AND v < 40 OR name = 'error' AND v < 30), FALSE) AS on_ FROM l GROUP BY user_id)
SELECT user_id, off, on_, CASE WHEN off THEN 'risk_off' WHEN on_ THEN 'risk_on' ELSE 'neutral' END AS regime FROM h""")
def macro(s, d):
    """The regime that each user's own series imply."""
    series = table(s, d, "events").select("user_id", F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("d"), "value")
    return U.regime(series, {"click": 80.0, "error": 90.0}, {"view": 15.0}, {"purchase": 40.0, "error": 30.0}, "user_id").withColumnRenamed("on", "on_")


# ---------------------------------------------------------------- screen


def metrics(s, d):
    """One row per entity: leg inputs from statements, prices and the supplier's nation (as a sector code)."""
    stmts, prices = _stmts(s, d), view(s, d, "prices")
    by_year = U.risen(stmts, "revenue").groupBy("entity").agg(
        U.persistent("revenue").alias("revenue_growth_persistence"),
        U.cagr("revenue").alias("revenue_cagr"), U.cagr("operating_cash_flow").alias("fcf_cagr"), U.stability(ratio(F.col("gross_profit"), F.col("revenue"))).alias("gross_margin_stability"), U.cagr("diluted_shares").alias("share_count_cagr"),
        *[F.max_by(c, "fiscal_year").alias(c) for c in ("revenue", "gross_profit", "net_income", "operating_cash_flow", "total_debt", "total_equity", "diluted_shares")])
    m = by_year.withColumnRenamed("entity", "ticker").join(P.standing(prices).withColumnRenamed("over_sma", "price_vs_200dma"), "ticker")
    sector = table(s, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_nationkey") % 5 == 0, 6022).when(F.col("s_nationkey") % 5 == 1, 6798).when(F.col("s_nationkey") % 5 == 2, 3571).alias("sic"))
    m = m.join(sector, "ticker", "left").withColumn("market_cap", F.col("close") * F.col("diluted_shares") * 100)
    return m.select("*", ratio(F.col("net_income"), F.col("revenue")).alias("net_margin"), ratio(F.col("gross_profit"), F.col("revenue")).alias("gross_margin"), ratio(F.col("total_debt"), F.col("total_equity")).alias("debt_to_equity"), ratio(F.col("net_income"), F.col("total_debt") + F.col("total_equity")).alias("roic"), F.col("operating_cash_flow").alias("fcf"), ratio(F.col("operating_cash_flow"), F.col("market_cap")).alias("fcf_yield"))


def _band(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, ({x} - {lo}) / ({hi} - {lo}))) * 100 END"


_INPUTS = ("net_margin", "debt_to_equity", "gross_margin", "gross_margin_stability", "roic", "revenue_cagr", "fcf_cagr", "revenue_growth_persistence", "price_vs_200dma", "fcf_yield", "max_drawdown")
_METRICS = cte("stmts", "prices") + """, y AS (SELECT entity AS ticker, COUNT(*) AS n, ARG_MIN(revenue, fiscal_year) AS r0, ARG_MIN(operating_cash_flow, fiscal_year) AS f0, ARG_MIN(diluted_shares, fiscal_year) AS s0, ARG_MAX(revenue, fiscal_year) AS revenue, ARG_MAX(gross_profit, fiscal_year) AS gp, ARG_MAX(net_income, fiscal_year) AS ni, ARG_MAX(operating_cash_flow, fiscal_year) AS fcf,
  ARG_MAX(total_debt, fiscal_year) AS debt, ARG_MAX(total_equity, fiscal_year) AS eq, ARG_MAX(diluted_shares, fiscal_year) AS sh, STDDEV_POP(gross_profit / NULLIF(revenue, 0)) AS gsd, AVG(gross_profit / NULLIF(revenue, 0)) AS gav FROM stmts GROUP BY 1),
up AS (SELECT entity AS ticker, CASE WHEN COUNT(*) >= 3 THEN AVG(up) END AS pers FROM (SELECT entity, CAST(revenue > LAG(revenue) OVER (PARTITION BY entity ORDER BY fiscal_year) AS DOUBLE) AS up FROM stmts) GROUP BY 1),
sm AS (SELECT ticker, ARG_MAX(close, d) AS close, ARG_MAX(x, d) FILTER (x IS NOT NULL) AS sma, MAX(d) AS d FROM (SELECT ticker, d, close, CASE WHEN COUNT(close) OVER w >= 200 THEN close / AVG(close) OVER w - 1 END AS x FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING)) GROUP BY 1),
dd AS (SELECT ticker, CASE WHEN COUNT(*) >= 2 THEN LEAST(0.0, MIN(fall)) END AS dd FROM (SELECT ticker, close / MAX(close) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM prices) WHERE rn <= 252) GROUP BY 1),
m AS (SELECT y.ticker, CASE s_nationkey % 5 WHEN 0 THEN 'financials' WHEN 1 THEN 'reit' WHEN 2 THEN 'other' ELSE 'unknown' END AS bucket, fcf, close * sh * 100 AS market_cap, ni / NULLIF(revenue, 0) AS net_margin, debt / NULLIF(eq, 0) AS debt_to_equity, gp / NULLIF(revenue, 0) AS gross_margin,
  CASE WHEN n >= 3 AND gav > 0 THEN GREATEST(0.0, 1 - gsd / gav) END AS gross_margin_stability, ni / NULLIF(debt + eq, 0) AS roic, CASE WHEN n >= 3 AND r0 > 0 AND revenue > 0 THEN POW(revenue / r0, 1.0 / (n - 1)) - 1 END AS revenue_cagr, CASE WHEN n >= 3 AND f0 > 0 AND fcf > 0 THEN POW(fcf / f0, 1.0 / (n - 1)) - 1 END AS fcf_cagr,
  CASE WHEN n >= 3 AND s0 > 0 THEN POW(sh / s0, 1.0 / (n - 1)) - 1 END AS share_count_cagr, pers AS revenue_growth_persistence, sma AS price_vs_200dma, fcf / NULLIF(close * sh * 100, 0) AS fcf_yield, dd AS max_drawdown
  FROM y JOIN up USING (ticker) JOIN sm USING (ticker) JOIN dd USING (ticker) LEFT JOIN supplier ON s_suppkey = y.ticker)"""
_LEGS_SQL = ", b AS (SELECT ticker, bucket, fcf, market_cap, debt_to_equity AS dte, revenue_cagr AS rc, revenue_growth_persistence AS rp, share_count_cagr AS sc, " + ", ".join(
    (f"CASE WHEN bucket NOT IN ('reit', 'financials') THEN {_band(x, *S.BANDS[x])} END" if x in S.MASKED_LEGS else _band(x, *S.BANDS[x])) + f" AS {x}" for x in _INPUTS) + " FROM m)"


def _sub(name: str) -> str:
    have = [x for x in S.LEGS[name] if x in _INPUTS]
    legs = "[" + ", ".join(have) + "]" if have else "[CAST(NULL AS DOUBLE)]"
    open_ = sum(x not in S.MASKED_LEGS for x in S.LEGS[name])
    need = f"CASE WHEN bucket = 'unknown' THEN 1 WHEN bucket IN ('reit', 'financials') THEN GREATEST(0.5 * {open_}, 0.001) ELSE {0.5 * len(S.LEGS[name])} END"
    return f"CASE WHEN len(list_filter({legs}, lambda x: x IS NOT NULL)) >= {need} THEN list_sum(list_filter({legs}, lambda x: x IS NOT NULL)) / len(list_filter({legs}, lambda x: x IS NOT NULL)) END AS {name}"


_CARDS = _METRICS + _LEGS_SQL + ", c AS (SELECT *, " + ", ".join(_sub(n) for n in S.LEGS) + " FROM b)"
_PARTS = [(n, w) for n, w in S.WEIGHTS.items()]
_NUM = " + ".join(f"COALESCE({n}, 0) * {w}" for n, w in _PARTS)
_DEN = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in _PARTS)
_HIDE = {"moat": "bucket IN ('reit', 'financials')"}
_APPL = " + ".join(f"CASE WHEN {_HIDE[n]} THEN 0 ELSE {w} END" if n in _HIDE else f"{w}" for n, w in _PARTS)


@register("sc01_leg_bands", _METRICS + _LEGS_SQL + " SELECT ticker, bucket, " + ", ".join(f"ROUND({x}, 6) AS {x}" for x in _INPUTS) + " FROM b")
def legs(s, d):
    m = metrics(s, d).withColumn("bucket", S.bucket(F.col("sic")))
    return m.select("ticker", "bucket", *[F.round(F.when(~S.masked(F.col("bucket"), S.MASKED_LEGS, x), S.leg(m, x)), 6).alias(x) for x in _INPUTS])


@register("sc05_sub_scores", _CARDS + " SELECT ticker, bucket, " + ", ".join(f"ROUND({n}, 6) AS {n}" for n in S.LEGS) + " FROM c")
def sub_scores(s, d):
    return S.score(metrics(s, d)).select("ticker", "bucket", *[_r(n) for n in S.LEGS])


@register("sc14_composite", _CARDS + f" SELECT ticker, ROUND(COALESCE(({_NUM}) / NULLIF({_DEN}, 0), 0), 6) AS composite_raw, ROUND(({_DEN}) / ({_APPL}), 3) AS confidence FROM c")
def composite(s, d):
    return S.score(metrics(s, d)).select("ticker", _r("composite_raw"), "confidence")


@register("sc16_gates_and_flags", _CARDS + """ SELECT ticker, list_filter([CASE WHEN fcf < 0 AND NOT COALESCE(rc >= 0.15 AND rp >= 0.70, FALSE) AND bucket NOT IN ('reit', 'financials') THEN 'negative_fcf' END, CASE WHEN market_cap < 3e8 THEN 'below_min_mktcap' END,
CASE WHEN dte > 5 AND dte <= 20 AND bucket NOT IN ('reit', 'financials') THEN 'over_leveraged' END], lambda x: x IS NOT NULL) AS gates,
list_filter([CASE WHEN sc >= 0.03 THEN 'dilution' END, CASE WHEN fcf < 0 THEN 'cash_burn' END, CASE WHEN value >= 60 AND (COALESCE(quality < 40, FALSE) OR COALESCE(growth < 40, FALSE)) THEN 'value_trap' END], lambda x: x IS NOT NULL) AS flags FROM c""")
def gates_and_flags(s, d):
    return S.score(metrics(s, d)).select("ticker", "gates", "flags")


@register("sc19_ranked_screen", _CARDS + f""", q AS (SELECT ticker, bucket, ROUND(COALESCE(({_NUM}) / NULLIF({_DEN}, 0), 0), 1) AS composite, ROUND(({_DEN}) / ({_APPL}), 3) AS confidence, ({_DEN}) > 0 AS any_ FROM c),
z AS (SELECT *, any_ AND (bucket = 'unknown' OR confidence >= 0.25) AS scored FROM q) SELECT ticker, composite, confidence, scored, CAST(ROW_NUMBER() OVER (ORDER BY scored DESC, composite DESC, confidence DESC, ticker) AS INT) AS place FROM z""")
def screen(s, d):
    """The whole screen: derive, score, cover, rank."""
    return S.ranked(S.score(metrics(s, d))).select("ticker", "composite", "confidence", "scored", "place")
