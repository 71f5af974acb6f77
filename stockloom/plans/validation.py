"""Queries that validate signals against later returns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.bindings import cte, view
from stockloom.catalog import register
from stockloom.functions.ranks import average_rank, ic_summary, percentile_score
from stockloom.operators import backtest as B
from stockloom.operators import prices as P
from stockloom.session import written


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _rows(s, d, horizon: int = 3):
    return B.forward_returns(view(s, d, "signals"), horizon)


def _long(s, d):
    return B.long(_rows(s, d).select("m", "ticker", "fwd", "s1", F.col("s2").cast("double").alias("s2"), "s3"), ["s1", "s2", "s3"], ["m", "ticker", "fwd"])


_FWD = "f AS (SELECT a.*, b.px / NULLIF(a.px, 0) - 1 AS fwd FROM signals a JOIN signals b ON a.ticker = b.ticker AND b.m = a.m + 3)"
_LONG = _FWD + ", l AS (SELECT m, ticker, fwd, 's1' AS signal, s1 AS value FROM f UNION ALL SELECT m, ticker, fwd, 's2', s2 FROM f UNION ALL SELECT m, ticker, fwd, 's3', s3 FROM f)"


def _rank(x: str, by: str) -> str:
    return f"(RANK() OVER (PARTITION BY {by} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def _ic(source: str, x: str, y: str, by: str, least: int = 3) -> str:
    return f"""(SELECT {by}, COUNT(*) AS n, CASE WHEN COUNT(*) >= 3 AND STDDEV_POP(rx) * STDDEV_POP(ry) > 1e-12 THEN COVAR_POP(rx, ry) / (STDDEV_POP(rx) * STDDEV_POP(ry)) END AS ic
FROM (SELECT {by}, {_rank(x, by)} AS rx, {_rank(y, by)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by} HAVING COUNT(*) >= {least})"""


_SUMMARY = "COUNT(*) AS n, ROUND(AVG(ic), 6) AS mean_ic, ROUND(COALESCE(STDDEV_SAMP(ic), 0), 6) AS sd_ic, ROUND(COUNT_IF(ic > 0) / COUNT(*), 6) AS hit_rate, ROUND(AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0), 6) AS icir, ROUND(AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0) * SQRT(COUNT(*)), 5) AS t_stat"


def _summary(df):
    return df.select(*[c for c in df.columns if c not in ("mean_ic", "sd_ic", "hit_rate", "icir", "t_stat")], _r("mean_ic"), _r("sd_ic"), _r("hit_rate"), _r("icir"), _r("t_stat", 5))


@register("bt00_momentum_ic", cte("prices") + f""", g AS (SELECT CAST(unnest(generate_series(DATE '1996-06-15', DATE '2001-05-15', INTERVAL 3 MONTH)) AS DATE) AS ask),
w AS (SELECT ticker, d, close / LAG(close, 126) OVER (PARTITION BY ticker ORDER BY d) - 1 AS mom, close FROM prices),
o AS (SELECT k.ticker, g.ask, w.mom AS value, w.close FROM g CROSS JOIN (SELECT DISTINCT ticker FROM prices) k ASOF JOIN w ON w.ticker = k.ticker AND g.ask >= w.d),
e AS (SELECT o.ticker, o.ask, p.close, ROW_NUMBER() OVER (PARTITION BY o.ticker, o.ask ORDER BY abs(p.d - CAST(o.ask + INTERVAL 3 MONTH AS DATE)), p.d) AS k
      FROM o JOIN prices p ON p.ticker = o.ticker AND abs(p.d - CAST(o.ask + INTERVAL 3 MONTH AS DATE)) <= 5),
r AS (SELECT o.ask, o.value, e.close / o.close - 1 AS fwd FROM o JOIN e ON e.ticker = o.ticker AND e.ask = o.ask AND e.k = 1)
SELECT {_SUMMARY} FROM {_ic("r", "value", "fwd", "ask")} WHERE ic IS NOT NULL""")
def momentum_ic(s, d):
    """Does momentum predict the next quarter's return? Scan, window, as-of join, nearest join, rank, correlation, summary."""
    prices = view(s, d, "prices")
    grid = B.grid(s, date(1996, 6, 15), date(2001, 5, 15), 3).withColumnRenamed("d", "ask")
    asks = prices.select("ticker").distinct().crossJoin(F.broadcast(grid))  # tickers by a few dates: the observation grid itself
    feature = prices.select("ticker", "d", F.struct("close", P.return_over(126).alias("mom")).alias("x"))
    rows = feature.select("ticker", F.col("d").alias("t"), F.lit(0).alias("side"), "x").unionByName(asks.select("ticker", F.col("ask").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(dict(feature.dtypes)["x"]).alias("x")))
    seen = F.last("x", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    now = rows.withColumn("x", seen).where("side = 1 and x is not null").select("ticker", F.col("t").alias("ask"), F.col("x.mom").alias("value"), F.col("x.close").alias("close"), F.add_months("t", 3).alias("later"))
    ends = P.nearest(now.select("ticker", "later"), prices, 5, "later").select("ticker", "later", F.col("close").alias("end_close"))
    pairs = now.join(ends, ["ticker", "later"]).withColumn("fwd", F.try_divide("end_close", "close") - 1)
    from stockloom.functions.ranks import spearman_by

    return _summary(ic_summary(spearman_by(pairs, "value", "fwd", "ask")))


@register("bt01_grid", """SELECT CAST(d AS DATE) AS d FROM (VALUES ('1998-10-31'), ('1999-01-31'), ('1999-04-30'), ('1999-07-30'), ('1999-10-30')) x(d) WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderdate >= d::DATE)""")
def grid(s, d):
    """The clamp to 30 April sticks. Only dates that orders still reach."""
    from stockloom.bindings import table

    last = table(s, d, "orders").agg(F.max("o_orderdate").alias("last"))
    return B.grid(s, date(1998, 10, 31), date(1999, 12, 1), 3).join(last, F.col("d") <= F.col("last")).select("d")


@register("bt02_forward_return", cte("signals") + f", {_FWD}, k AS (SELECT m, AVG(px) AS px FROM signals GROUP BY m), g AS (SELECT a.m, b.px / a.px - 1 AS mkt FROM k a JOIN k b ON b.m = a.m + 3) SELECT ticker, m, ROUND(fwd, 6) AS fwd, ROUND(fwd - mkt, 5) AS excess FROM f JOIN g USING (m)")
def forward(s, d):
    market = view(s, d, "signals").groupBy("m").agg(F.avg("px").alias("px"))
    return B.excess(_rows(s, d), market, 3).select("ticker", "m", _r("fwd"), _r("excess", 5))


@register("bt03_observations", cte("signals") + f", {_LONG} SELECT m, ticker, signal, ROUND(value, 6) AS value, ROUND(fwd, 6) AS fwd FROM l")
def observations(s, d):
    return _long(s, d).select("m", "ticker", "signal", _r("value"), _r("fwd"))


@register("bt04_average_rank", cte("signals") + f" SELECT ticker, m, {_rank('s1', 'm')} AS r1, {_rank('s2', 'm')} AS r2 FROM signals")
def ranks(s, d):
    return view(s, d, "signals").select("ticker", "m", average_rank("s1", "m").alias("r1"), average_rank("s2", "m").alias("r2"))


@register("bt05_spearman_ic", cte("signals") + f", {_LONG} SELECT signal, m, n, ROUND(ic, 6) AS ic FROM {_ic('l', 'value', 'fwd', 'signal, m')}")
def ic(s, d):
    return B.ics(_long(s, d), "m", 1).select("signal", "m", "n", _r("ic"))


@register("bt06_ic_summary", cte("signals") + f", {_LONG} SELECT signal, {_SUMMARY} FROM {_ic('l', 'value', 'fwd', 'signal, m', 5)} WHERE ic IS NOT NULL GROUP BY signal")
def summary(s, d):
    return _summary(ic_summary(B.ics(_long(s, d), "m", 5), "signal"))


@register("bt07_signal_reports", cte("signals") + f", {_LONG} SELECT 'cross_section' AS kind, signal, {_SUMMARY} FROM {_ic('l', 'value', 'fwd', 'signal, m', 5)} WHERE ic IS NOT NULL GROUP BY signal UNION ALL SELECT 'time_series', signal, {_SUMMARY} FROM {_ic('l', 'value', 'fwd', 'signal, ticker', 12)} WHERE ic IS NOT NULL GROUP BY signal")
def signal_reports(s, d):
    return _summary(B.reports(_long(s, d)))


@register("bt08_quantile_spread", cte("signals") + f""", {_LONG}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY signal ORDER BY value, fwd, ticker, m) AS place, COUNT(*) OVER (PARTITION BY signal) AS n FROM l),
b AS (SELECT signal, fwd, (SELECT MIN(b) FROM range(1, 6) t(b) WHERE round_even(b * n / LEAST(5, n), 0) >= place) AS bucket FROM p),
a AS (SELECT signal, CAST(bucket AS INT) AS bucket, COUNT(*) AS n, AVG(fwd) AS mean_fwd FROM b GROUP BY 1, 2)
SELECT signal, bucket, n, ROUND(mean_fwd, 6) AS mean_fwd, COALESCE(mean_fwd >= LAG(mean_fwd) OVER (PARTITION BY signal ORDER BY bucket), TRUE) AS rising FROM a""")
def spread(s, d):
    return B.quantile_spread(_long(s, d)).select("signal", "bucket", "n", _r("mean_fwd"), "rising")


@register("bt09_cross_signal", cte("signals") + f" SELECT m, n, ROUND(ic, 6) AS ic FROM {_ic('signals', 's1', 's3', 'm')}")
def cross_signal(s, d):
    return B.cross_correlation(view(s, d, "signals"), "s1", "s3").select("m", "n", _r("ic"))


@register("bt10_ols", cte("signals") + f", {_FWD} SELECT m, COUNT(*) AS n, ROUND(REGR_SLOPE(fwd, s1), 4) AS slope, ROUND(REGR_INTERCEPT(fwd, s1), 4) AS intercept FROM f GROUP BY m")
def ols(s, d):
    return B.simple_ols(_rows(s, d), "fwd", "s1", "m").select("m", "n", _r("slope", 4), _r("intercept", 4))


@register("bt10b_ols_two", cte("signals") + f""", {_FWD}, g AS (SELECT m, VAR_POP(s1) AS aa, VAR_POP(s3) AS bb, COVAR_POP(s1, s3) AS ab, COVAR_POP(s1, fwd) AS ay, COVAR_POP(s3, fwd) AS by_ FROM f GROUP BY m)
SELECT m, ROUND((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS beta_a, ROUND((by_ * aa - ay * ab) / (aa * bb - ab * ab), 3) AS beta_b FROM g WHERE aa * bb - ab * ab > 1e-12 * aa * bb""")
def ols_two(s, d):
    return B.two_regressor_ols(_rows(s, d), "fwd", "s1", "s3", "m").where("beta_a is not null").select("m", _r("beta_a", 3), _r("beta_b", 3))


_RESID = f"""k AS (SELECT m, ticker, fwd, {_rank('s1', 'm')} AS y, {_rank('s3', 'm')} AS x FROM f WHERE s1 IS NOT NULL AND s3 IS NOT NULL),
z AS (SELECT m, REGR_SLOPE(y, x) AS slope, REGR_INTERCEPT(y, x) AS intercept FROM k GROUP BY m HAVING COUNT(*) >= 10),
e AS (SELECT m, ticker, fwd, ROUND(y - intercept - slope * x, 6) AS residual FROM k JOIN z USING (m) WHERE slope IS NOT NULL)"""


def _resid(s, d):
    return B.residual_signal(_rows(s, d), "s1", "s3").select("m", "ticker", "fwd", _r("residual"))


@register("bt11_residual_signal", cte("signals") + f", {_FWD}, {_RESID} SELECT m, ticker, residual FROM e")
def residual(s, d):
    return _resid(s, d).select("m", "ticker", "residual")


@register("bt12_paired_ic", cte("signals") + f", {_FWD}, i AS {_ic('f', 's1', 'fwd', 'm')}, j AS {_ic('f', 's3', 'fwd', 'm')}, q AS (SELECT i.ic - j.ic AS ic FROM i JOIN j USING (m) WHERE i.ic IS NOT NULL AND j.ic IS NOT NULL) SELECT {_SUMMARY} FROM q")
def paired(s, d):
    from stockloom.functions.ranks import spearman_by

    rows = _rows(s, d)
    return _summary(B.paired_difference(spearman_by(rows, "s1", "fwd", "m"), spearman_by(rows, "s3", "fwd", "m")))


_CANDIDATES = [{"s1": 1.0, "s3": 1.0}, {"s1": 2.0, "s3": 1.0}, {"s1": 1.0, "s3": 3.0}]


@register("bt13_weight_ic", cte("signals") + f""", {_FWD}, k AS (SELECT m, fwd, ({_rank('s1', 'm')} - 0.5) / COUNT(*) OVER (PARTITION BY m) AS s1, ({_rank('s3', 'm')} - 0.5) / COUNT(*) OVER (PARTITION BY m) AS s3 FROM f),
c AS (SELECT m, fwd, 0 AS candidate, ROUND((s1 + s3) / 2, 9) AS value FROM k UNION ALL SELECT m, fwd, 1, ROUND((2 * s1 + s3) / 3, 9) FROM k UNION ALL SELECT m, fwd, 2, ROUND((s1 + 3 * s3) / 4, 9) FROM k)
SELECT candidate, {_SUMMARY} FROM {_ic('c', 'value', 'fwd', 'candidate, m')} WHERE ic IS NOT NULL GROUP BY candidate""")
def weight_ic(s, d):
    return _summary(B.blend_ic(_rows(s, d), _CANDIDATES))


@register("bt13b_fit_weights")
def fit(s, d):
    got = B.walk_forward(_rows(s, d), {"s1": 0.5, "s3": 0.5})
    w = got["weights"] or {}
    figures = [w.get("s1"), w.get("s3"), *(got[k] for k in ("prior_oos_ic", "oos_ic", "shrunk_oos_ic", "in_sample_ic"))]
    row = (got["n_periods"], *[None if v is None else round(v, 6) for v in figures], [round(x, 6) for x in got["fold_diffs"]])
    return s.createDataFrame([row], "n_periods int, s1 double, s3 double, prior_oos_ic double, oos_ic double, shrunk_oos_ic double, in_sample_ic double, fold_diffs array<double>")


_GATED = [{"s1": 1.0, "s2": 1.0, "s3": 1.0}, {"s1": 3.0, "s2": 1.0, "s3": 1.0}, {"s1": 1.0, "s2": 3.0, "s3": 1.0}, {"s1": 1.0, "s2": 1.0, "s3": 3.0}]
_PCT = ", ".join(f"({_rank(x, 'm')} - 0.5) / COUNT(*) OVER (PARTITION BY m) AS {x}" for x in ("s1", "s2", "s3"))


@register("bt14_gate", cte("signals") + f""", {_FWD}, k AS (SELECT m, fwd, {_PCT} FROM f),
c AS ({" UNION ALL ".join(f"SELECT m, fwd, {i} AS candidate, ROUND(({w['s1']} * s1 + {w['s2']} * s2 + {w['s3']} * s3) / {sum(w.values())}, 9) AS value FROM k" for i, w in enumerate(_GATED))}),
i AS (SELECT * FROM {_ic('c', 'value', 'fwd', 'candidate, m')}), p AS (SELECT m, ROW_NUMBER() OVER (ORDER BY m) - 1 AS pk, COUNT(*) OVER () AS np FROM (SELECT DISTINCT m FROM i)),
j AS (SELECT candidate, ic, np, CAST(FLOOR(pk / GREATEST(1, FLOOR(np / 6))) AS INT) AS fold FROM i JOIN p USING (m) WHERE ic IS NOT NULL),
h AS (SELECT candidate, fold, np, AVG(ic) AS ic FROM j WHERE fold BETWEEN 1 AND 5 GROUP BY candidate, fold, np),
q AS (SELECT a.candidate, a.ic - b.ic AS diff, a.np FROM h a JOIN h b ON b.candidate = 0 AND b.fold = a.fold WHERE a.candidate <> 0),
v AS (SELECT candidate, MAX(np) AS np, COUNT(*) AS folds, AVG(diff) AS edge, COUNT_IF(diff > 0) AS positive, AVG(diff) / NULLIF(STDDEV_SAMP(diff), 0) * SQRT(COUNT(*)) AS t FROM q GROUP BY candidate)
SELECT candidate, folds, ROUND(edge, 6) AS edge, positive, ROUND(t, 5) AS t_stat, CASE WHEN np < 36 THEN 'periods' WHEN folds < 5 THEN 'folds' WHEN edge < 0.02 THEN 'edge' WHEN positive < CEIL(0.8 * folds) THEN 'agreement' WHEN t IS NULL OR t < 2 THEN 'significance' ELSE 'endorsed' END AS verdict FROM v""")
def gate(s, d):
    """Blends of three signals against equal weights, judged on held-out folds."""
    diffs = B.fold_differences(B.blend_ics(_rows(s, d), _GATED), 0, 6)
    return B.gate(diffs).select("candidate", "folds", _r("edge"), "positive", F.round("t_stat", 5).alias("t_stat"), "verdict")


@register("bt18_percentile_score", cte("signals") + f" SELECT ticker, m, ROUND(CASE WHEN COUNT(*) OVER (PARTITION BY m) > 1 THEN ({_rank('s1', 'm')} - 1) / (COUNT(*) OVER (PARTITION BY m) - 1) * 100 ELSE 50 END, 6) AS score, ROW_NUMBER() OVER (PARTITION BY m ORDER BY s1 DESC, ticker) AS place FROM signals")
def percentile(s, d):
    w = Window.partitionBy("m").orderBy(F.desc("s1"), "ticker")
    return view(s, d, "signals").select("ticker", "m", F.round(percentile_score("s1", "m"), 6).alias("score"), F.row_number().over(w).alias("place"))


@register("bt19_overlap_and_tau", cte("signals") + """, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m ORDER BY s1 DESC, ticker) AS p1, ROW_NUMBER() OVER (PARTITION BY m ORDER BY s3 DESC, ticker) AS p3 FROM signals),
o AS (SELECT m, COUNT_IF(p1 <= 10 AND p3 <= 10) / 10.0 AS overlap FROM p GROUP BY m),
t AS (SELECT a.m, COUNT(*) AS pairs, SUM(SIGN(a.s1 - b.s1) * SIGN(a.s3 - b.s3)) / COUNT(*) AS tau FROM signals a JOIN signals b ON a.m = b.m AND a.ticker < b.ticker GROUP BY a.m)
SELECT m, CAST(overlap AS DOUBLE) AS overlap, ROUND(tau, 6) AS tau, pairs FROM o JOIN t USING (m)""")
def churn(s, d):
    rows = written(view(s, d, "signals"))  # read three times
    place = lambda c: rows.select("m", "ticker", F.row_number().over(Window.partitionBy("m").orderBy(F.desc(c), "ticker")).alias("place"))
    o = B.overlap(place("s1"), place("s3"), 10)
    return B.kendall(rows, "s1", "s3").join(o, "m", "left").select("m", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), _r("tau"), "pairs")


@register("bt20_leg_bound", cte("signals") + f""", lr AS (SELECT m, ticker, ({_rank("s1", "m")} - 0.5) / COUNT(*) OVER (PARTITION BY m) AS s1, ({_rank("s3", "m")} - 0.5) / COUNT(*) OVER (PARTITION BY m) AS s3 FROM signals),
lo AS (SELECT m, ticker, 'base' AS kind, 0 AS trial, s1 + s3 AS score FROM lr UNION ALL SELECT m, ticker, 'reversed', 0, s1 + 1 - s3 FROM lr
  UNION ALL SELECT m, ticker, 'random', CAST(t AS INT), s1 + CAST('0x' || substr(md5('7:' || t || ':' || ticker || ':' || m), 1, 7) AS BIGINT) / 268435456.0::DOUBLE FROM lr, range(1, 21) x(t)),
lp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, kind, trial ORDER BY ROUND(score, 9) DESC, ticker) AS place FROM lo QUALIFY place <= 10), lb AS (SELECT m, ticker FROM lp WHERE kind = 'base')
SELECT lp.m, kind, trial, COUNT(lb.ticker) / 10.0::DOUBLE AS overlap FROM lp LEFT JOIN lb ON lb.m = lp.m AND lb.ticker = lp.ticker WHERE kind <> 'base' GROUP BY ALL""")
def leg_bound(s, d):
    return B.leg_bound(view(s, d, "signals"), ["s1", "s3"], "s3", trials=20, seed=7, top=10)
