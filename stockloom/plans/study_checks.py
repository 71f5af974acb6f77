"""Bounds of a leg's effect on a ranking, pass rules and data checks of the persistence study, news events, streamed daily flows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.operators import backtest as B
from stockloom.operators import stories as N
from stockloom.operators import study as D
from stockloom.plans import research as R
from stockloom.plans import validation as V
from stockloom.session import checkpoint_dir
from stockloom.streaming import operators as O

_PCT = lambda x: f"CASE WHEN COUNT(*) OVER c > 1 THEN ({V._rank(x, 'm, kind, name')} - 1) / (COUNT(*) OVER c - 1) * 100 ELSE 50 END"
_BOUND = cte("signals") + f""", v AS (SELECT m, ticker, s2, s1 AS inc, 'reversed' AS kind, '' AS name, -s1 AS v FROM signals UNION ALL SELECT m, ticker, s2, s1, 'candidate', 's3', s3 FROM signals UNION ALL SELECT m, ticker, s2, s1, 'candidate', 'px', px FROM signals),
l AS (SELECT *, {_PCT('inc')} AS o, {_PCT('v')} AS n FROM v WINDOW c AS (PARTITION BY m, kind, name)), b AS (SELECT m, kind, name, ticker, ROUND((s2 * 0.001 + o * 0.5) / 0.501, 6) AS so, ROUND((s2 * 0.001 + n * 0.5) / 0.501, 6) AS sn FROM l),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, kind, name ORDER BY so DESC, ticker) AS p0, ROW_NUMBER() OVER (PARTITION BY m, kind, name ORDER BY sn DESC, ticker) AS p1 FROM b),
t AS (SELECT a.m, a.kind, a.name, SUM(SIGN(a.p0 - b.p0) * SIGN(a.p1 - b.p1)) / COUNT(*) AS tau FROM p a JOIN p b ON a.m = b.m AND a.kind = b.kind AND a.name = b.name AND a.ticker < b.ticker GROUP BY ALL),
o AS (SELECT m, kind, name, COUNT_IF(p0 <= 20 AND p1 <= 20) / LEAST(20, COUNT(*)) AS overlap FROM p GROUP BY ALL), q AS (SELECT * FROM o JOIN t USING (m, kind, name))"""
_LEGS = {"s2": 0.001, "s1": 0.5}


@register("bt20b_leg_churn", _BOUND + " SELECT m, kind, name, ROUND(tau, 6) AS tau, ROUND(overlap, 6) AS overlap FROM q")
def leg_churn(s, d):
    churn, _ = B.prize_bound(view(s, d, "signals"), _LEGS, "s1", ["s3", "px"])
    return churn.select("m", "kind", "name", F.round("tau", 6).alias("tau"), F.round("overlap", 6).alias("overlap"))


@register("bt20c_leg_verdict", _BOUND + """, w AS (SELECT m, tau AS worst, tau >= 0.95 AND overlap >= 0.9 AS inert FROM q WHERE kind = 'reversed'), c AS (SELECT m, BOOL_AND(tau >= 0.95 AND overlap >= 0.9) AS every FROM q WHERE kind = 'candidate' GROUP BY m)
SELECT m, ROUND(worst, 6) AS worst_tau, CASE WHEN inert THEN 'weight_inert' WHEN every THEN 'collinear' ELSE 'proceed' END AS verdict FROM w JOIN c USING (m)""")
def leg_verdict(s, d):
    return B.prize_bound(view(s, d, "signals"), _LEGS, "s1", ["s3", "px"])[1].select("m", F.round("worst_tau", 6).alias("worst_tau"), "verdict")


# ---------------------------------------------------------------- persistence study

_MEASURED = cte("stmts") + """, g AS (SELECT CAST(fiscal_year AS BIGINT) AS year, REGR_SLOPE(net_income / revenue, ln(revenue)) AS a, REGR_SLOPE(gross_profit / revenue, ln(revenue)) AS b, REGR_SLOPE(operating_cash_flow / revenue, ln(revenue)) AS c, STDDEV_SAMP(net_income / revenue) AS sd FROM stmts WHERE revenue > 0 GROUP BY 1),
x AS (SELECT year, a + 0.1 AS beta, sd AS se, b + 0.04 AS bound_held, c + 0.04 AS bound_not, a AS rank_beta, CASE WHEN year % 3 <> 0 THEN a + 0.08 END AS beta_sub, b + 0.08 AS hold_beta, sd AS hold_se, c + 0.09 AS hold_sub FROM g)"""


@register("ds11b_pass_rules", _MEASURED + """, r AS (SELECT year, COALESCE(beta >= GREATEST(0.10, 2.0 * se), FALSE) AS magnitude, bound_held >= 0.03 AND bound_not >= 0.03 AS bounds, rank_beta > 0 AS continuous_sign, COALESCE(beta > 0 AND beta_sub >= 0.5 * beta, FALSE) AS sub_industry,
  COALESCE(hold_beta >= GREATEST(0.06, 1.64 * hold_se), FALSE) AND COALESCE(hold_beta > 0 AND hold_sub >= 0.5 * hold_beta, FALSE) AS holdout FROM x) SELECT *, magnitude AND bounds AND continuous_sign AND sub_industry AND holdout AS passed FROM r""")
def pass_rules(s, d):
    """Slopes of margins on size, year by year, stand for the measures of a predictor."""
    x = view(s, d, "stmts").where("revenue > 0").withColumn("size", F.ln("revenue"))
    part = lambda c: F.try_divide(F.col(c), F.col("revenue"))
    x = x.select(F.col("fiscal_year").cast("long").alias("year"), "size", part("net_income").alias("a"), part("gross_profit").alias("b"), part("operating_cash_flow").alias("c"))
    g = x.groupBy("year").agg(*[F.regr_slope(n, "size").alias(n) for n in "abc"], F.stddev_samp("a").alias("sd"))
    m = g.select(
        "year", (F.col("a") + 0.1).alias("beta"), F.col("sd").alias("se"), (F.col("b") + 0.04).alias("bound_held"), (F.col("c") + 0.04).alias("bound_not"), F.col("a").alias("rank_beta"), F.when(F.col("year") % 3 != 0, F.col("a") + 0.08).alias("beta_sub"),
        (F.col("b") + 0.08).alias("hold_beta"), F.col("sd").alias("hold_se"), (F.col("c") + 0.09).alias("hold_sub"))
    return D.pass_rules(m).select("year", "magnitude", "bounds", "continuous_sign", "sub_industry", "holdout", "passed")


_CHECKED = R._COHORT + """, x AS (SELECT z.year, z.firm, z.state, CASE WHEN z.firm % 9 <> 0 THEN z.firm % 5 END AS c2, CASE WHEN z.firm % 9 <> 0 THEN z.firm % 25 END AS c3, CASE WHEN z.firm % 4 = 0 THEN NULL ELSE t.total_debt END AS debt, CASE WHEN z.firm % 6 = 0 THEN NULL ELSE t.revenue END AS rev, t.total_debt + t.total_equity AS assets FROM z JOIN stmts t ON t.entity = z.firm AND t.fiscal_year = z.year)"""


def _checked(s, d):
    t = view(s, d, "stmts").select(F.col("entity").alias("firm"), F.col("fiscal_year").alias("year"), "total_debt", "total_equity", F.col("revenue").alias("rev"))
    f = F.col("firm")
    z = R._cohort(s, d).select("firm", "year", "state").join(t, ["firm", "year"])
    coded = lambda n: F.when(f % 9 != 0, f % n)
    return z.select("firm", "year", "state", coded(5).alias("cell"), coded(25).alias("cell3"), F.when(f % 4 != 0, F.col("total_debt")).alias("debt"), F.when(f % 6 != 0, F.col("rev")).alias("revenue"), (F.col("total_debt") + F.col("total_equity")).alias("assets"))


@register("ds12b_data_checks", _CHECKED + """, a AS (SELECT *, COUNT(*) OVER (PARTITION BY year, c2) AS n2, COUNT(*) OVER (PARTITION BY year, c3) AS n3 FROM x)
SELECT year, ROUND(AVG(CASE WHEN c2 IS NOT NULL THEN CAST(n2 = 1 AS INT) END), 6) AS alone, ROUND(AVG(CASE WHEN c3 IS NOT NULL THEN CAST(n3 = 1 AS INT) END), 6) AS alone_fine, ROUND(AVG(CAST(COALESCE(debt, 0) = 0 AS INT)), 6) AS zero_debt, COUNT_IF(rev IS NULL AND assets >= 1000000) AS no_revenue,
ROUND(AVG(CAST(state = 'observed' AS INT)), 6) AS share_observed, ROUND(AVG(CAST(state = 'low_ic' AS INT)), 6) AS share_low_ic, ROUND(AVG(CAST(state = 'gap' AS INT)), 6) AS share_gap, ROUND(AVG(CAST(state = 'exit' AS INT)), 6) AS share_exit FROM a GROUP BY year""")
def data_checks(s, d):
    out = D.data_checks(_checked(s, d), 1_000_000.0)
    return out.select("year", *[c if c == "no_revenue" else F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("ds12c_size_and_gaps", "WITH y AS (SELECT CAST(YEAR(o_orderdate) AS INT) AS year, COUNT(*) AS n, AVG(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS rate FROM orders GROUP BY 1) SELECT a.year, a.n AS got, ABS(a.n - 2000) > 300 AS failed, COALESCE(a.rate - b.rate > 0.0005 AND a.rate - c.rate > 0.0005, FALSE) AS spike FROM y a LEFT JOIN y b ON b.year = a.year - 1 LEFT JOIN y c ON c.year = a.year + 1")
def size_and_gaps(s, d):
    """Orders of a year against an expected number, open ones as a rate that may spike."""
    y = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("rate"))
    failed = D.reproduction_failures(y, y.select("year", F.lit(2000).alias("expected"))).select("year", F.lit(True).alias("failed"))
    spikes = D.gap_spikes(y, 0.0005).select("year", F.lit(True).alias("spike"))
    mark = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return y.join(failed, "year", "left").join(spikes, "year", "left").select("year", F.col("n").alias("got"), mark("failed"), mark("spike"))


@register("ds12d_state_by_third", R._COHORT + " SELECT CASE WHEN rank < 1 / 3.0 THEN 'worst' WHEN rank < 2 / 3.0 THEN 'middle' ELSE 'best' END AS third, ROUND(AVG(CAST(state = 'gap' AS INT)), 6) AS share FROM z WHERE rank IS NOT NULL GROUP BY 1")
def state_by_third(s, d):
    return D.state_by_third(R._cohort(s, d), "rank", "gap").select("third", F.round("share", 6).alias("share"))


@register("ud07_coverage", cte("signals") + " SELECT m, COUNT(*) AS names, ROUND(AVG(CASE WHEN s1 > 0.05 THEN 1.0 ELSE 0 END), 6) AS s1_coverage, ROUND(AVG(CASE WHEN s3 > 0.04 THEN 1.0 ELSE 0 END), 6) AS s3_coverage FROM signals GROUP BY m")
def coverage(s, d):
    x = view(s, d, "signals").select("m", F.when(F.col("s1") > 0.05, F.col("s1")).alias("s1"), F.when(F.col("s3") > 0.04, F.col("s3")).alias("s3"))
    return x.groupBy("m").agg(F.count("*").alias("names"), *[F.round(B.covered(F.col(c)), 6).alias(f"{c}_coverage") for c in ("s1", "s3")])


# ---------------------------------------------------------------- news events, streamed flows


@register("tx06c_news_events")
def news_events(s, d):
    """First lines of documents as headlines, an article every six hours, ``source`` as the company; the strongest events of each."""
    text = F.regexp_extract("text", r"^[^\n]*", 0)
    docs = table(s, d, "documents").where("text is not null and source is not null")
    articles = docs.select(F.col("source").alias("ticker"), F.col("doc_id").alias("id"), F.timestamp_seconds(F.col("doc_id") * 21600).alias("ts"), F.substring(text, 1, 1000).alias("headline"), F.substring("text", 1, 1000).alias("summary"))
    graded = articles.withColumn("grade", F.when(F.col("headline").rlike(r"[$%&#]{3}"), 2).otherwise(1))
    return N.top_events(N.clusters(graded), 10).select("ticker", "event", "place", "face", "reports", "first_ts", "last_ts")


_FLOW = "x AS (SELECT o_custkey % 50 AS ticker, CAST(o_orderdate AS DATE) AS d, ROUND(SUM(CASE o_orderstatus WHEN 'P' THEN o_totalprice WHEN 'F' THEN -o_totalprice ELSE 0 END), 2) AS v FROM orders GROUP BY ALL), w AS (SELECT ticker, d, ROUND(SUM(v) OVER (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 183 DAY PRECEDING AND CURRENT ROW) + 0.0123, 1) AS flow FROM x)"


@register("st06b_streamed_flow", "WITH " + _FLOW + """, b AS (SELECT DISTINCT o_custkey % 50 AS ticker, o_custkey AS owner, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT x.ticker, x.d, COUNT(DISTINCT b.owner) AS buyers FROM (SELECT ticker, d FROM x) x LEFT JOIN b ON b.ticker = x.ticker AND b.d BETWEEN x.d - 183 AND x.d GROUP BY ALL)
SELECT w.ticker, w.d, flow, buyers, buyers >= 3 AS cluster FROM w JOIN k USING (ticker, d)""")
def streamed_flow(s, d):
    """Trades arrive as a stream of files; daily sums by owner are kept in a table by foreachBatch, the half-year flow and its buyers
    are windows over that small table."""
    base = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    view(s, d, "insider").select("ticker", "owner", "d", "code", "value").repartition(4).write.parquet(f"{base}/in")
    stream = s.readStream.schema("ticker long, owner long, d date, code string, value double").parquet(f"{base}/in")
    O.daily_owner_flow(stream, f"{base}/daily", f"{base}/state")
    return O.half_year_flow(s.read.parquet(f"{base}/daily")).select("ticker", "d", F.round(F.col("flow") + 0.0123, 1).alias("flow"), "buyers", (F.col("buyers") >= 3).alias("cluster"))
