"""Presence of values, grids of single names, grouped solves, captures and streamed fact versions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.functions import columns as C
from stockloom.operators import backtest as B
from stockloom.operators import flatten as L
from stockloom.operators import merge as M
from stockloom.operators import prices as P
from stockloom.plans import validation as V
from stockloom.session import checkpoint_dir
from stockloom.sources import store
from stockloom.streaming import operators as O


@register("flt09_presence", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN 0.0 ELSE o_totalprice END AS v, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus END AS s FROM orders)
SELECT o_orderkey, v IS NOT NULL AND NOT isnan(v) AS scored, v IS NOT NULL AS merged, s IS NOT NULL AND s <> '' AS said, ROUND(CASE WHEN v IS NULL OR isnan(v) THEN o_orderkey ELSE v END, 2) AS first_present FROM x""")
def presence(s, d):
    """Scores treat NaN as missing, merges do not; an empty text is missing, a zero is not."""
    k = F.col("o_orderkey")
    v = F.when(k % 5 == 1, float("nan")).when(k % 5 == 2, 0.0).when(k % 5 != 0, F.col("o_totalprice"))
    t = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("o_orderstatus"))
    x = table(s, d, "orders").select("o_orderkey", v.alias("v"), t.alias("s"))
    return x.select("o_orderkey", C.present(F.col("v")).alias("scored"), F.col("v").isNotNull().alias("merged"), (F.coalesce("s", F.lit("")) != "").alias("said"), F.round(F.coalesce(C.clean(F.col("v")), F.col("o_orderkey").cast("double")), 2).alias("first_present"))


@register("bt01b_grids_of_names", cte("prices") + """, r AS (SELECT ticker, MIN(d) AS a, MAX(d) AS z FROM prices GROUP BY ticker), k AS (SELECT ticker, a, z, unnest(range(0, 60)) AS k FROM r), m AS (SELECT *, CAST(date_trunc('month', a) + INTERVAL (2 * k) MONTH AS DATE) AS first FROM k),
c AS (SELECT *, MIN(DAY(last_day(first))) OVER (PARTITION BY ticker ORDER BY k) AS least FROM m) SELECT ticker, first + CAST(LEAST(DAY(a), least) - 1 AS INT) AS ask FROM c WHERE first + CAST(LEAST(DAY(a), least) - 1 AS INT) <= z""")
def grids(s, d):
    """Each name's own observation dates, every second month from its first day; a clamp to a month's end sticks."""
    r = view(s, d, "prices").groupBy("ticker").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return r.select("ticker", F.explode(B.grid_column(F.col("a"), F.col("z"), 2)).alias("ask"))


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Least squares of one group from its moments: a k x k solve."""
    import numpy as np

    r = rows.iloc[0]
    a = np.array([[r.aa, r.ab], [r.ab, r.bb]], float)
    if np.linalg.matrix_rank(a, tol=1e-12 * max(r.aa, r.bb, 1e-300)) < 2:
        return rows.assign(beta_a=None, beta_b=None)[["m", "beta_a", "beta_b"]]
    b = np.linalg.solve(a, np.array([r.ay, r.yb], float))
    return pd.DataFrame({"m": [r.m], "beta_a": [b[0]], "beta_b": [b[1]]})


@register("ud05_grouped_solve", cte("signals") + f""", {V._FWD}, g AS (SELECT m, VAR_POP(s1) AS aa, VAR_POP(s3) AS bb, COVAR_POP(s1, s3) AS ab, COVAR_POP(s1, fwd) AS ay, COVAR_POP(s3, fwd) AS by_ FROM f GROUP BY m)
SELECT CAST(m AS BIGINT) AS m, ROUND((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS beta_a, ROUND((by_ * aa - ay * ab) / (aa * bb - ab * ab), 3) AS beta_b FROM g WHERE aa * bb - ab * ab > 1e-12 * aa * bb""")
def grouped_solve(s, d):
    """A grouped map over independent groups: moments are aggregated by Spark, each group's small system is solved in Arrow."""
    g = V._rows(s, d).groupBy("m").agg(F.var_pop("s1").alias("aa"), F.var_pop("s3").alias("bb"), F.covar_pop("s1", "s3").alias("ab"), F.covar_pop("s1", "fwd").alias("ay"), F.covar_pop("s3", "fwd").alias("yb"))
    return g.groupBy("m").applyInPandas(_solve, "m long, beta_a double, beta_b double").where("beta_a is not null").select("m", F.round("beta_a", 3).alias("beta_a"), F.round("beta_b", 3).alias("beta_b"))


_KINDS = ["view", "signup", "click", "error", "purchase"]
_PARTS = "SELECT user_id AS ticker, MAX(CAST(ts AS DATE)) AS day, " + ", ".join(f"MAX(value) FILTER (event_type = '{k}') AS {k}" for k in _KINDS[:4]) + ", MAX(value) FILTER (event_type = 'purchase' AND value > 50) AS purchase FROM events WHERE ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{1}' GROUP BY user_id"


@register("ev22b_capture_run", "WITH a AS (" + _PARTS.format("2024-01-20 00:00:00", "2024-01-20 12:00:00") + "), b AS (" + _PARTS.format("2024-01-18", "2024-01-21") + """),
c1 AS (SELECT ticker, ((view IS NOT NULL)::INT + (signup IS NOT NULL)::INT + (click IS NOT NULL)::INT + (error IS NOT NULL)::INT) / 4.0 AS cov, purchase FROM a),
o1 AS (SELECT ticker, cov, CASE WHEN cov = 0 AND purchase IS NULL THEN 'failed' WHEN cov < 0.5 THEN 'thin' ELSE 'captured' END AS outcome FROM c1),
c2 AS (SELECT ticker, day, ((view IS NOT NULL)::INT + (signup IS NOT NULL)::INT + (click IS NOT NULL)::INT + (error IS NOT NULL)::INT) / 4.0 AS cov, purchase FROM b),
o2 AS (SELECT c2.ticker, cov, CASE WHEN c2.ticker IN (SELECT ticker FROM o1 WHERE outcome <> 'failed') THEN 'skipped' WHEN day < DATE '2024-01-20' THEN 'failed' WHEN cov < 0.25 THEN 'gated' WHEN cov = 0 AND purchase IS NULL THEN 'failed' WHEN cov < 0.5 THEN 'thin' ELSE 'captured' END AS outcome FROM c2),
r AS (SELECT 1 AS run, outcome, cov FROM o1 UNION ALL SELECT 2, outcome, cov FROM o2)
SELECT run, outcome, COUNT(*) AS names, CAST(ROUND(AVG(cov), 6) AS DOUBLE) AS coverage FROM r GROUP BY ALL
UNION ALL SELECT 3, 'stored', COUNT(*), CAST(ROUND(AVG(cov), 6) AS DOUBLE) FROM r WHERE outcome IN ('captured', 'thin')""")
def capture_run(s, d):
    """Two runs of one day into a store, by noon and at night: names of the first are skipped by the second, names without data of
    the day fail, too few fields are gated; the third row set is what the store then holds."""
    kinds = [F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in _KINDS[:4]]
    large = F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.col("value"))).alias("purchase")

    def parts(since: str, until: str):
        e = table(s, d, "events").where((F.col("ts") >= since) & (F.col("ts") < until))
        return e.groupBy(F.col("user_id").alias("ticker")).agg(F.max(F.to_date("ts")).alias("day"), *kinds, large)

    place = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    first = store.accumulate(parts("2024-01-20 00:00:00", "2024-01-20 12:00:00"), place, "2024-01-20", _KINDS[:4], ["purchase"])
    second = store.accumulate(parts("2024-01-18", "2024-01-21"), place, "2024-01-20", _KINDS[:4], ["purchase"], floor=0.25)
    held = store.snapshots(s, place).withColumn("coverage", sum((F.col(k).isNotNull().cast("int") for k in _KINDS[:4]), F.lit(0)) / 4.0)
    rows = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))).unionByName(held.select("ticker", F.lit("stored").alias("outcome"), "coverage", F.lit(3).alias("run")))
    return rows.groupBy("run", "outcome").agg(F.count("*").alias("names"), F.round(F.avg("coverage"), 6).alias("coverage"))


@register("st08b_streamed_versions", cte("facts") + """, v AS (SELECT cik, tag, fy_end, filed, MIN(val) AS val FROM facts GROUP BY ALL) SELECT cik, tag, fy_end, filed AS known_from, LEAD(filed) OVER w AS known_to, CAST(ROW_NUMBER() OVER w AS INT) AS version, val FROM v WINDOW w AS (PARTITION BY cik, tag, fy_end ORDER BY filed)""")
def streamed_versions(s, d):
    """Facts arrive in the order of filing, in three parcels; each extends the table of intervals in which a value was known, closing
    the one before, and rewrites only facts that it names."""
    place = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    facts = view(s, d, "facts").select("cik", "tag", "fy_end", "filed", "val")
    for parcel in ("filed < '1995-01-01'", "filed >= '1995-01-01' and filed < '1997-06-01'", "filed >= '1997-06-01'"):
        facts.where(parcel).write.mode("append").parquet(f"{place}/in")
        stream = s.readStream.schema("cik long, tag string, fy_end date, filed date, val double").parquet(f"{place}/in")
        O.extended_facts(stream, f"{place}/facts", f"{place}/state")
    return store.facts_known(s, f"{place}/facts").select("cik", "tag", "fy_end", "known_from", "known_to", F.col("version_of_fact").alias("version"), "val")


@register("ud03_injected_resolvers", """WITH r AS (SELECT o_orderkey, o_custkey FROM orders), a AS (SELECT c_custkey AS o_custkey, 'A' || c_nationkey AS t FROM customer WHERE c_acctbal > 5000), b AS (SELECT s_suppkey AS o_custkey, 'B' || s_nationkey AS t FROM supplier),
c AS (SELECT DISTINCT o_custkey, 'C' || o_custkey % 7 AS t FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey, o_custkey, COALESCE(a.t, b.t, c.t) AS ticker, CASE WHEN a.t IS NOT NULL THEN 0 WHEN b.t IS NOT NULL THEN 1 WHEN c.t IS NOT NULL THEN 2 END AS by_ FROM r LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey) LEFT JOIN c USING (o_custkey)""")
def resolvers(s, d):
    """Two tables and a rule, tried in order."""
    rich = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("A"), "c_nationkey").alias("ticker"))
    other = table(s, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.concat(F.lit("B"), "s_nationkey").alias("ticker"))
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    rule = lambda rows: rows.join(urgent, "o_custkey").select("o_custkey", F.concat(F.lit("C"), F.col("o_custkey") % 7).alias("ticker"))
    by_table = lambda t: lambda rows: rows.select("o_custkey").join(t, "o_custkey")
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return M.resolved(rows, "o_custkey", [by_table(rich), by_table(other), rule]).withColumnRenamed("by", "by_")


@register("ud03b_injected_prices", cte("prices") + """, a AS (SELECT DISTINCT ticker, CAST(date_trunc('year', d) + INTERVAL 170 DAY AS DATE) AS ask FROM prices), n AS (SELECT a.*, p.close AS c1 FROM a LEFT JOIN prices p ON p.ticker = a.ticker AND p.d = a.ask), l AS (SELECT n.*, x.close AS c2 FROM n ASOF LEFT JOIN prices x ON x.ticker = n.ticker AND n.ask >= x.d)
SELECT ticker, ask, COALESCE(c1, c2) AS close, CASE WHEN c1 IS NOT NULL THEN 0 WHEN c2 IS NOT NULL THEN 1 END AS by_ FROM l""")
def injected_prices(s, d):
    """A price of the very day, else the last one before: both look-ups are given as functions of the open questions."""
    prices = view(s, d, "prices")
    asks = prices.select("ticker", F.date_add(F.trunc("d", "year"), 170).alias("ask")).distinct().withColumn("q", F.struct("ticker", "ask"))
    exact = lambda rows: rows.join(prices.select("ticker", F.col("d").alias("ask"), "close"), ["ticker", "ask"]).select("q", "close")
    before = lambda rows: P.as_of(rows.select("ticker", "ask"), prices).select(F.struct("ticker", "ask").alias("q"), "close")
    return M.resolved(asks, "q", [exact, before], "close").select("ticker", "ask", "close", F.col("by").alias("by_"))


def _gap(name: str, n: int, value: str) -> str:
    return f"CASE WHEN k % {n} <> 0 THEN {value} END AS {name}"


#: Section fields of a name from sums over its own rows: (field, every how-many-th name has none, expression over a, b, c, d in 0..1).
_FIELDS = [
    ("market_cap", 11, "1e6 + 1e9 * a"), ("price", 13, "1 + 99 * b"), ("roic", 2, "a - 0.3"), ("roic_5y_avg", 3, "b - 0.2"), ("revenue", 2, "1e6 * (a + 0.1)"), ("revenue0", 7, "1e6 * (b + 0.1)"), ("cash0", 5, "1e5 * c"), ("ebitda", 3, "1e5 * (d - 0.2)"), ("ebitda0", 7, "1e5 * (c - 0.3)"),
    ("interest_coverage", 2, "9 * a"), ("operating_income0", 9, "2e5 * (b - 0.2)"), ("interest_expense0", 5, "-1e4 * c"), ("total_debt0", 8, "3e5 * d"), ("net_debt_to_ebitda", 3, "4 * a"), ("ebit_ev_yield", 2, "a / 9"), ("dividends_paid", 3, "-1e4 * a"), ("repurchases", 4, "1e4 * b"), ("debt_repayments", 5, "1e4 * c"),
    ("debt_issuance", 6, "1e4 * d"), ("shareholder_yield", 2, "a / 7"), ("fcf_yield", 2, "b / 9"), ("fcf0", 6, "1e5 * (c - 0.4)"), ("pe_ttm", 2, "40 * a - 5"), ("pe_median", 3, "30 * b"), ("diluted_eps0", 5, "5 * d - 1"), ("price_vs_200dma", 2, "a - 0.5"), ("sma_200", 7, "1 + 90 * d"), ("target_median", 3, "1 + 99 * c"),
    ("days_to_cover", 6, "1200 * d"), ("short_shares", 5, "2e7 * c"), ("prev_short_shares", 7, "2e7 * d"), ("split_flag", 4, "CASE WHEN a > 0.8 THEN 1.0 ELSE 0.0 END"), ("social_mentions", 3, "FLOOR(100 * a)"), ("mentions_day_ago", 4, "FLOOR(4 * b)"), ("news_count_7d", 4, "FLOOR(20 * c)"), ("news_count_prior", 5, "FLOOR(20 * d)"),
    ("contract_ttm", 3, "1e5 * a"), ("contract_prior", 4, "1e5 * (b - 0.2)"), ("lobbying_ttm", 3, "1e4 * c"), ("lobbying_prior", 4, "FLOOR(4 * d)"), ("quarters", 3, "FLOOR(5 * a)"), ("beats", 5, "FLOOR(4 * b)"), ("last_report_estimated", 6, "CASE WHEN b > 0.5 THEN 1.0 ELSE 0.0 END")]
_DAYS = [("settlement_day", 5, "a"), ("social_day", 4, "b"), ("news_day", 3, "c"), ("contract_day", 2, "d"), ("contract_asked", 7, "a"), ("lobbying_day", 2, "b"), ("lobbying_asked", 5, "c"), ("next_report_day", 4, "d"), ("last_report_day", 6, "a"), ("last_report_filed", 5, "c")]
_U = lambda i: f"CAST(SUM((l_orderkey % 9973) * {2 * i + 5} + (l_partkey % 1009) * {9 * i + 7}) % 1009 AS DOUBLE) / 1009"
_SECTIONS = (
    "u AS (SELECT l_suppkey AS k, " + ", ".join(f"{_U(i)} AS {n}" for i, n in enumerate("abcd")) + " FROM lineitem GROUP BY l_suppkey), snap AS (SELECT k AS ticker, DATE '2024-05-01' AS as_of, "
    + ", ".join(_gap(n, m, f"CAST(ROUND({x} + 0.00000001, 6) AS DOUBLE)") for n, m, x in _FIELDS) + ", " + ", ".join(_gap(n, m, f"CAST(DATE '2024-05-01' + CAST(FLOOR(60 * {x} - 50) AS INT) AS DATE)") for n, m, x in _DAYS) + " FROM u)")
_W = {
    "roic": "COALESCE(roic, y[1])", "roic_5y_avg": "COALESCE(roic_5y_avg, CASE WHEN roic IS NULL AND len(y) >= 2 THEN list_avg(y) END)", "revenue": "COALESCE(revenue, revenue0)", "cash_and_equivalents": "cash0", "ebitda": "COALESCE(ebitda, ebitda0)",
    "interest_coverage": "COALESCE(interest_coverage, operating_income0 / NULLIF(ABS(interest_expense0), 0))", "net_debt_to_ebitda": "COALESCE(net_debt_to_ebitda, CASE WHEN COALESCE(ebitda, ebitda0) > 0 THEN (total_debt0 - cash0) / COALESCE(ebitda, ebitda0) END)",
    "ebit_ev_yield": "COALESCE(ebit_ev_yield, CASE WHEN operating_income0 > 0 AND market_cap + total_debt0 - cash0 > 0 THEN operating_income0 / (market_cap + total_debt0 - cash0) END)",
    "shareholder_yield": "COALESCE(shareholder_yield, CASE WHEN COALESCE(dividends_paid, repurchases, debt_repayments, debt_issuance) IS NOT NULL AND market_cap > 0 THEN (ABS(COALESCE(dividends_paid, 0)) + ABS(COALESCE(repurchases, 0)) + ABS(COALESCE(debt_repayments, 0)) - ABS(COALESCE(debt_issuance, 0))) / market_cap END)",
    "fcf_yield": "COALESCE(fcf_yield, fcf0 / NULLIF(market_cap, 0))", "pe_ttm": "COALESCE(pe_ttm, price / NULLIF(diluted_eps0, 0))", "price_vs_200dma": "COALESCE(price_vs_200dma, price / NULLIF(sma_200, 0) - 1)", "upside_to_target": "CASE WHEN target_median <> 0 AND price <> 0 THEN target_median / price - 1 END",
    "pe_vs_history": "CASE WHEN COALESCE(pe_ttm, price / NULLIF(diluted_eps0, 0)) > 0 AND pe_median <> 0 THEN pe_median / COALESCE(pe_ttm, price / NULLIF(diluted_eps0, 0)) - 1 END", "days_to_cover": f"CASE WHEN days_to_cover < {L.NO_COVER} THEN days_to_cover END", "short_pct_outstanding": f"CASE WHEN short_shares / (market_cap / price) BETWEEN 0 AND {L.MOST_SHORT} THEN short_shares / (market_cap / price) END",
    "social_delta": "(social_mentions - mentions_day_ago) / NULLIF(mentions_day_ago, 0)", "contract_growth": "CASE WHEN contract_prior > 0 THEN (contract_ttm - contract_prior) / contract_prior END", "contract_to_revenue": "contract_ttm / NULLIF(COALESCE(revenue, revenue0), 0)",
    "lobbying_growth": "(lobbying_ttm - lobbying_prior) / NULLIF(lobbying_prior, 0)", "beat_rate": "CASE WHEN quarters > 0 THEN beats / quarters END", "average_surprise": "list_avg(z)", "surprise_dispersion": "CASE WHEN len(z) >= 3 THEN list_stddev_pop(z) END", "last_surprise": "z[1]", "earnings_quarters": "CASE WHEN quarters > 0 THEN quarters END"}
_MARKS = {"fcf_positive": "fcf0 > 0", "short_interest_rising": "CASE WHEN COALESCE(split_flag, 0) = 0 THEN short_shares > prev_short_shares END", "social_rising": "social_mentions > mentions_day_ago", "news_rising": "news_count_7d > news_count_prior"}
_AGES = {"short_data_age_days": "as_of - settlement_day", "social_data_age_days": "as_of - social_day", "news_data_age_days": "as_of - news_day", "contract_age_days": "as_of - COALESCE(contract_day, contract_asked)", "lobbying_age_days": "as_of - COALESCE(lobbying_day, lobbying_asked)", "days_to_report": "next_report_day - as_of",
         "days_since_report": "as_of - GREATEST(last_report_day, CASE WHEN last_report_estimated = 1 THEN last_report_filed END)"}


@register("pit12b_wide_projection", "WITH " + _SECTIONS + ", s AS (SELECT *, CASE ticker % 4 WHEN 0 THEN [] WHEN 1 THEN [0.1] ELSE [0.1, 0.3, ticker % 9 / 10.0] END AS y, CASE ticker % 5 WHEN 0 THEN [] WHEN 1 THEN [4.0, -2.0] ELSE [ticker % 11 - 5.0, 1.0, 2.5] END AS z FROM snap) SELECT ticker, "
    + ", ".join(f"ROUND({x} + 0.0000012, 5) AS {n}" for n, x in _W.items()) + ", " + ", ".join(f"{x} AS {n}" for n, x in _MARKS.items()) + ", " + ", ".join(f"CAST({x} AS INT) AS {n}" for n, x in _AGES.items()) + " FROM s")
def wide_projection(s, d):
    """Sections put together from each supplier's own rows, with holes: thirty-six derived fields."""
    snap = s.sql("WITH " + _SECTIONS.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM snap", lineitem=table(s, d, "lineitem"))
    t = F.col("ticker")
    lit = lambda *v: F.array(*[F.lit(x) if isinstance(x, float) else x for x in v]).cast("array<double>")
    none = F.array().cast("array<double>")
    years = F.when(t % 4 == 0, none).when(t % 4 == 1, lit(0.1)).otherwise(lit(0.1, 0.3, t % 9 / 10.0))
    told = F.when(t % 5 == 0, none).when(t % 5 == 1, lit(4.0, -2.0)).otherwise(lit(t % 11 - 5.0, 1.0, 2.5))
    m = L.flat_metrics(snap.withColumn("roic_by_year", years).withColumn("surprises", told))
    return m.select("ticker", *[F.round(F.col(n) + 0.0000012, 5).alias(n) for n in _W], *_MARKS, *_AGES)
