"""Views that stand in for market, filing and ownership tables, over the driver's tables.

The SQL text runs in Spark and in DuckDB, so oracles use it as common table expressions. Quotients and
averages are rounded after a small odd offset, so that neither engine's order of adding decides a tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "prices": "SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, ROUND(SUM(l_extendedprice) / SUM(l_quantity) + 0.0000123, 4) AS close FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)",
    "market": "SELECT CAST(l_shipdate AS DATE) AS d, ROUND(SUM(l_extendedprice) / SUM(l_quantity) + 0.0000123, 4) AS close FROM lineitem GROUP BY CAST(l_shipdate AS DATE)",
    "facts": "SELECT o_custkey AS cik, o_orderpriority AS tag, MAKE_DATE(CAST(YEAR(o_orderdate) AS INT), 12, 31) AS fy_end, CAST(o_orderdate + INTERVAL 400 DAY AS DATE) AS filed, o_totalprice AS val, o_orderkey AS pos FROM orders",
    "tagged": "SELECT CAST(FLOOR(o_custkey / 25) AS BIGINT) AS cik, CONCAT('T', CAST(o_orderkey % 27 AS INT)) AS tag, MAKE_DATE(CAST(YEAR(o_orderdate) AS INT), 12, 31) AS fy_end, CAST(o_orderdate + INTERVAL 400 DAY AS DATE) AS filed, ROUND(o_totalprice - 60000, 2) AS val, o_orderkey AS pos FROM orders",
    "stmts": "SELECT l_suppkey AS entity, CAST(YEAR(l_shipdate) AS INT) AS fiscal_year, ROUND(SUM(l_extendedprice * (1 - l_discount)) + 0.00003, 2) AS revenue, ROUND(SUM(l_extendedprice * (0.40 - l_discount)) + 0.00003, 2) AS gross_profit, ROUND(SUM(l_extendedprice * (0.05 - l_discount)) + 0.00003, 2) AS net_income, ROUND(SUM(l_extendedprice * (l_tax - 0.03)) + 0.00003, 2) AS operating_cash_flow, ROUND(SUM(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS total_debt, ROUND(SUM(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 2) AS total_equity, SUM(l_quantity) AS diluted_shares FROM lineitem GROUP BY l_suppkey, CAST(YEAR(l_shipdate) AS INT)",
    "insider": "SELECT o_orderkey AS accession, o_custkey AS owner, o_custkey % 50 AS ticker, CAST(o_orderdate AS DATE) AS d, CASE o_orderstatus WHEN 'P' THEN 'P' WHEN 'F' THEN 'S' ELSE 'A' END AS code, o_totalprice AS value, o_orderpriority AS title FROM orders",
    "book": "SELECT c.c_nationkey AS fund, CAST(YEAR(o.o_orderdate) * 4 + QUARTER(o.o_orderdate) AS INT) AS q, l.l_partkey % 100 AS cusip, ROUND(SUM(l.l_extendedprice), 2) AS value, SUM(l.l_quantity) AS shares FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, CAST(YEAR(o.o_orderdate) * 4 + QUARTER(o.o_orderdate) AS INT), l.l_partkey % 100",
    "signals": "SELECT l_suppkey AS ticker, CAST(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) AS INT) AS m, ROUND(AVG(l_discount) + 0.0000000123, 6) AS s1, SUM(l_quantity) AS s2, ROUND(AVG(l_tax) + 0.0000000123, 6) AS s3, ROUND(SUM(l_extendedprice) / SUM(l_quantity) + 0.0000123, 4) AS px FROM lineitem GROUP BY l_suppkey, CAST(YEAR(l_shipdate) * 12 + MONTH(l_shipdate) AS INT)",
    "filings": "SELECT CONCAT(lang, '-', source) AS filer, doc_id, text, LAG(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS prior_doc_id FROM documents",
    "news": "SELECT user_id AS ticker, event_id, ts, event_type, value FROM events",
    "names": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part",
}

#: Inputs of the screen: scale, offset, and every how-many-th name has none (0: all have it). What varies is a residue of sums
#: over the name's own rows.
_INPUTS = {
    "roe": (0.5, -0.05, 7), "net_margin": (0.5, -0.1, 11), "interest_coverage": (20, 0, 5), "debt_to_equity": (8, -1, 9), "gross_margin": (1, 0, 6), "gross_margin_stability": (1, 0, 8), "roic": (0.5, -0.1, 5),
    "roic_5y_avg": (0.4, 0, 3), "revenue_cagr": (0.4, -0.1, 6), "fcf_cagr": (0.4, -0.1, 4), "eps_cagr": (0.4, -0.1, 5), "eps_cagr_ps": (0.4, -0.1, 2), "revenue_growth_persistence": (1, 0, 7), "price_vs_200dma": (0.6, -0.2, 9),
    "rel_strength_6m": (0.6, -0.25, 4), "eps_revision": (0.3, -0.1, 3), "residual_momentum": (4, -2, 4), "upside_to_target": (0.8, -0.2, 3), "fcf_yield": (0.12, -0.02, 7), "pe_vs_history": (0.8, -0.4, 5), "peg": (5, -1, 6),
    "pe_ttm": (60, -10, 8), "insider_sentiment": (2, -1, 4), "insider_net_6m": (4000000, -2000000, 5), "insider_planned_sell_value": (900000, -300000, 3), "insider_distinct_buyers": (6, 0, 4),
    "insider_role_weighted_buy_value": (1500000, 0, 3), "realized_vol": (0.5, 0.05, 0), "max_drawdown": (0.7, -0.7, 6), "share_count_cagr": (0.12, -0.05, 4), "asset_growth": (0.6, -0.2, 5), "accruals": (0.5, -0.25, 5),
    "shareholder_yield": (0.15, -0.04, 4), "ebit_ev_yield": (0.2, -0.02, 6), "pct_to_52w_high": (0.5, 0.5, 5), "max_daily_return": (0.2, 0, 5), "vol_scaled_momentum": (4, -1, 5), "ebitda": (900000, -100000, 5),
    "revenue": (9000000, 100000, 0), "net_debt_to_ebitda": (9, -1, 4), "fcf": (900000, -300000, 9), "market_cap": (2000000000, 100000000, 12), "last_surprise": (20, -8, 6), "surprise_dispersion": (8, 0, 5),
    "days_since_report": (120, -15, 4), "earnings_quarters": (8, 0, 0), "piotroski_won": (6, 0, 0), "piotroski_legs": (7, 0, 5), "short_pct_outstanding": (0.3, 0, 6), "days_to_cover": (12, 0, 6),
    "short_interest_rising": (2, -1, 0), "short_data_age_days": (60, 0, 4), "social_mentions": (120, 0, 3), "social_rising": (2, -1, 0), "social_delta": (3, -1, 4), "social_data_age_days": (4, 0, 3),
    "news_count_7d": (25, 0, 4), "news_rising": (2, -1, 0), "news_truncated": (2, -1.6, 0), "news_data_age_days": (6, 0, 4), "filing_text_similarity": (1, 0, 4), "activist_13d": (2, -1.5, 3), "late_filing": (2, -1.7, 2),
}


def _screen() -> str:
    whole = ("insider_distinct_buyers", "earnings_quarters", "piotroski_won", "piotroski_legs")

    def column(i: int, name: str) -> str:
        scale, offset, gap = _INPUTS[name]
        share = f"CAST(SUM((l_orderkey % 9973) * {2 * i + 3} + (l_partkey % 1009) * {7 * i + 5}) % 1009 AS DOUBLE) / 1009"
        value = f"FLOOR({offset} + {scale} * {share})" if name in whole else f"ROUND({offset} + {scale} * {share} + 0.0000001, 6)"
        return f"CASE WHEN l_suppkey % {gap} <> {i % gap} THEN CAST({value} AS DOUBLE) END AS {name}" if gap else f"CAST({value} AS DOUBLE) AS {name}"

    sic = "CASE l_suppkey % 6 WHEN 0 THEN 6022 WHEN 1 THEN 6798 WHEN 2 THEN 3571 WHEN 3 THEN 7372 WHEN 4 THEN 6411 END AS sic"
    return f"SELECT l_suppkey AS ticker, {sic}, " + ", ".join(column(i, n) for i, n in enumerate(_INPUTS)) + " FROM lineitem GROUP BY l_suppkey"


SQL["screen"] = _screen()
_TABLES = {"book": ("lineitem", "orders", "customer"), "facts": ("orders",), "tagged": ("orders",), "insider": ("orders",), "filings": ("documents",), "news": ("events",), "names": ("part",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view as a DataFrame."""
    sql, frames = SQL[name], {}
    for table in _TABLES.get(name, ("lineitem",)):
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {table}", f"{word} {{{table}}}")
        frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """WITH clause (unfinished, ready for further expressions) of binding views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
