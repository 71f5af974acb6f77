"""Panels in full, replays of stored days, reports, residuals on several controls, and blocks, notes and reports of filings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.operators import backtest as B
from stockloom.operators import pit as T
from stockloom.operators import prices as P
from stockloom.operators import scoring as S
from stockloom.operators import text as X
from stockloom.plans import validation as V
from stockloom.session import checkpoint_dir
from stockloom.sources import store

#: Numbered tags stand for the tags of the families; some families have a second choice or several members.
TAGS = {n: [f"T{i}"] for i, n in enumerate(T.SERIES)}
TAGS["revenue"], TAGS["net_income"], TAGS["repurchases"], TAGS["cash"] = ["T0", "T23"], ["T24", "T1"], ["T20", "T25"], ["T17", "T26"]
_DATES = ["1998-06-30", "2000-06-30", "2002-12-31"]
_KNOWN = "g AS (SELECT CAST(x AS DATE) AS as_of FROM (VALUES " + ", ".join(f"('{x}')" for x in _DATES) + ") v(x)), k AS (SELECT f.*, g.as_of FROM tagged f JOIN g ON f.filed <= g.as_of AND f.fy_end <= g.as_of), t AS (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, tag, fy_end ORDER BY filed DESC, pos) = 1)"


def _pick(name: str) -> str:
    one = [f"MAX(val) FILTER (tag = '{t}')" for t in TAGS[name]]
    if name in T.SUMMED:
        return f"SUM(val) FILTER (tag IN ({', '.join(repr(t) for t in TAGS[name])})) AS {name}"
    return f"COALESCE({', '.join(one)}) AS {name}"


_PANEL = cte("tagged", "prices") + ", " + _KNOWN + ", w AS (SELECT cik, as_of, fy_end, " + ", ".join(_pick(n) for n in T.SERIES) + """ FROM t GROUP BY ALL),
p AS (SELECT *, ocf - capex AS fcf, long_debt + short_debt AS total_debt, CASE WHEN MAX(gross_profit_tagged) OVER (PARTITION BY cik, as_of) IS NOT NULL THEN gross_profit_tagged ELSE revenue - cost END AS gross_profit FROM w)"""


def _panel(s, d):
    dates = s.createDataFrame([(x,) for x in _DATES], "x string").select(F.to_date("x").alias("as_of"))
    return T.full_panel(T.known(view(s, d, "tagged"), dates), TAGS)


@register("pit05_full_panel", _PANEL + " SELECT cik, as_of, fy_end, " + ", ".join(f"ROUND({n}, 2) AS {n}" for n in (*T.SERIES, "fcf", "total_debt", "gross_profit")) + " FROM p")
def full_panel(s, d):
    return _panel(s, d).select("cik", "as_of", "fy_end", *[F.round(n, 2).alias(n) for n in (*T.SERIES, "fcf", "total_debt", "gross_profit")])


def _last(n: str) -> str:
    return f"ARG_MAX({n}, fy_end) FILTER ({n} IS NOT NULL)"


def _rl(a: str, b: str, positive: bool = False) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    den = f"ARG_MAX({b}, fy_end) FILTER ({both})"
    return f"CASE WHEN {den} {'> 0' if positive else '<> 0'} THEN ARG_MAX({a}, fy_end) FILTER ({both}) / {den} END"


def _cagr(n: str) -> str:
    a, z = f"ARG_MIN({n}, fy_end) FILTER ({n} IS NOT NULL)", _last(n)
    return f"CASE WHEN COUNT({n}) >= 3 AND {a} > 0 AND {z} > 0 THEN POW({z} / {a}, 1.0 / (COUNT({n}) - 1)) - 1 END"


_ROIC = "CASE WHEN total_debt + total_equity > 0 THEN operating_income * (1 - CASE WHEN pretax_income > 0 AND income_tax / pretax_income BETWEEN 0 AND 0.5 THEN income_tax / pretax_income ELSE 0.21 END) / (total_debt + total_equity) END"
_METRICS = _PANEL + f""", a AS (SELECT p.*, x.close AS px FROM p ASOF LEFT JOIN prices x ON x.ticker = p.cik % 100 AND p.fy_end >= x.d), now_ AS (SELECT c.cik, c.as_of, x.close AS price FROM (SELECT DISTINCT cik, as_of FROM p) c ASOF LEFT JOIN prices x ON x.ticker = c.cik % 100 AND c.as_of >= x.d),
q AS (SELECT *, CASE WHEN revenue <> 0 THEN gross_profit / revenue END AS gm, {_ROIC} AS roic_y, CASE WHEN px <> 0 AND diluted_eps <> 0 THEN px / diluted_eps END AS pe, operating_income + dep_amort AS ebitda_y, total_debt - cash AS nd FROM a),
u AS (SELECT cik, as_of, fy_end, ROW_NUMBER() OVER (PARTITION BY cik, as_of ORDER BY fy_end DESC) AS n, net_income, ocf, total_debt, gross_profit, revenue FROM q WHERE COALESCE(net_income, ocf, total_debt, gross_profit, revenue) IS NOT NULL),
f AS (SELECT t.cik, t.as_of, [t.net_income > 0, t.ocf > 0, t.ocf > t.net_income, CASE WHEN t.revenue > 0 AND b.revenue > 0 THEN t.net_income / t.revenue > b.net_income / b.revenue END, CASE WHEN t.revenue > 0 AND b.revenue > 0 THEN t.total_debt / t.revenue < b.total_debt / b.revenue END,
  CASE WHEN t.revenue > 0 AND b.revenue > 0 THEN t.gross_profit / t.revenue > b.gross_profit / b.revenue END] AS tests FROM u t LEFT JOIN u b ON b.cik = t.cik AND b.as_of = t.as_of AND b.n = 2 WHERE t.n = 1),
r AS (SELECT cik, as_of, COUNT(*) AS n, COUNT_IF(revenue > before) AS up FROM (SELECT cik, as_of, revenue, LAG(revenue) OVER (PARTITION BY cik, as_of ORDER BY fy_end) AS before FROM q WHERE revenue IS NOT NULL) GROUP BY ALL),
h AS (SELECT cik, as_of, fy_end, assets, net_income, ocf, LEAD(assets) OVER v AS a1, fy_end - LEAD(fy_end) OVER v AS apart, ROW_NUMBER() OVER v AS k FROM q WHERE assets IS NOT NULL WINDOW v AS (PARTITION BY cik, as_of ORDER BY fy_end DESC)),
all_ AS (SELECT cik, as_of, {_rl('net_income', 'revenue')} AS net_margin, {_rl('net_income', 'total_equity')} AS roe, {_rl('total_debt', 'total_equity')} AS debt_to_equity, {_rl('operating_income', 'interest_expense')} AS interest_coverage, {_rl('gross_profit', 'revenue')} AS gross_margin,
  CASE WHEN COUNT(gm) >= 3 AND AVG(gm) > 0 THEN GREATEST(0.0, 1 - STDDEV_POP(gm) / AVG(gm)) END AS gross_margin_stability, {_last('roic_y')} AS roic, CASE WHEN COUNT(roic_y) >= 2 THEN AVG(roic_y) END AS roic_5y_avg,
  {_cagr('revenue')} AS revenue_cagr, {_cagr('fcf')} AS fcf_cagr, {_cagr('net_income')} AS eps_cagr, {_cagr('diluted_eps')} AS eps_cagr_ps, {_cagr('diluted_shares')} AS share_count_cagr, {_last('fcf')} AS fcf, MAX(fy_end) FILTER (fcf IS NOT NULL) = MAX(fy_end) FILTER (ocf IS NOT NULL) AS fresh,
  {_last('dividends_paid')} AS dp, {_last('repurchases')} AS rp, {_last('debt_repayments')} AS dr, {_last('debt_issuance')} AS di, {_last('diluted_eps')} AS eps, {_last('shares_out')} AS sh, {_last('operating_income')} AS oi, {_last('revenue')} AS revenue, {_last('cash')} AS cash, CASE WHEN COUNT(pe) >= 2 THEN MEDIAN(pe) END AS pe_median,
  {_last('ebitda_y')} AS ebitda, {_rl('nd', 'ebitda_y', True)} AS net_debt_to_ebitda, {_last('nd')} AS nd FROM q GROUP BY cik, as_of),
z AS (SELECT all_.*, price, CASE WHEN price <> 0 AND sh <> 0 THEN price * sh END AS market_cap, len(list_filter(tests, lambda x: x)) AS won, len(list_filter(tests, lambda x: x IS NOT NULL)) AS legs, CASE WHEN r.n >= 3 THEN up / (r.n - 1) END AS revenue_growth_persistence,
  CASE WHEN h.apart BETWEEN 350 AND 380 AND a1 <> 0 THEN h.assets / a1 - 1 END AS asset_growth, CASE WHEN h.apart BETWEEN 350 AND 380 AND h.assets + a1 <> 0 THEN (h.net_income - h.ocf) / ((h.assets + a1) / 2) END AS accruals
  FROM all_ LEFT JOIN now_ USING (cik, as_of) LEFT JOIN f USING (cik, as_of) LEFT JOIN r USING (cik, as_of) LEFT JOIN h ON h.cik = all_.cik AND h.as_of = all_.as_of AND h.k = 1)"""
_SHOWN = ("net_margin", "roe", "debt_to_equity", "interest_coverage", "gross_margin", "gross_margin_stability", "roic", "roic_5y_avg", "revenue_cagr", "fcf_cagr", "eps_cagr", "eps_cagr_ps", "share_count_cagr", "revenue_growth_persistence", "asset_growth", "accruals", "pe_median", "net_debt_to_ebitda")
_MORE = {"fcf_yield": "CASE WHEN market_cap <> 0 THEN fcf / market_cap END", "shareholder_yield": "CASE WHEN COALESCE(dp, rp, dr, di) IS NOT NULL AND market_cap > 0 THEN (ABS(COALESCE(dp, 0)) + ABS(COALESCE(rp, 0)) + ABS(COALESCE(dr, 0)) - ABS(COALESCE(di, 0))) / market_cap END",
         "pe_ttm": "CASE WHEN price <> 0 AND eps <> 0 THEN price / eps END", "ebit_ev_yield": "CASE WHEN oi > 0 AND market_cap + nd > 0 THEN oi / (market_cap + nd) END"}


@register("pit06_panel_metrics", _METRICS + " SELECT cik, as_of, price, ROUND(market_cap, 0) AS market_cap, CASE WHEN fresh THEN fcf > 0 END AS fcf_positive, CASE WHEN legs > 0 THEN CAST(won AS INT) END AS piotroski_won, CASE WHEN legs > 0 THEN CAST(legs AS INT) END AS piotroski_legs, ROUND(revenue, 2) AS revenue, ROUND(ebitda, 2) AS ebitda, ROUND(cash, 2) AS cash, "
    + ", ".join(f"ROUND({n} + 0.0000012, 5) AS {n}" for n in _SHOWN) + ", " + ", ".join(f"ROUND({x} + 0.0000000012, 8) AS {n}" for n, x in _MORE.items()) + " FROM z")
def panel_metrics(s, d):
    """The whole panel with prices then and now: thirty derived columns per filer and date."""
    panel = _panel(s, d)
    prices = view(s, d, "prices")
    then = panel.select("cik", "as_of", "fy_end").withColumn("ticker", F.col("cik") % 100)
    px = P.as_of(then.select("ticker", F.col("fy_end").alias("ask")).distinct(), prices).select("ticker", F.col("ask").alias("fy_end"), F.col("close").alias("px"))
    cells = panel.select("cik", "as_of").distinct().withColumn("ticker", F.col("cik") % 100)
    now = P.as_of(cells.select("ticker", F.col("as_of").alias("ask")).distinct(), prices).select("ticker", F.col("ask").alias("as_of"), F.col("close").alias("price"))
    m = T.panel_metrics(panel, then.join(px, ["ticker", "fy_end"], "left").select("cik", "as_of", "fy_end", "px"), cells.join(now, ["ticker", "as_of"], "left").select("cik", "as_of", "price"))
    return m.select("cik", "as_of", "price", F.round("market_cap", 0).alias("market_cap"), "fcf_positive", "piotroski_won", "piotroski_legs", *[F.round(n, 2).alias(n) for n in ("revenue", "ebitda", "cash")],
                    *[F.round(F.col(n) + 0.0000012, 5).alias(n) for n in _SHOWN], *[F.round(F.col(n) + 0.0000000012, 8).alias(n) for n in _MORE])


# ---------------------------------------------------------------- replays and reports

_B = "CASE WHEN {0} IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, ({0} - {1}) / ({2} - {1}))) * 100 END"
_REPLAY = cte("signals") + f""", x AS (SELECT ticker, m AS day, {_B.format('(s1 * 4)', 0.10, 0.35)} AS a, {_B.format('(s3 * 4)', 0.0, 0.30)} AS b, CASE WHEN ticker % 3 <> 0 THEN {_B.format('(s1 - 0.03)', 0.02, 0.08)} END AS value, CASE WHEN ticker % 7 = 0 THEN {_B.format('(s3 * 3)', 0.0, 0.20)} END AS growth FROM signals),
c AS (SELECT ticker, day, (a + b) / 2 AS quality, value, growth FROM x), k AS (SELECT *, (quality * 0.18 + COALESCE(value * 0.22, 0) + COALESCE(growth * 0.135, 0)) / (0.18 + CASE WHEN value IS NULL THEN 0 ELSE 0.22 END + CASE WHEN growth IS NULL THEN 0 ELSE 0.135 END) AS composite,
  ROUND((0.18 + CASE WHEN value IS NULL THEN 0 ELSE 0.22 END + CASE WHEN growth IS NULL THEN 0 ELSE 0.135 END) / 0.93, 3) AS confidence FROM c)"""


@register("bt16_snapshot_replay", _REPLAY + " SELECT ticker, day, signal, ROUND(value + 0.0000123, 4) AS value FROM (SELECT ticker, day, 'composite' AS signal, composite AS value FROM k WHERE confidence >= 0.34 UNION ALL SELECT ticker, day, 'quality', quality FROM k UNION ALL SELECT ticker, day, 'value', value FROM k UNION ALL SELECT ticker, day, 'growth', growth FROM k) WHERE value IS NOT NULL")
def snapshot_replay(s, d):
    """Inputs of every month saved as snapshots, read back, scored, and emitted as signals."""
    x = view(s, d, "signals")
    rows = x.select("ticker", F.col("m").alias("day"), (F.col("s1") * 4).alias("roe"), (F.col("s3") * 4).alias("net_margin"), F.when(F.col("ticker") % 3 != 0, F.col("s1") - 0.03).alias("fcf_yield"), F.when(F.col("ticker") % 7 == 0, F.col("s3") * 3).alias("revenue_cagr"))
    place = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    store.save_snapshots(rows, place)
    stored = store.snapshots(s, place).withColumn("sic", F.lit(None).cast("int"))
    cards = S.score(stored).withColumn("composite", F.col("composite_raw"))
    return B.replay(cards, 0.34, ("quality", "value", "growth")).select("ticker", F.col("day").cast("int").alias("day"), "signal", F.round(F.col("value") + 0.0000123, 4).alias("value"))


@register("bt15_report_frame", cte("signals") + f""", {V._LONG}, i AS (SELECT signal, ic FROM {V._ic('l', 'value', 'fwd', 'signal, m', 5)} WHERE ic IS NOT NULL) SELECT signal, 'cross_section' AS kind, COUNT(*) AS n, ROUND(AVG(ic), 4) AS mean_ic, ROUND(COALESCE(STDDEV_SAMP(ic), 0), 4) AS sd_ic, ROUND(AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0), 4) AS icir,
ROUND(AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0) * SQRT(COUNT(*)), 3) AS t_stat, ROUND(COUNT_IF(ic > 0) / COUNT(*), 3) AS hit_rate FROM i GROUP BY signal""")
def report_frame(s, d):
    return B.report_frame(V._long(s, d)).where("kind = 'cross_section'")


@register("bt15b_proposal", cte("signals") + ", f AS (SELECT 's1' AS axis, 0.3 AS prior, AVG(s1) AS fitted FROM signals UNION ALL SELECT 's3', 0.2, AVG(s3) FROM signals UNION ALL SELECT 's2', 0.5, 9.0) SELECT axis, CAST(prior AS DOUBLE) AS prior, ROUND(CASE WHEN axis <> 's2' THEN fitted / (SELECT SUM(fitted) FROM f WHERE axis <> 's2') * 0.5 ELSE prior END, 6) AS proposed FROM f")
def proposal(s, d):
    """Means of two signals stand for fitted weights; the third axis is outside the block."""
    x = view(s, d, "signals").agg(F.avg("s1").alias("a"), F.avg("s3").alias("b"))
    rows = F.array(*[F.struct(F.lit(n).alias("axis"), F.lit(p).alias("prior"), v.alias("fitted")) for n, p, v in (("s1", 0.3, F.col("a")), ("s3", 0.2, F.col("b")), ("s2", 0.5, F.lit(9.0)))])
    return B.proposal(x.select(F.explode(rows).alias("r")).select("r.*"), F.col("axis") != "s2").select("axis", "prior", F.round("proposed", 6).alias("proposed"))


_TWO = cte("signals") + f""", r AS (SELECT m, ticker, {V._rank('s1', 'm')} AS y, {V._rank('s2', 'm')} AS a, {V._rank('s3', 'm')} AS b FROM signals), g AS (SELECT m, COUNT(*) AS n, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS yb, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(y) AS vy FROM r GROUP BY m HAVING COUNT(*) >= 10),
f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b0, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b1 FROM g WHERE aa * bb - ab * ab > 1e-12 * aa * bb), e AS (SELECT r.m, r.ticker, f.vy, y - my - b0 * (a - ma) - b1 * (b - mb) AS residual FROM r JOIN f USING (m))"""


@register("bt11b_two_controls", _TWO + " SELECT m, ticker, ROUND(residual, 5) AS residual FROM e")
def two_controls(s, d):
    return B.residuals(view(s, d, "signals"), "s1", ["s2", "s3"])[0].select("m", "ticker", F.round("residual", 5).alias("residual"))


@register("bt11c_residual_diagnostics", _TWO + ", q AS (SELECT m, 1 - VAR_POP(residual) / MAX(vy) AS r2 FROM e GROUP BY m) SELECT (SELECT COUNT(*) FROM q) AS dates, ROUND((SELECT AVG(r2) FROM q), 6) AS mean_r2, ROUND(AVG(b0), 6) AS b0_mean, ROUND(STDDEV_SAMP(b0), 6) AS b0_sd, ROUND(AVG(b1), 6) AS b1_mean, ROUND(STDDEV_SAMP(b1), 6) AS b1_sd FROM f")
def diagnostics(s, d):
    out = B.residuals(view(s, d, "signals"), "s1", ["s2", "s3"])[1]
    return out.select("dates", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# ---------------------------------------------------------------- notes and reports of filings

_FAMILIES = [("debt", "the|der", r"\\$|###"), ("leases", "la|en", None)]


@register("tx07_note_selection", r"""WITH x AS (SELECT doc_id, lang || '-' || source AS filing, regexp_extract(text, '^[^\n]*') AS title, text FROM documents), f AS (SELECT *, CASE WHEN regexp_matches(lower(title), 'the|der') AND NOT regexp_matches(lower(title), '\$|###') THEN 0 WHEN regexp_matches(lower(title), 'la|en') THEN 1 END AS f FROM x),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY filing ORDER BY f, doc_id) AS place, LEAST(length(text), 1500) AS size FROM f WHERE f IS NOT NULL QUALIFY place <= 3), r AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY filing ORDER BY f, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k)
SELECT filing, doc_id AS pos, (['debt', 'leases'])[f + 1] AS family, CAST(place AS INT) AS place, substr(text, 1, CAST(GREATEST(0, LEAST(size, 3000 - used)) AS INT)) AS text FROM r WHERE length(substr(text, 1, CAST(GREATEST(0, LEAST(size, 3000 - used)) AS INT))) > 0""")
def notes(s, d):
    """First lines stand for titles, documents of a language and source for the notes of a filing."""
    n = table(s, d, "documents").where("text is not null and lang is not null and source is not null").select(F.concat_ws("-", "lang", "source").alias("filing"), F.col("doc_id").alias("pos"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), "text")
    return X.select_notes(n, _FAMILIES, 3, 1500, 3000)


@register("tx08b_report_ranking", "WITH r AS (SELECT user_id, CAST(ts AS DATE) AS filed, MIN(event_id) AS id, list_distinct(list(event_type)) AS items, COUNT(*) % 6 AS x FROM events GROUP BY user_id, CAST(ts AS DATE)), h AS (SELECT *, list_filter(['error', 'purchase'], lambda v: list_contains(items, v)) AS hits FROM r WHERE x <> 0 AND filed >= DATE '2024-01-10'), k AS (SELECT *, CASE WHEN hits[1] = 'error' THEN 0 ELSE 1 END AS rank FROM h WHERE len(hits) > 0) SELECT user_id AS filer, id, filed, hits, CAST(rank AS BIGINT) AS rank, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rank, filed DESC, id) AS INT) AS place FROM k QUALIFY place <= 4")
def report_ranking(s, d):
    """A user's day stands for a report, its kinds of events for the items."""
    r = table(s, d, "events").groupBy(F.col("user_id").alias("filer"), F.to_date("ts").alias("filed")).agg(F.min("event_id").alias("id"), F.collect_set("event_type").alias("items"), (F.count("*") % 6).alias("x"))
    return X.rank_reports(r.withColumn("form", F.when(F.col("x") == 0, "8-K/A").otherwise("8-K")), ["error", "purchase"], F.lit("2024-01-10").cast("date"), 4)
