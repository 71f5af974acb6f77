"""The whole screen on a wide table of inputs: every leg, gate and flag, optional parts by configuration, merge and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.bindings import _INPUTS, SQL, cte, table, view
from stockloom.catalog import register
from stockloom.operators import coverage as V
from stockloom.operators import lineage as Z
from stockloom.operators import merge as M
from stockloom.operators import scoring as S
from stockloom.operators.fundamentals import regime
from stockloom.plans import fundamentals as PF
from stockloom.plans import series as PS

#: Everything optional on, the target leg off.
OPEN = S.configured(
    quality={"dilution": True, "asset_growth": True, "accruals": True}, momentum={"sue": True}, value={"upside_to_target": False, "shareholder_yield": True}, insider={"conviction": True, "planned_sell_discount": 0.5},
    weights={"risk": 0.05}, validity={"min_composite_components": 4}, ranking={"thin_below": 0.8},
    flags={
        "filing_text_change": {"max_similarity": 0.7}, "value_trap": {**S.CONFIG["flags"]["value_trap"], "min_value": 50, "suppress_at": 0.8, "confirm_at": 0.34},
        "risk_off_regime": {"max_net_debt_to_ebitda": 3.0, "max_debt_to_equity": 1.5, "cyclical_buckets": ["reit"]}})
_HIDDEN = "('reit', 'insurer', 'financials')"


def _band(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, ({x} - {lo}) / ({hi} - {lo}))) * 100 END"


def _sql_inputs(source: str, open_: bool) -> str:
    """The derived inputs and bands of all legs, as SQL of its own."""
    given = "0.5 * COALESCE(insider_planned_sell_value, 0)" if open_ else "0"
    return f"""i AS (SELECT * REPLACE (CASE WHEN peg > 0 AND pe_ttm > 0 THEN peg END AS peg, COALESCE(roic_5y_avg, roic) AS roic{", COALESCE(eps_cagr_ps, eps_cagr) AS eps_cagr" if open_ else ""}),
  CASE WHEN earnings_quarters >= 3 AND surprise_dispersion >= 1 THEN last_surprise / surprise_dispersion * CASE WHEN days_since_report IS NULL OR days_since_report < 0 THEN 1 ELSE GREATEST(0, 1 - days_since_report / 60) END END AS sue,
  (insider_net_6m + {given}) / market_cap AS insider_net_ratio, piotroski_won AS piotroski_f,
  CASE WHEN sic BETWEEN 6798 AND 6798 THEN 'reit' WHEN sic BETWEEN 6300 AND 6399 OR sic = 6411 THEN 'insurer' WHEN sic BETWEEN 6020 AND 6099 THEN 'financials' WHEN sic IS NULL THEN 'unknown' ELSE 'other' END AS bucket FROM {source}),
b AS (SELECT *, {", ".join(f"{_band(x, *S.BANDS[x])} AS n_{x}" for x in S.BANDS if x in _INPUTS or x in ("sue", "insider_net_ratio"))} FROM i)"""


def _sql_sub(name: str, legs: tuple[str, ...], open_: bool) -> str:
    if name in ("insider", "risk"):
        base = f"list_avg(list_filter([{', '.join('n_' + x for x in legs)}], lambda x: x IS NOT NULL))"
        if name == "insider" and open_:
            more = f"list_avg(list_filter([{_band('insider_distinct_buyers', 1.0, 4.0)}, {_band('(insider_role_weighted_buy_value / market_cap)', 0.0, 0.001)}], lambda x: x IS NOT NULL))"
            return f"CASE WHEN {base} IS NOT NULL AND {more} IS NOT NULL THEN GREATEST({base}, ({base} + {more}) / 2) ELSE {base} END AS insider"
        return f"{base} AS {name}"
    seen = [f"CASE WHEN bucket NOT IN {_HIDDEN} THEN n_{x} END" if x in S.MASKED_LEGS else f"n_{x}" for x in legs]
    have = f"list_filter([{', '.join(seen)}], lambda x: x IS NOT NULL)"
    open_legs = sum(x not in S.MASKED_LEGS for x in legs)
    need = f"CASE WHEN bucket = 'unknown' THEN 1 WHEN bucket IN {_HIDDEN} THEN GREATEST({0.5 * open_legs}, 0.01) ELSE {0.5 * len(legs)} END"
    return f"CASE WHEN len({have}) >= {need} THEN list_avg({have}) END AS {name}"


def _sql_cards(source: str = "screen", open_: bool = False) -> str:
    legs = {
        "quality": ("roe", "net_margin", "interest_coverage", "debt_to_equity", *(("share_count_cagr", "asset_growth", "accruals") if open_ else ())), "moat": ("gross_margin", "gross_margin_stability", "roic"),
        "growth": ("revenue_cagr", "fcf_cagr", "eps_cagr", "revenue_growth_persistence"), "momentum": ("price_vs_200dma", "rel_strength_6m", "eps_revision", *(("sue",) if open_ else ()), "residual_momentum"),
        "value": (*(() if open_ else ("upside_to_target",)), "fcf_yield", "pe_vs_history", "peg", *(("shareholder_yield",) if open_ else ())), "insider": ("insider_sentiment", "insider_net_ratio"), "risk": ("realized_vol", "max_drawdown")}
    w = {"quality": 0.18, "moat": 0.18, "growth": 0.135, "momentum": 0.08, "value": 0.22, "insider": 0.135}
    all_w = {**w, "risk": 0.05 if open_ else 0.0}
    num, den = (" + ".join(f"CASE WHEN {n} IS NOT NULL THEN {x}{' * ' + n if top else ''} ELSE 0 END" for n, x in all_w.items()) for top in (True, False))
    there = " + ".join(f"CASE WHEN {n} IS NOT NULL{f' AND bucket NOT IN {_HIDDEN}' if n == 'moat' else ''} THEN {x} ELSE 0 END" for n, x in w.items())
    total = " + ".join(f"CASE WHEN bucket IN {_HIDDEN} THEN 0 ELSE {x} END" if n == "moat" else f"{x}" for n, x in w.items())
    count = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for n in w)
    gates = f"""list_filter([CASE WHEN fcf < 0 AND NOT COALESCE(revenue_cagr >= 0.15 AND revenue_growth_persistence >= 0.70, FALSE) AND bucket NOT IN {_HIDDEN} THEN 'negative_fcf' END, CASE WHEN market_cap < 3e8 THEN 'below_min_mktcap' END,
  CASE WHEN bucket NOT IN {_HIDDEN} AND CASE WHEN COALESCE(ebitda > 0 AND ebitda / revenue >= 0.03 AND net_debt_to_ebitda IS NOT NULL, FALSE) THEN net_debt_to_ebitda > 4 ELSE debt_to_equity > 5 AND debt_to_equity <= 20 AND NOT COALESCE(interest_coverage >= 2, FALSE) END THEN 'over_leveraged' END,
  CASE WHEN insider_sentiment < -0.6 THEN 'heavy_insider_selling' END], lambda x: x IS NOT NULL)"""
    share = f"CASE WHEN piotroski_legs >= 4 AND bucket NOT IN {_HIDDEN} THEN piotroski_won / piotroski_legs END"
    weak = "(COALESCE(quality < 40, FALSE) OR COALESCE(growth < 40, FALSE))"
    trap = f"value >= 50 AND CASE WHEN {share} IS NULL THEN {weak} ELSE ({weak} OR {share} <= 0.34) AND NOT {share} >= 0.8 END" if open_ else f"value >= 60 AND {weak}"
    levered = "COALESCE(net_debt_to_ebitda > 3, FALSE) OR COALESCE(debt_to_equity > 1.5 AND debt_to_equity <= 20, FALSE)"
    wary = f"(SELECT off FROM macro) AND ({levered} OR bucket = 'reit')" if open_ else "FALSE"
    flags = f"""list_filter([CASE WHEN short_pct_outstanding >= 0.1 AND days_to_cover >= 5 AND short_interest_rising > 0 AND COALESCE(short_data_age_days <= 35, TRUE) THEN 'crowded_short' END, CASE WHEN activist_13d > 0 THEN 'activist_13d' END, CASE WHEN late_filing > 0 THEN 'late_filing' END,
  CASE WHEN insider_distinct_buyers >= 3 THEN 'insider_cluster_buy' END, CASE WHEN insider_planned_sell_value >= 1 THEN 'planned_sale' END, CASE WHEN share_count_cagr >= 0.03 THEN 'dilution' END, CASE WHEN fcf < 0 THEN 'cash_burn' END,
  CASE WHEN social_mentions >= 50 AND social_rising > 0 AND COALESCE(social_delta >= 0.5, TRUE) AND COALESCE(social_data_age_days <= 2, TRUE) THEN 'social_hype' END,
  CASE WHEN news_count_7d >= 10 AND news_rising > 0 AND NOT COALESCE(news_truncated > 0, FALSE) AND COALESCE(news_data_age_days <= 3, TRUE) THEN 'news_spike' END,
  {"CASE WHEN filing_text_similarity < 0.7 THEN 'filing_text_change' END, " if open_ else ""}CASE WHEN {trap} THEN 'value_trap' END, CASE WHEN {wary} THEN 'risk_off_regime' END], lambda x: x IS NOT NULL)"""
    return f"""{_sql_inputs(source, open_)}, s AS (SELECT *, {", ".join(_sql_sub(n, x, open_) for n, x in legs.items())} FROM b),
k AS (SELECT *, COALESCE(({num}) / NULLIF({den}, 0), 0) AS composite_raw, ROUND(({there}) / ({total}), 3) AS confidence, ({count}) AS components, {gates} AS gates, {flags} AS flags FROM s),
cards AS (SELECT *, (bucket = 'unknown' OR confidence >= 0.25) AND components >= {4 if open_ else 1} AS scored, {"confidence < 0.8" if open_ else "FALSE"} AS thin FROM k)"""


_OUT = ", ".join(f"ROUND({n} + 0.0000123, 4) AS {n}" for n in ("quality", "moat", "growth", "momentum", "value", "insider", "risk", "composite_raw"))


def _shown(cards):
    return cards.select("ticker", "bucket", *[F.round(F.col(n) + 0.0000123, 4).alias(n) for n in ("quality", "moat", "growth", "momentum", "value", "insider", "risk", "composite_raw")], "confidence", "scored", "thin", "gates", "flags", S.no_data(cards).alias("no_data"))


_MACRO = """macro AS (SELECT COALESCE(BOOL_OR(event_type = 'error' AND v > 5 OR event_type = 'view' AND v < 1), FALSE) AS off FROM (SELECT event_type, ARG_MAX(value, (ts, event_id)) AS v FROM events GROUP BY 1))"""


def _macro(s, d):
    """One row: whether the market is wary, by the last value of each kind of event."""
    series = table(s, d, "events").select(F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("d"), "value")
    return regime(series, {"error": 5.0}, {"view": 1.0}, {}).select(F.col("off").alias("wary"))


def _no_data(sql: str) -> str:
    return sql + f" SELECT ticker, bucket, {_OUT}, confidence, scored, thin, gates, flags, COALESCE(quality, moat, growth, momentum, value, insider, market_cap) IS NULL AS no_data FROM cards"


@register("sc06_full_cards", _no_data(cte("screen") + ", " + _sql_cards()))
def full_cards(s, d):
    """All legs, gates and flags under the standard configuration."""
    return _shown(S.score(view(s, d, "screen")))


@register("ud08_configured_cards", _no_data(cte("screen") + ", " + _MACRO + ", " + _sql_cards(open_=True)))
def configured_cards(s, d):
    """The same with every optional part on and the target leg off."""
    inputs = view(s, d, "screen").join(F.broadcast(_macro(s, d)))  # one row
    return _shown(S.score(inputs, OPEN, F.col("wary")))


_AXES = ("share_count_cagr", "asset_growth", "accruals", "shareholder_yield", "sue", "residual_momentum", "pct_to_52w_high", "max_daily_return", "vol_scaled_momentum", "price_vs_200dma", "rel_strength_6m", "ebit_ev_yield", "fcf_yield", "pe_vs_history")


@register("sc13_axes", cte("screen") + ", " + _sql_inputs("screen", False) + " SELECT ticker, " + ", ".join(f"ROUND(n_{x} + 0.0000123, 4) AS {x}_axis" for x in _AXES)
    + f", ROUND({_band('net_debt_to_ebitda', 6.0, 0.0)} + 0.0000123, 4) AS net_debt_to_ebitda_axis, ROUND({_band('(CASE WHEN piotroski_legs >= 4 THEN piotroski_won / piotroski_legs END)', 0.34, 1.0)} + 0.0000123, 4) AS piotroski_f_axis"
    + ", ROUND(list_avg(list_filter([n_upside_to_target, n_fcf_yield, n_pe_vs_history, n_peg, n_ebit_ev_yield], lambda x: x IS NOT NULL)) + 0.0000123, 4) AS value_plus_evebit_axis FROM b")
def all_axes(s, d):
    """Seventeen legs as signals of their own."""
    won = F.when(F.col("piotroski_legs") >= 4, F.try_divide("piotroski_won", "piotroski_legs"))
    df = S.prepared(view(s, d, "screen")).withColumn("piotroski_f", won)
    out = df.select("ticker", *S.axes(df))
    return out.select("ticker", *[F.round(F.col(c) + 0.0000123, 4).alias(c) for c in out.columns[1:]])


# ---------------------------------------------------------------- merge, coverage, whole screen

_FIELDS = list(_INPUTS)
_SPLIT = f""", src AS (SELECT ticker, sic, 'feed' AS source, {", ".join(f"CASE WHEN ticker % 3 <> {i % 3} THEN {n} END AS {n}" for i, n in enumerate(_FIELDS))} FROM screen
UNION ALL SELECT ticker, sic, 'filings', {", ".join(f"CASE WHEN ticker % 4 <> {i % 4} THEN {n} * 0.5 END" for i, n in enumerate(_FIELDS))} FROM screen UNION ALL SELECT ticker, NULL, 'guess', {", ".join(n for n in _FIELDS)} FROM screen WHERE sic IS NULL)"""
_PICK = "list_filter([{0}], lambda x: x IS NOT NULL)[1]"
_MERGED = _SPLIT + ", merged AS (SELECT ticker, " + ", ".join(f"COALESCE(MAX({n}) FILTER (source = 'filings'), MAX({n}) FILTER (source = 'feed'), MAX({n}) FILTER (source = 'guess')) AS {n}" for n in ["sic", *_FIELDS]) + " FROM src GROUP BY ticker)"


def _sources() -> V.Sources:
    """Three stand-in sources of partial records: a feed, filings at half the values, and a guess that no priority names."""
    out = V.Sources()
    part = lambda n, k: [F.when(F.col("ticker") % k != i % k, F.col(c) * n).alias(c) for i, c in enumerate(_FIELDS)]
    out.add("feed", lambda s, d: view(s, d, "screen").select("ticker", "sic", *part(1.0, 3)))
    out.add("filings", lambda s, d: view(s, d, "screen").select("ticker", "sic", *part(0.5, 4)))
    out.add("guess", lambda s, d: view(s, d, "screen").where("sic is null").drop("sic"), no_data_is_normal=True, feeds_axes=False)
    return out


def _merged(s, d):
    rows = M.ranked_sources(_sources().rows(s, d), ["filings", "feed"])
    return M.merge_fields(rows, "ticker", ["sic", *_FIELDS])


@register("ud02_pluggable_sources", cte("screen") + _MERGED + ", " + _sql_cards("merged") + " SELECT ticker, ROUND(composite_raw + 0.0000123, 4) AS composite_raw, confidence FROM cards")
def pluggable(s, d):
    """Records of registered sources, merged field by field, scored."""
    return S.score(_merged(s, d)).select("ticker", F.round(F.col("composite_raw") + 0.0000123, 4).alias("composite_raw"), "confidence")


_STATES = """, o AS (SELECT user_id AS ticker, event_type AS source, ARG_MAX(value, (ts, event_id)) AS last, MAX(value) AS top FROM events GROUP BY ALL),
dim AS (SELECT event_type AS source, AVG(value) < 49.95 AS normal, event_type <> 'error' AS feeds FROM events GROUP BY 1),
st AS (SELECT ticker, source, CASE WHEN last < 5 THEN 'error' WHEN last < 10 THEN 'gated_402' WHEN last < 15 THEN 'rate_limited_429' WHEN top <= 90 AND NOT normal THEN 'empty' ELSE 'ok' END AS status, feeds FROM o JOIN dim USING (source))"""


def _states(s, d):
    """The last value of a user's events of a kind stands for the outcome of a source, a high value for a field that came."""
    e = table(s, d, "events").select(F.col("user_id").alias("ticker"), F.col("event_type").alias("source"), "value", "ts", "event_id")
    last = e.groupBy("ticker", "source").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    status = F.when(F.col("v") < 5, "error").when(F.col("v") < 10, "gated_402").when(F.col("v") < 15, "rate_limited_429").otherwise("ok")
    dimension = e.groupBy("source").agg((F.avg("value") < 49.95).alias("no_data_is_normal")).withColumn("feeds_axes", F.col("source") != "error")
    return V.statuses(last.select("ticker", "source", status.alias("status")), e.where("value > 90"), dimension)


_RECORDS = _STATES + f""", rec AS (SELECT ticker, list(source || '=' || status ORDER BY source || '=' || status) AS providers, COALESCE(list(source ORDER BY source) FILTER (status <> 'ok'), []) AS flagged, COALESCE(list(source ORDER BY source) FILTER (NOT feeds), []) AS axisless FROM st GROUP BY ticker),
un AS (SELECT ticker, list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN moat IS NULL AND bucket NOT IN {_HIDDEN} THEN 'moat' END, CASE WHEN growth IS NULL THEN 'growth' END, CASE WHEN momentum IS NULL THEN 'momentum' END, CASE WHEN value IS NULL THEN 'value' END,
  CASE WHEN insider IS NULL THEN 'insider' END, CASE WHEN upside_to_target IS NULL THEN 'upside_to_target' END], lambda x: x IS NOT NULL) AS unavailable FROM cards),
record AS (SELECT r.ticker, providers, unavailable, CASE WHEN len(flagged) > 0 THEN array_to_string(flagged, ', ') || ': supplied no usable data for this symbol' END AS note, axisless FROM rec r LEFT JOIN un USING (ticker) WHERE len(flagged) > 0)"""
_NO_TARGET = "upside_to_target"


@register("sc20_coverage_records", cte("screen") + ", " + _sql_cards() + _RECORDS + " SELECT * FROM record")
def coverage_records(s, d):
    cards = S.score(view(s, d, "screen"))
    return V.records(_states(s, d), cards, F.when(F.col(_NO_TARGET).isNull(), F.lit(_NO_TARGET)))


@register("jn22_explaining_sources", cte("screen") + _STATES + " SELECT ticker, COALESCE(list(source ORDER BY source) FILTER (status <> 'ok' AND feeds), []) AS gaps FROM st GROUP BY ticker")
def explaining(s, d):
    return V.unexplained(_states(s, d))


@register("sc23_whole_screen", cte("screen") + _MERGED + ", " + _sql_cards("merged") + _RECORDS + """ SELECT c.ticker, ROUND(composite_raw + 0.0000123, 1) AS composite, confidence, scored, gates, unavailable, CAST(ROW_NUMBER() OVER (ORDER BY scored DESC, ROUND(composite_raw + 0.0000123, 1) DESC, confidence DESC, c.ticker) AS INT) AS place FROM cards c LEFT JOIN record r USING (ticker)""")
def whole_screen(s, d):
    """Merge of sources, derivation, scores, coverage and rank in one job."""
    cards = S.score(_merged(s, d))
    records = V.records(_states(s, d), cards, F.when(F.col(_NO_TARGET).isNull(), F.lit(_NO_TARGET))).select("ticker", "unavailable")
    ranked = S.ranked(cards.select("ticker", F.round(F.col("composite_raw") + 0.0000123, 1).alias("composite"), "confidence", "scored", "gates"))
    return ranked.join(records, "ticker", "left").select("ticker", "composite", "confidence", "scored", "gates", "unavailable", "place")


_SNAP = """x AS (SELECT l_suppkey AS k, l_returnflag AS source, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank, CASE WHEN l_suppkey % 3 <> 0 OR l_returnflag <> 'R' THEN MAX(l_shipdate) END AS price_day, CASE WHEN l_suppkey % 4 <> 1 OR l_returnflag = 'A' THEN MIN(l_quantity) END AS least,
  CASE WHEN l_suppkey % 2 = 0 OR l_returnflag <> 'R' THEN COUNT(*) END AS n_news, CASE WHEN l_suppkey % 5 <> 0 THEN MAX(l_discount) END AS top, CASE WHEN SUM(l_linenumber) % 7 = 0 THEN 'slow' WHEN SUM(l_linenumber) % 11 = 0 THEN 'broken' END AS error FROM lineitem GROUP BY l_suppkey, l_returnflag)"""


@register("jn10_snapshot_merge", "WITH " + _SNAP + """, f AS (SELECT k, ARG_MIN(price_day, rank) FILTER (price_day IS NOT NULL) AS price_day, ARG_MIN(least, rank) FILTER (least IS NOT NULL) AS least, MIN(rank) FILTER (price_day IS NOT NULL) AS r1, MIN(rank) FILTER (least IS NOT NULL) AS r2,
  MIN(rank) FILTER (n_news IS NOT NULL OR top IS NOT NULL) AS rw, COALESCE(list(source || ': ' || error ORDER BY rank) FILTER (error IS NOT NULL), []) AS errors FROM x GROUP BY k)
SELECT f.k, f.price_day, f.least, list_transform(list_sort(list_distinct(list_filter([r1, r2], lambda v: v IS NOT NULL))), lambda v: (['R', 'N', 'A'])[v + 1]) AS price_sources, w.n_news, w.top, w.source AS news_source, f.errors FROM f LEFT JOIN x w ON w.k = f.k AND w.rank = f.rw""")
def snapshots(s, d):
    """Partial records of three sources: a price section field by field, a news section whole, errors of all."""
    odd = lambda n, m: F.col("l_suppkey") % n != m
    g = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.max("l_shipdate").alias("day"), F.min("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_discount").alias("t"), F.sum("l_linenumber").alias("e"))
    x = g.select(
        F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("source"), F.when(odd(3, 0) | (F.col("l_returnflag") != "R"), F.col("day")).alias("price_day"), F.when(odd(4, 1) | (F.col("l_returnflag") == "A"), F.col("q")).alias("least"),
        F.when(~odd(2, 0) | (F.col("l_returnflag") != "R"), F.col("n")).alias("n_news"), F.when(odd(5, 0), F.col("t")).alias("top"), F.when(F.col("e") % 7 == 0, "slow").when(F.col("e") % 11 == 0, "broken").alias("error"))
    return M.merge_snapshots(x, "k", ["R", "N"], {"price": ["price_day", "least"]}, {"news": ["n_news", "top"]})


_LINEAGE = PF._METRICS + """, market AS (""" + SQL["market"] + """), insider AS (""" + SQL["insider"] + f"""), {PS._RET},
rs0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM (SELECT ticker, d, close FROM prices UNION ALL SELECT NULL, d, close FROM market)),
rs1 AS (SELECT ticker, CASE WHEN COUNT(*) = 127 THEN ARG_MAX(close, d) / ARG_MIN(close, d) - 1 END AS r FROM rs0 WHERE rn <= 127 GROUP BY ticker),
rs AS (SELECT ticker, r - (SELECT r FROM rs1 WHERE ticker IS NULL) AS rel_strength_6m FROM rs1 WHERE ticker IS NOT NULL),
rm0 AS (SELECT p.ticker, p.d, p.close, m.close AS mc, ROW_NUMBER() OVER (PARTITION BY p.ticker ORDER BY p.d DESC) AS rn FROM prices p JOIN market m USING (d)),
rm1 AS (SELECT ticker, rn, close / LAG(close) OVER ({PS._W}) - 1 AS r, mc / LAG(mc) OVER ({PS._W}) - 1 AS m FROM rm0 WHERE rn <= 253),
rm2 AS (SELECT ticker, COUNT(*) AS n, REGR_SLOPE(r, m) AS beta, REGR_INTERCEPT(r, m) AS alpha FROM rm1 WHERE r IS NOT NULL GROUP BY ticker),
rm AS (SELECT ticker, AVG(e) / STDDEV_POP(e) AS residual_momentum FROM (SELECT rm1.ticker, CASE WHEN rn > 21 THEN r - alpha - beta * m END AS e FROM rm1 JOIN rm2 USING (ticker) WHERE r IS NOT NULL AND n >= 120) GROUP BY ticker),
vo AS (SELECT ticker, ARG_MAX(vol, d) AS realized_vol FROM (SELECT ticker, d, CASE WHEN COUNT(ret) OVER y >= 2 THEN STDDEV_SAMP(ret) OVER y * SQRT(252) ELSE -1 END AS vol FROM r WINDOW y AS ({PS._W} ROWS 251 PRECEDING)) GROUP BY ticker),
io AS (SELECT ticker, owner, SUM(CASE WHEN code = 'P' THEN value ELSE 0 END) AS bought, SUM(CASE WHEN code = 'S' THEN value ELSE 0 END) AS sold, COUNT_IF(code = 'P') AS buys, COUNT_IF(code = 'S') AS sells FROM insider GROUP BY ALL),
ii AS (SELECT ticker, SUM(bought) - SUM(sold) AS insider_net_6m, CAST(COUNT_IF(buys > 0) AS DOUBLE) AS insider_distinct_buyers, CAST(SUM(buys) - SUM(sells) AS DOUBLE) / NULLIF(SUM(buys) + SUM(sells), 0) AS insider_sentiment FROM io GROUP BY ticker),
have AS (SELECT m.* EXCLUDE (bucket), CASE bucket WHEN 'financials' THEN 6022 WHEN 'reit' THEN 6798 WHEN 'other' THEN 3571 END AS sic, y.ni / NULLIF(y.eq, 0) AS roe, y.revenue, rel_strength_6m, residual_momentum, NULLIF(realized_vol, -1) AS realized_vol, insider_net_6m, insider_distinct_buyers, insider_sentiment
  FROM m JOIN y USING (ticker) LEFT JOIN rs USING (ticker) LEFT JOIN rm USING (ticker) LEFT JOIN vo USING (ticker) LEFT JOIN ii USING (ticker))"""
_TOLD = ("roe", "net_margin", "debt_to_equity", "gross_margin", "gross_margin_stability", "roic", "revenue_cagr", "fcf_cagr", "revenue_growth_persistence", "price_vs_200dma", "fcf_yield", "max_drawdown", "share_count_cagr", "market_cap", "fcf", "revenue", "rel_strength_6m", "residual_momentum", "realized_vol", "insider_net_6m", "insider_distinct_buyers", "insider_sentiment")
_LINEAGE += ", wide AS (SELECT ticker, sic, " + ", ".join(n if n in _TOLD else f"CAST(NULL AS DOUBLE) AS {n}" for n in _INPUTS) + " FROM have)"


@register("sc23b_screen_from_tables", _LINEAGE + ", " + _sql_cards("wide") + """ SELECT ticker, bucket, ROUND(quality + 0.0000123, 3) AS quality, ROUND(momentum + 0.0000123, 3) AS momentum, ROUND(insider + 0.0000123, 3) AS insider, ROUND(risk + 0.0000123, 3) AS risk, ROUND(composite_raw + 0.0000123, 3) AS composite, confidence, scored, gates, flags,
  CAST(ROW_NUMBER() OVER (ORDER BY scored DESC, ROUND(composite_raw + 0.0000123, 3) DESC, confidence DESC, ticker) AS INT) AS place FROM cards""")
def screen_from_tables(s, d):
    """From daily prices, yearly statements and insider trades to ranked cards, in one lineage."""
    sectors = table(s, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_nationkey") % 5 == 0, 6022).when(F.col("s_nationkey") % 5 == 1, 6798).when(F.col("s_nationkey") % 5 == 2, 3571).alias("sic"))
    inputs = Z.screen_inputs(view(s, d, "prices"), view(s, d, "market"), view(s, d, "stmts"), view(s, d, "insider"), sectors, 100.0)
    cards = S.score(inputs)
    shown = cards.select("ticker", "bucket", *[F.round(F.col(n) + 0.0000123, 3).alias(n) for n in ("quality", "momentum", "insider", "risk")], F.round(F.col("composite_raw") + 0.0000123, 3).alias("composite"), "confidence", "scored", "gates", "flags")
    return S.ranked(shown)
