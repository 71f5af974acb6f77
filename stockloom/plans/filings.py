"""Queries over facts, ownership, filings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.operators import events as E
from stockloom.operators import merge as M
from stockloom.operators import pit as T


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


_DATES = ["1998-06-30", "2000-06-30", "2002-12-31"]
_AS_OF = "g AS (SELECT CAST(x AS DATE) AS as_of FROM (VALUES ('1998-06-30'), ('2000-06-30'), ('2002-12-31')) v(x)), k AS (SELECT f.*, g.as_of FROM facts f JOIN g ON f.filed <= g.as_of AND f.fy_end <= g.as_of)"
_TAG = ", t AS (SELECT cik, as_of, tag, fy_end, filed, val FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, tag, fy_end ORDER BY filed DESC, pos) = 1)"
_WIDE = _TAG + ", w AS (SELECT cik, as_of, fy_end, MAX(val) FILTER (tag = '1-URGENT') AS a, MAX(val) FILTER (tag = '2-HIGH') AS b, MAX(val) FILTER (tag = '3-MEDIUM') AS c FROM t GROUP BY ALL)"
_NAMES = {"1-URGENT": "a", "2-HIGH": "b", "3-MEDIUM": "c"}


def _known(s, d):
    facts = view(s, d, "facts")
    dates = s.createDataFrame([(x,) for x in _DATES], "x string").select(F.to_date("x").alias("as_of"))
    return T.known(facts, dates)


def _wide(s, d):
    return T.panel(T.per_tag(_known(s, d)), _NAMES)


@register("pit01_annual_series", cte("facts") + f", {_AS_OF}, p AS (SELECT *, CASE tag WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END AS prio FROM k) SELECT cik, as_of, fy_end, tag, filed, val FROM p WHERE prio IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, fy_end ORDER BY prio, filed DESC, pos) = 1")
def annual(s, d):
    return T.select(_known(s, d), {"1-URGENT": 0, "2-HIGH": 1})


@register("pit02_family_sum", cte("facts") + f", {_AS_OF}{_TAG} SELECT cik, as_of, fy_end, ROUND(SUM(val), 2) AS val FROM t WHERE tag IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def family(s, d):
    return T.sum_family(T.per_tag(_known(s, d)), ["1-URGENT", "2-HIGH"]).select("cik", "as_of", "fy_end", _r("val", 2))


@register("pit03_aligned_arithmetic", cte("facts") + f", {_AS_OF}{_WIDE} SELECT cik, as_of, fy_end, ROUND(a - b, 2) AS free_cash, ROUND(CASE WHEN MAX(c) OVER (PARTITION BY cik, as_of) IS NULL THEN a - b ELSE c END, 2) AS gross FROM w")
def aligned(s, d):
    return _wide(s, d).select("cik", "as_of", "fy_end", F.round(F.col("a") - F.col("b"), 2).alias("free_cash"), F.round(T.gross_profit("c", "a", "b", "cik", "as_of"), 2).alias("gross"))


@register("pit04_latest_ratio", cte("facts") + f", {_AS_OF}{_WIDE} SELECT cik, as_of, MAX(fy_end) AS fy_end, ROUND(ARG_MAX(a / NULLIF(b, 0), fy_end), 6) AS ratio FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY cik, as_of")
def latest_ratio(s, d):
    return T.latest_ratio(_wide(s, d), "a", "b", positive=True).select("cik", "as_of", "fy_end", _r("ratio"))


@register("pit05_panel", cte("facts") + f", {_AS_OF}{_WIDE} SELECT * FROM w")
def panel(s, d):
    return _wide(s, d)


@register("pit07_taxed_return", cte("facts") + f", {_AS_OF}{_WIDE} SELECT cik, as_of, fy_end, ROUND(CASE WHEN c + a > 0 THEN a * (1 - CASE WHEN c > 0 AND b / c BETWEEN 0 AND 0.5 THEN b / c ELSE 0.21 END) / (c + a) END, 6) AS roic FROM w")
def taxed(s, d):
    c = F.col
    return _wide(s, d).select("cik", "as_of", "fy_end", F.round(T.taxed_return(c("a"), c("b"), c("c"), c("c"), c("a")), 6).alias("roic"))


@register("pit08_fiscal_bucket", cte("facts") + f", {_AS_OF}{_WIDE} SELECT cik, as_of, fy_end, CAST(YEAR(fy_end - 182) AS INT) AS bucket FROM w QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, YEAR(fy_end - 182) ORDER BY fy_end DESC) = 1")
def bucket(s, d):
    return T.by_bucket(_wide(s, d)).select("cik", "as_of", "fy_end", "bucket")


@register("pit09_year_status", cte("facts") + f""", {_AS_OF}{_WIDE}, y AS (SELECT *, CASE WHEN a IS NULL OR c IS NULL THEN 'missing' WHEN COALESCE(b, 0) + c < 100000 THEN 'low_capital' ELSE 'ok' END AS status FROM w)
SELECT cik, as_of, fy_end, status, ROUND(CASE WHEN status = 'ok' THEN a * 0.79 / (COALESCE(b, 0) + c) END, 6) AS roic FROM y""")
def status(s, d):
    return T.year_status(_wide(s, d), "a", ["b"], "c", 100000.0).select("cik", "as_of", "fy_end", "status", _r("roic"))


@register("pit10_own_snapshots", cte("facts") + ", e AS (SELECT DISTINCT cik, fy_end + 450 AS as_of FROM facts) SELECT f.cik, e.as_of, COUNT(*) AS n, ROUND(SUM(val), 2) AS total FROM facts f JOIN e USING (cik) WHERE f.filed <= e.as_of AND f.fy_end <= e.as_of GROUP BY ALL")
def snapshots(s, d):
    return T.own_snapshots(view(s, d, "facts"), 450).groupBy("cik", "as_of").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"))


@register("pit11_filing_pair", """WITH f AS (SELECT CONCAT(lang, '-', source) AS filer, doc_id, DATE '2000-01-01' + CAST(n_chars AS INT) AS filed FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND NOT contains(text, '$'))
SELECT filer, MAX(doc_id) FILTER (k = 1) AS doc_id, MAX(doc_id) FILTER (k = 2) AS prior_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY filer ORDER BY filed DESC, doc_id DESC) AS k FROM f WHERE filed <= DATE '2010-01-01') WHERE k <= 2 GROUP BY filer""")
def pair(s, d):
    """The length of a text stands for its day; one with a dollar sign for a filing of another form."""
    docs = table(s, d, "documents").where("lang is not null and source is not null and not contains(text, '$')")
    filed = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int"))
    return T.filings_before(docs.select(F.concat_ws("-", "lang", "source").alias("filer"), filed.alias("filed"), "doc_id"), F.lit("2010-01-01").cast("date"))


@register("pit14_completeness", cte("facts") + f", {_AS_OF}{_WIDE} SELECT cik, as_of, fy_end, ROUND((CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END) / 3.0, 6) AS coverage, list_filter([CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END, CASE WHEN c IS NULL THEN 'c' END], lambda x: x IS NOT NULL) AS missing FROM w")
def completeness(s, d):
    w = _wide(s, d)
    cover, missing = T.completeness(w, ["a", "b", "c"])
    return w.select("cik", "as_of", "fy_end", F.round(cover, 6).alias("coverage"), missing)


@register("flt15_filed_before_end", cte("facts") + " SELECT tag, COUNT_IF(filed < fy_end) AS early, COUNT(*) AS n FROM facts GROUP BY tag")
def early(s, d):
    return T.filed_before_end(view(s, d, "facts"))


# ---------------------------------------------------------------- merge and identity

_SOURCES = """x AS (SELECT l_suppkey AS entity, CAST(YEAR(l_shipdate) AS INT) AS fiscal_year, CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'beta' ELSE 'gamma' END AS source, ROUND(SUM(l_quantity), 0) AS shares, CASE WHEN SUM(l_quantity) > 250 THEN ROUND(SUM(l_extendedprice), 2) END AS revenue FROM lineitem GROUP BY ALL),
r AS (SELECT *, CASE source WHEN 'beta' THEN 0 WHEN 'alpha' THEN 1 ELSE 2 END AS rank FROM x)"""


def _sources(s, d):
    li = table(s, d, "lineitem")
    name = F.when(F.col("l_returnflag") == "A", "alpha").when(F.col("l_returnflag") == "N", "beta").otherwise("gamma")
    g = li.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("fiscal_year"), name.alias("source")).agg(F.round(F.sum("l_quantity"), 0).alias("shares"), F.when(F.sum("l_quantity") > 250, F.round(F.sum("l_extendedprice"), 2)).alias("revenue"))
    return M.ranked_sources(g, ["beta", "alpha"])


@register("jn06_field_merge", f"WITH {_SOURCES}, y AS (SELECT * FROM r WHERE fiscal_year = 1997) SELECT entity, ARG_MIN(shares, rank) AS shares, ARG_MIN(revenue, rank) FILTER (revenue IS NOT NULL) AS revenue, list_sort(list_distinct(list_filter([ARG_MIN(source, rank), ARG_MIN(source, rank) FILTER (revenue IS NOT NULL)], lambda x: x IS NOT NULL))) AS sources FROM y GROUP BY entity")
def field_merge(s, d):
    return M.merge_fields(_sources(s, d).where("fiscal_year = 1997"), "entity", ["shares", "revenue"])


@register("jn07_pick_first", f"WITH {_SOURCES} SELECT entity, fiscal_year, source, revenue FROM r WHERE fiscal_year = 1996 AND revenue IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY entity ORDER BY rank, source) = 1")
def pick_first(s, d):
    return M.pick_first(_sources(s, d).where("fiscal_year = 1996"), "entity", ["revenue"]).select("entity", "fiscal_year", "source", "revenue")


@register("jn08_year_backfill", f"""WITH {_SOURCES}, b AS (SELECT *, MIN(rank) OVER (PARTITION BY entity) AS best FROM r), h AS (SELECT *, BOOL_OR(revenue IS NOT NULL) FILTER (rank = best) OVER (PARTITION BY entity) AS has, BOOL_OR(rank = best) OVER (PARTITION BY entity, fiscal_year) AS spine FROM b)
SELECT entity, fiscal_year, MAX(shares) FILTER (rank = best) AS shares, CASE WHEN BOOL_OR(has) THEN MAX(revenue) FILTER (rank = best) ELSE ARG_MIN(revenue, rank) FILTER (rank > best AND revenue IS NOT NULL) END AS revenue FROM h WHERE spine GROUP BY ALL""")
def backfill(s, d):
    return M.backfill_years(_sources(s, d), "entity", ["shares", "revenue"])


_NORM = "array_to_string(list_filter(str_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in M.LEGAL_WORDS) + ")), ' ')"


@register("jn11_normal_name", cte("names") + f" SELECT id, {_NORM.format('name || brand')} AS key FROM names")
def normal(s, d):
    return view(s, d, "names").select("id", M.normal_name(F.concat("name", "brand")).alias("key"))


@register("jn13_unambiguous_name", f"WITH g AS (SELECT {_NORM.format('c_name')} AS key, ARG_MIN(c_mktsegment, c_custkey) AS ticker, MIN(c_nationkey) AS lo, MAX(c_nationkey) AS hi FROM customer GROUP BY 1) SELECT key, ticker FROM g WHERE lo = hi AND key <> ''")
def unambiguous(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("cik"))
    return M.name_keys(c)


@register("jn14_latest_symbol", "SELECT o_custkey AS cusip, ARG_MAX(o_orderpriority, (o_orderdate, o_orderpriority)) AS symbol FROM orders GROUP BY 1")
def symbol(s, d):
    return M.latest_symbol(table(s, d, "orders").select(F.col("o_custkey").alias("cusip"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("settled")))


_RESOLVE = """WITH ar AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS seen, MIN(o_orderpriority) AS ticker FROM orders GROUP BY ALL), iv AS (SELECT *, LEAD(seen) OVER (PARTITION BY cik ORDER BY seen) AS nx FROM ar),
a AS (SELECT c_custkey AS cik, DATE '1998-01-01' AS day, c_acctbal AS b, c_mktsegment AS g FROM customer), q AS (SELECT a.cik, a.day, CASE WHEN b < 0 THEN 'OVR' END AS o, CASE WHEN g = 'MACHINERY' THEN 'LIVE' END AS l, iv.ticker AS h FROM a LEFT JOIN iv ON iv.cik = a.cik AND a.day >= iv.seen AND (iv.nx IS NULL OR a.day < iv.nx))
SELECT cik, day, COALESCE(o, l, h) AS ticker, CASE WHEN o IS NOT NULL THEN 'override' WHEN l IS NOT NULL THEN 'live' WHEN h IS NOT NULL THEN 'archive' ELSE 'none' END AS origin FROM q"""


@register("jn15_resolve_ticker", _RESOLVE)
def resolve(s, d):
    cust = table(s, d, "customer").select(F.col("c_custkey").alias("cik"), "c_acctbal", "c_mktsegment")
    override, live = cust.where("c_acctbal < 0"), cust.where("c_mktsegment = 'MACHINERY'")
    archive = table(s, d, "orders").groupBy(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("seen")).agg(F.min("o_orderpriority").alias("ticker"))
    return M.resolve(cust.select("cik", F.lit("1998-01-01").cast("date").alias("day")), override.select("cik", F.lit("OVR").alias("ticker")), live.select("cik", F.lit("LIVE").alias("ticker")), archive)


@register("jn16_first_filing", "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY ALL")
def first_filing(s, d):
    return M.first_by(table(s, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@register("jn17_trade_identity", cte("insider") + " SELECT accession, owner, d, code FROM insider QUALIFY accession = MIN(accession) OVER (PARTITION BY ticker, d, code)")
def identity(s, d):
    return M.already_reported(view(s, d, "insider"), ["ticker", "d", "code"]).select("accession", "owner", "d", "code")


@register("jn18_co_presence", cte("signals") + " SELECT m, ticker FROM signals WHERE s1 > 0.05 AND s3 > 0.04")
def co_present(s, d):
    x = view(s, d, "signals")
    rows = x.where("s1 > 0.05").select("m", "ticker", F.lit("s1").alias("signal")).union(x.where("s3 > 0.04").select("m", "ticker", F.lit("s3").alias("signal")))
    return M.co_present(rows, ["s1", "s3"])


# ---------------------------------------------------------------- events


@register("ev01_insider_flow", cte("insider") + """, o AS (SELECT ticker, owner, SUM(CASE WHEN code = 'P' THEN value ELSE 0 END) AS bought, SUM(CASE WHEN code = 'S' THEN value ELSE 0 END) AS sold, COUNT_IF(code = 'P') AS buys, COUNT_IF(code = 'S') AS sells FROM insider GROUP BY ALL)
SELECT ticker, ROUND(SUM(bought) - SUM(sold), 2) AS net_value, SUM(buys)::BIGINT AS buys, SUM(sells)::BIGINT AS sells, COUNT_IF(buys > 0 AND bought >= 100000) AS buyers FROM o GROUP BY ticker""")
def insider_flow(s, d):
    return E.flow(view(s, d, "insider"), 100000.0).select("ticker", _r("net_value", 2), "buys", "sells", "buyers")


@register("ev02_trade_months", cte("insider") + " SELECT DISTINCT owner, CAST(YEAR(d) AS INT) AS y, CAST(MONTH(d) AS INT) AS m FROM insider")
def months(s, d):
    return E.trade_months(view(s, d, "insider"))


_TIER = """, p AS (SELECT DISTINCT owner, YEAR(d) AS y, MONTH(d) AS m FROM insider),
k AS (SELECT owner, COUNT(DISTINCT y) AS years, MAX(y) AS latest FROM p GROUP BY owner),
s AS (SELECT owner, MAX(n) AS same FROM (SELECT owner, m, COUNT(*) FILTER (y BETWEEN 1995 AND 1997) AS n FROM p GROUP BY ALL) GROUP BY owner),
tier AS (SELECT owner, CASE WHEN years < 3 OR 1998 - latest > 3 THEN 'unclassified' WHEN same = 3 THEN 'routine' ELSE 'opportunistic' END AS tier FROM k JOIN s USING (owner))"""


@register("ev03_owner_tier", cte("insider") + _TIER + " SELECT owner, tier FROM tier")
def tier(s, d):
    return E.owner_tier(E.trade_months(view(s, d, "insider")), 1998)


#: Order priorities stand for titles; an owner's account stands for the issuer, so most tickers name several issuers.
_ROLES = [(("urgent",), 1.00), (("high", "medium"), 0.90)]


@register("ev04_strength", cte("insider") + _TIER + """, b AS (SELECT i.*, COALESCE(t.tier, 'unclassified') AS tier, CASE WHEN i.ticker % 3 = 0 THEN i.owner % 2 ELSE i.ticker END AS issuer,
  CASE WHEN regexp_matches(lower(title), 'urgent') THEN 1.0 WHEN regexp_matches(lower(title), 'high|medium') THEN 0.9 ELSE 0.8 END AS role FROM insider i LEFT JOIN tier t USING (owner) WHERE code = 'P'),
q AS (SELECT * FROM b WHERE tier <> 'routine' AND value >= 100000 AND NOT (accession % 7 = 0) AND NOT COALESCE(title = '5-LOW', FALSE)),
g AS (SELECT ticker, COUNT(DISTINCT owner) AS owners, ROUND(SUM(value), 2) AS value, MAX(role) AS role, BOOL_OR(tier = 'opportunistic') AS o, MIN(issuer) AS issuer FROM q GROUP BY ticker HAVING COUNT(DISTINCT issuer) <= 1)
SELECT ticker, owners, value, CASE WHEN o THEN 'opportunistic' ELSE 'unclassified' END AS tier, ROUND(LEAST(1.0, (0.5 + LEAST(0.30, value / 5000000) + LEAST(0.20, 0.10 * (owners - 1))) * role * CASE WHEN o THEN 1.0 ELSE 0.6 END), 4) AS strength FROM g""")
def strength(s, d):
    trades = view(s, d, "insider")
    rows = trades.select(
        "*", F.when(F.col("ticker") % 3 == 0, F.col("owner") % 2).otherwise(F.col("ticker")).alias("issuer"), (F.col("accession") % 7 == 0).alias("joint"), (F.col("title") == "5-LOW").alias("planned"))
    buys = E.qualifying(rows, E.owner_tier(E.trade_months(trades), 1998))
    return E.strength(buys, _ROLES).select("ticker", "owners", _r("value", 2), "tier", "strength")


@register("ev05_book", cte("book") + " SELECT fund, q, COUNT(*) AS positions, ROUND(SUM(value), 2) AS value, SUM(shares) AS shares FROM book GROUP BY ALL")
def book(s, d):
    return view(s, d, "book").groupBy("fund", "q").agg(F.count("*").alias("positions"), F.round(F.sum("value"), 2).alias("value"), F.sum("shares").alias("shares"))


_BOOK = cte("book") + ", w AS (SELECT *, value / SUM(value) OVER (PARTITION BY fund, q) AS weight FROM book)"


@register("ev06_new_positions", _BOOK + " SELECT fund, q, cusip, ROUND(weight, 6) AS weight, ROUND(LEAST(1.0, weight / 0.05), 6) AS strength FROM w WHERE weight >= 0.0101234 AND NOT EXISTS (SELECT 1 FROM book p WHERE p.fund = w.fund AND p.q = w.q - 1 AND p.cusip = w.cusip) AND EXISTS (SELECT 1 FROM book p WHERE p.fund = w.fund AND p.q = w.q - 1)")
def new_positions(s, d):
    return E.new_positions(view(s, d, "book"), 0.0101234, 0.05).select("fund", "q", "cusip", _r("weight"), _r("strength"))


@register("ev07_material_adds", _BOOK + " SELECT w.fund, w.q, w.cusip, ROUND(w.shares / p.shares - 1, 6) AS growth, ROUND(w.weight - p.weight, 6) AS weight_change FROM w JOIN w p ON p.fund = w.fund AND p.q = w.q - 1 AND p.cusip = w.cusip WHERE p.shares > 0 AND w.shares / p.shares - 1 >= 0.5")
def adds(s, d):
    return E.material_adds(view(s, d, "book"), 0.5).select("fund", "q", "cusip", _r("growth"), _r("weight_change"))


@register("ev08_top_kept", _BOOK + """, n AS (SELECT *, LEAST(1.0, weight / 0.05) AS strength FROM w WHERE weight >= 0.0101234 AND NOT EXISTS (SELECT 1 FROM book p WHERE p.fund = w.fund AND p.q = w.q - 1 AND p.cusip = w.cusip) AND EXISTS (SELECT 1 FROM book p WHERE p.fund = w.fund AND p.q = w.q - 1)),
t AS (SELECT n.*, cusip % 40 AS ticker FROM n WHERE cusip IN (SELECT cusip FROM book WHERE fund = 4) AND cusip % 40 <> 7), o AS (SELECT * FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY fund, q, ticker ORDER BY ROUND(strength, 9) DESC, cusip) = 1)
SELECT fund, q, ticker, ROUND(ROUND(strength, 9), 6) AS strength, CAST(ROW_NUMBER() OVER (PARTITION BY fund, q ORDER BY ROUND(strength, 9) DESC, ticker) AS INT) AS place FROM o QUALIFY place <= 5""")
def top_kept(s, d):
    b = view(s, d, "book")
    names = b.where("fund = 4").select("cusip").distinct().withColumn("ticker", F.col("cusip") % 40)
    denied = names.where("ticker = 7").select("ticker").distinct()
    rows = E.new_positions(b, 0.0101234, 0.05).withColumn("strength", F.round("strength", 9))
    return E.top_kept(rows, names, denied, 5).select("fund", "q", "ticker", _r("strength"), "place")


@register("flt04_item_sets", "WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(CASE event_type WHEN 'view' THEN '1.01' WHEN 'click' THEN '3.03' WHEN 'purchase' THEN '2.02' WHEN 'error' THEN '4.02' ELSE '9.01' END))) AS items FROM events GROUP BY ALL) SELECT user_id, day, CASE WHEN list_has_all(items, ['1.01', '3.03']) OR list_has_all(items, ['4.02']) THEN list_sort(list_distinct(CASE WHEN list_has_all(items, ['1.01', '3.03']) THEN ['1.01', '3.03'] ELSE [] END || CASE WHEN list_contains(items, '4.02') THEN ['4.02'] ELSE [] END)) END AS matched FROM x")
def item_sets(s, d):
    """What a user did on a day, written as item codes; two sets of codes are looked for."""
    code = F.create_map(*[F.lit(x) for p in (("view", "Item 1.01"), ("click", "Item 3.03"), ("purchase", "Item 2.02"), ("error", "Item 4.02")) for x in p])
    days = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.collect_list(F.coalesce(code[F.col("event_type")], F.lit("Item 9.01"))), ", ").alias("text"))
    return days.select("user_id", "day", E.all_matched(E.item_codes(F.col("text")), [["3.03", "1.01"], ["4.02"]]).alias("matched"))


@register("flt05_form_flag", "SELECT event_id, CASE WHEN starts_with(event_type, 'p') THEN 'deal' WHEN starts_with(event_type, 'cl') THEN 'report' WHEN starts_with(event_type, 'c') THEN 'other' END AS flag FROM events")
def forms(s, d):
    return table(s, d, "events").select("event_id", E.form_flag(F.col("event_type"), [("p", "deal"), ("cl", "report"), ("c", "other")]).alias("flag"))


@register("ev11_event_section", """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id AS ticker, BOOL_OR(event_type = 'purchase') AS bought, BOOL_OR(event_type = 'click') AS clicked, list(event_id ORDER BY k) FILTER (k <= 3) AS newest, CAST(MAX(ts) FILTER (event_type = 'purchase') AS DATE) AS last_day FROM r GROUP BY 1""")
def section(s, d):
    return E.section(view(s, d, "news"), F.lit("2024-01-10").cast("timestamp"), {"bought": "purchase", "clicked": "click"}, 3)


@register("ev12_news_volume", """WITH d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS d, COUNT(*) AS c FROM events GROUP BY ALL), y AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT ticker, day, SUM(CASE WHEN day - d < 7 THEN c ELSE 0 END)::BIGINT AS last_7, SUM(CASE WHEN day - d BETWEEN 7 AND 13 THEN c ELSE 0 END)::BIGINT AS prior_7, SUM(c)::BIGINT AS last_30, SUM(CASE WHEN day - d < 7 THEN c ELSE 0 END) > SUM(CASE WHEN day - d BETWEEN 7 AND 13 THEN c ELSE 0 END) AS rising
FROM d JOIN y ON day - d BETWEEN 0 AND 29 GROUP BY ALL""")
def news_volume(s, d):
    news = view(s, d, "news")
    return E.attention(news, news.select(F.to_date("ts").alias("day")).distinct())


@register("ev15_trailing_sums", cte("insider") + """ SELECT ticker, ROUND(SUM(CASE WHEN a BETWEEN 0 AND 364 THEN value ELSE 0 END), 2) AS ttm, ROUND(SUM(CASE WHEN a BETWEEN 365 AND 729 THEN value ELSE 0 END), 2) AS prior, COUNT(DISTINCT CASE WHEN a BETWEEN 0 AND 364 THEN owner END) AS counterparts, ARG_MAX(accession, (ABS(value), accession)) AS largest, MAX(d) FILTER (a >= 0) AS latest
FROM (SELECT *, DATE '2000-06-30' - d AS a FROM insider) GROUP BY ticker""")
def trailing(s, d):
    return E.trailing_sums(view(s, d, "insider"), F.lit("2000-06-30").cast("date"), "ticker", "d", "value").select("ticker", _r("ttm", 2), _r("prior", 2), "counterparts", "largest", "latest")


@register("ev18_quarter_label", "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS VARCHAR) || 'q' || QUARTER(o_orderdate) AS label FROM orders")
def label(s, d):
    return table(s, d, "orders").select("o_orderkey", E.quarter_label(F.col("o_orderdate")).alias("label"))


@register("ev22_capture_class", "SELECT user_id AS ticker, CAST(ts AS DATE) AS day, CASE WHEN COUNT(DISTINCT event_type) < 3 THEN 'thin' ELSE 'captured' END AS class FROM events GROUP BY ALL")
def capture(s, d):
    parts = table(s, d, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day")).agg(F.count_distinct("event_type").alias("parts"))
    return E.capture_class(parts, 3).select("ticker", "day", "class")


@register("ev23_readiness", "SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS names, COUNT(*) AS n, COUNT(DISTINCT user_id) >= 100 AS broad FROM events GROUP BY ROLLUP (CAST(ts AS DATE))")
def ready(s, d):
    return E.readiness(table(s, d, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day")), 100)
