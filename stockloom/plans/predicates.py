"""Queries over names, calendars and small projections; stakes, ratings and other event summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.functions import columns as C
from stockloom.operators import events as E
from stockloom.operators import merge as M
from stockloom.operators import peers as G
from stockloom.operators import predicates as Q


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@register("flt01_ticker_form", "SELECT id, upper(substr(replace(name, ' ', ''), 1, CAST(2 + id % 7 AS INT))) AS ticker, regexp_matches(upper(substr(replace(name, ' ', ''), 1, CAST(2 + id % 7 AS INT))), '^[A-Z][A-Z0-9.\\-]{0,5}$') AS good, regexp_matches(upper(substr(replace(name, ' ', ''), 1, CAST(2 + id % 7 AS INT))), '^[A-Z]{4}[FYWURQX]$') AS odd FROM (SELECT p_partkey AS id, p_name AS name FROM part)")
def ticker_form(s, d):
    t = F.upper(F.substring(F.replace("name", F.lit(" "), F.lit("")), F.lit(1), (2 + F.col("id") % 7).cast("int")))
    return view(s, d, "names").select("id", M.real_ticker(t).alias("ticker"), M.well_formed(t).alias("good"), M.not_common(t).alias("odd"))


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'))"
_TELLING = "list_filter(regexp_split_to_array(" + _PLAIN + ", ' +'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in Q.GENERIC_WORDS) + "))"


@register("flt06_shell_and_affiliate", f"""WITH n AS (SELECT p_partkey AS id, p_name || CASE p_size % 5 WHEN 0 THEN ' Acquisition Corp.' WHEN 1 THEN ' Capital, L.P.' WHEN 2 THEN ' Starboard Fund' ELSE ' Group' END AS a, p_type || ' ' || p_name || ' Holding' AS b, p_brand || ' Partners the Group' AS c, CASE p_size % 3 WHEN 0 THEN ' sc 13d' WHEN 1 THEN 'SCHEDULE 13D/A' ELSE '8-K' END AS form FROM part)
SELECT id, regexp_matches({_PLAIN.format("a")}, 'acquisition corp|acquisition company|acquisition holdings|blank check|spac') AS shell, list_has_any({_TELLING.format("a")}, {_TELLING.format("b")}) AS affiliate, list_has_any({_TELLING.format("a")}, {_TELLING.format("c")}) AS generic_only,
CASE WHEN contains(lower(a), 'starboard') THEN 'Starboard' END AS marquee, upper(trim(form)) IN ('SCHEDULE 13D', 'SC 13D') AS initial, upper(trim(form)) IN ('SCHEDULE 13D/A', 'SC 13D/A') AS amended FROM n""")
def shells(s, d):
    """Names and forms put together from the parts' columns."""
    k = F.col("p_size") % 5
    a = F.concat("p_name", F.when(k == 0, " Acquisition Corp.").when(k == 1, " Capital, L.P.").when(k == 2, " Starboard Fund").otherwise(" Group"))
    form = F.when(F.col("p_size") % 3 == 0, " sc 13d").when(F.col("p_size") % 3 == 1, "SCHEDULE 13D/A").otherwise("8-K")
    b, c = F.concat("p_type", F.lit(" "), "p_name", F.lit(" Holding")), F.concat("p_brand", F.lit(" Partners the Group"))
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), Q.shell_name(a).alias("shell"), Q.affiliate(a, b).alias("affiliate"), Q.affiliate(a, c).alias("generic_only"), Q.marquee(a).alias("marquee"), Q.initial_form(form).alias("initial"), Q.amended_form(form).alias("amended"))


@register("flt07_trade_kind", cte("insider") + " SELECT accession, CASE code WHEN 'P' THEN 'buy' WHEN 'S' THEN 'sell' ELSE 'award' END AS kind, CAST(CASE WHEN title LIKE '%URGENT%' THEN 3 WHEN title LIKE '%HIGH%' THEN 2 ELSE 1 END AS INT) AS tier FROM insider")
def trade_kind(s, d):
    return view(s, d, "insider").select("accession", Q.trade_kind(F.col("code")).alias("kind"), Q.role_tier(F.col("title")).alias("tier"))


@register("flt08_stake_percent", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)href="[^"]*?([0-9]{1,3})"', 1) AS xml, regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?is)page=([0-9]{1,3})|([0-9]{1,3}(?:\.[0-9]+)?)\s*%', 2) AS txt FROM pages),
v AS (SELECT page_id, list_filter(list_transform(CASE WHEN len(xml) > 0 THEN xml ELSE txt END, lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x > 0 AND x <= 100) AS v FROM p) SELECT page_id, list_max(v) AS stake FROM v""".replace("\\\\", "\\"))
def stake(s, d):
    """Figures at the end of link targets stand for tagged percentages, those before a percent sign for written ones."""
    p = table(s, d, "pages")
    return p.select("page_id", Q.stake_percent(F.col("html"), r'(?i)href="[^"]*?([0-9]{1,3})"', r"(?is)(?:page=[0-9]{1,3}|([0-9]{1,3}(?:\.[0-9]+)?)\s*%)").alias("stake"))


@register("flt12_safe_text", r"""WITH x AS (SELECT page_id, trim(COALESCE(url, '')) AS u, regexp_replace(replace(replace(replace(COALESCE(html, ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM pages),
y AS (SELECT *, trim(regexp_replace(regexp_replace(nfc_normalize(t), '[\s\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '[\p{Cc}\p{Cf}]', '', 'g'), ' ') AS o FROM x)
SELECT page_id, CASE WHEN length(o) <= 300 THEN o ELSE rtrim(substr(o, 1, 299), ' ') || '…' END AS text, CASE WHEN regexp_matches(u, '(?i)^https?://\S+$') AND NOT regexp_matches(u, '[\p{Cc}\p{Cf}]') THEN u ELSE '' END AS url FROM y""")
def safe_text(s, d):
    """Pages hold four kinds of entities, which the twin names; the decoder knows all (tested)."""
    return table(s, d, "pages").select("page_id", Q.safe_text(F.col("html"), 300).alias("text"), Q.safe_url(F.col("url")).alias("url"))


@register("flt10_units_and_age", "SELECT event_id, ROUND(value / 100, 6) AS fraction, CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS INT) AS age FROM events")
def units(s, d):
    return table(s, d, "events").select("event_id", F.round(C.fraction(F.col("value")), 6).alias("fraction"), C.age_days(F.lit("2024-02-01"), F.col("ts")).alias("age"))


@register("flt13_quantisers", "SELECT o_orderkey, CAST(FLOOR(LN(o_totalprice) / LN(1.1)) AS BIGINT) AS band, sha256(CAST(CAST(FLOOR(LN(o_totalprice) / LN(1.1)) AS BIGINT) AS VARCHAR) || '|' || o_orderpriority) AS key FROM orders WHERE o_totalprice > 0")
def quantisers(s, d):
    band = C.log_band(F.col("o_totalprice"), 0.1)
    return table(s, d, "orders").where("o_totalprice > 0").select("o_orderkey", band.alias("band"), Q.change_key(band, F.col("o_orderpriority")).alias("key"))


@register("flt14_sessions", """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events),
n AS (SELECT day, CAST(day - CAST(k AS INT) AS DATE) AS near, k FROM x, range(0, 10) r(k)),
t AS (SELECT day, near, k, dayofweek(near) BETWEEN 1 AND 5 AND NOT (MONTH(near) = 1 AND DAY(near) = 1) AND NOT (MONTH(near) = 12 AND DAY(near) = 25) AND near <> DATE '2024-01-15' AS open FROM n)
SELECT day, BOOL_OR(open AND k = 0) AS open, MAX(near) FILTER (open) AS last_session FROM t GROUP BY day""")
def sessions(s, d):
    days = table(s, d, "events").select(F.to_date("ts").alias("day")).union(table(s, d, "orders").select(F.to_date("o_orderdate"))).distinct()
    years = days.select(F.year("day").alias("y")).distinct()
    fixed = years.select(F.explode(F.array(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(25)), F.make_date(F.col("y") - 1, F.lit(12), F.lit(25)))).alias("day"))
    more = s.sql("SELECT DATE '2024-01-15' AS day")
    return Q.sessions(days, fixed.union(more).distinct())


@register("fn11_upside", cte("stmts") + " SELECT entity, fiscal_year, ROUND(CASE WHEN revenue <> 0 THEN revenue / NULLIF(total_equity, 0) - 1 END, 6) AS upside FROM stmts")
def upside(s, d):
    return view(s, d, "stmts").select("entity", "fiscal_year", F.round(Q.upside(F.col("revenue"), F.col("total_equity")), 6).alias("upside"))


@register("fn13_inventory_days", cte("stmts") + """, i AS (SELECT entity, fiscal_year, CASE WHEN revenue - gross_profit > 0 THEN total_debt * 365 / (revenue - gross_profit) END AS dio, total_debt / NULLIF(LAG(total_debt) OVER w, 0) - revenue / NULLIF(LAG(revenue) OVER w, 0) AS gap FROM stmts WINDOW w AS (PARTITION BY entity ORDER BY fiscal_year))
SELECT entity, fiscal_year, ROUND(dio, 5) AS dio, ROUND(gap, 6) AS gap FROM i""")
def inventory(s, d):
    w = Window.partitionBy("entity").orderBy("fiscal_year")
    grow = lambda c: C.ratio(F.col(c), F.lag(c).over(w))
    return view(s, d, "stmts").select("entity", "fiscal_year", F.round(Q.inventory_days(F.col("total_debt"), F.col("revenue") - F.col("gross_profit")), 5).alias("dio"), F.round(grow("total_debt") - grow("revenue"), 6).alias("gap"))


@register("jn19_holdings_to_cards", "SELECT o_orderkey, o_custkey, c_acctbal AS composite, c_custkey IS NULL AS alert FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey")
def holdings(s, d):
    cards = table(s, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return table(s, d, "orders").join(cards, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.col("c_acctbal").alias("composite"), F.col("c_custkey").isNull().alias("alert"))


@register("jn20_veto", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def veto(s, d):
    e = table(s, d, "events")
    return e.join(e.where("event_type = 'purchase' and value > 95").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


@register("jn21_share_class_twins", "WITH m AS (SELECT s_suppkey AS ticker, s_nationkey AS sector, FLOOR(s_acctbal / 3000) AS cap, CASE WHEN s_suppkey % 9 <> 0 THEN 1 END AS growth FROM supplier) SELECT ticker FROM m QUALIFY NOT (growth IS NOT NULL AND cap IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY sector, cap, growth ORDER BY ticker) > 1)")
def twins(s, d):
    m = table(s, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"), F.floor(F.col("s_acctbal") / 3000).alias("cap"), F.when(F.col("s_suppkey") % 9 != 0, 1).alias("growth"))
    return Q.share_class_twins(m).select("ticker")


_ACTIVISTS = "['Elliott Capital', 'Icahn Partners', 'Jana LP', 'Blue Harbor', 'Quiet Fund', 'Brand Value']"


@register("ev09_stakes", f"""WITH r AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE 'tk' || o_custkey % 50 END AS ticker, o_custkey AS cik, CASE o_orderpriority WHEN '1-URGENT' THEN 'Quiet Acquisition Corp' WHEN '2-HIGH' THEN 'Blue Ridge' ELSE 'Plain Name Inc' END AS subject, ({_ACTIVISTS})[CAST(1 + o_orderkey % 6 AS INT)] AS activist,
  CASE o_orderstatus WHEN 'F' THEN 'SC 13D' WHEN 'O' THEN 'Schedule 13D' ELSE 'SC 13D/A' END AS form, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 + 0.5 END AS pct FROM orders WHERE o_totalprice > 200000),
k AS (SELECT *, upper(ticker) AS t FROM r WHERE upper(ticker) <> 'N/A' AND form <> 'SC 13D/A' AND subject <> 'Quiet Acquisition Corp' AND NOT (subject = 'Blue Ridge' AND activist = 'Blue Harbor')),
g AS (SELECT t AS ticker, COUNT(DISTINCT activist) AS activists, MIN(activist) FILTER (activist IN ('Elliott Capital', 'Icahn Partners', 'Jana LP')) AS m, ARG_MIN(cik, pos) AS cik, ARG_MIN(subject, pos) AS subject, ARG_MIN(CAST(pct AS DOUBLE), pos) FILTER (pct IS NOT NULL) AS pct FROM k GROUP BY t)
SELECT ticker, cik, subject, activists, str_split(m, ' ')[1] AS marquee, ROUND(LEAST(1.0, 0.7 + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END + LEAST(0.1, 0.05 * (activists - 1))), 6) AS strength, pct FROM g""")
def stakes(s, d):
    """Orders above a value stand for filings; names, forms and percentages follow their columns."""
    o, k = table(s, d, "orders").where("o_totalprice > 200000"), F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("Elliott Capital", "Icahn Partners", "Jana LP", "Blue Harbor", "Quiet Fund", "Brand Value")])
    records = o.select(
        F.when(k % 17 == 0, "n/a").otherwise(F.concat(F.lit("tk"), F.col("o_custkey") % 50)).alias("ticker"), F.col("o_custkey").alias("cik"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Quiet Acquisition Corp").when(F.col("o_orderpriority") == "2-HIGH", "Blue Ridge").otherwise("Plain Name Inc").alias("subject"), F.get(names, (k % 6).cast("int")).alias("activist"),
        F.when(F.col("o_orderstatus") == "F", "SC 13D").when(F.col("o_orderstatus") == "O", "Schedule 13D").otherwise("SC 13D/A").alias("form"), k.alias("accession"), k.alias("pos"), F.when(k % 3 == 0, (k % 40 + F.lit(0.5)).cast("double")).alias("pct"))
    return E.stakes(records).select("ticker", "cik", "subject", "activists", "marquee", _r("strength"), "pct")


_REPORT = """r AS (SELECT 'a' || o_orderkey // 2 AS adsh, CASE o_orderstatus WHEN 'P' THEN '8-K/A' ELSE '8-K' END AS file_type, o_orderpriority AS items, o_custkey AS cik, CAST(o_orderdate AS DATE) AS file_date, o_orderkey AS pos, c_nationkey = 7 AS blank, c_mktsegment = 'MACHINERY' AS shell
  FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT * FROM r WHERE file_type = '8-K' QUALIFY ROW_NUMBER() OVER (PARTITION BY adsh ORDER BY pos) = 1),
dir AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 9 = 0 THEN 'ABCDW' ELSE 'TK' || c_custkey % 50 END AS ticker FROM customer WHERE c_acctbal > 0)"""


def _reports(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    codes = F.when(F.col("o_orderpriority") == "1-URGENT", "Item 1.01, Item 3.03, 9.01").when(F.col("o_orderpriority") == "2-HIGH", "2.02 4.02").when(F.col("o_orderpriority") == "3-MEDIUM", "1.01").when(F.col("o_orderpriority") == "5-LOW", "5.01, 3.01, 5.01")
    rows = o.select(
        F.concat(F.lit("a"), F.floor(F.col("o_orderkey") / 2)).alias("adsh"), F.when(F.col("o_orderstatus") == "P", "8-K/A").otherwise("8-K").alias("file_type"), codes.alias("items"), F.when(F.col("c_nationkey") == 7, F.array(F.lit("6770"))).alias("sics"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Some SPAC Ltd").otherwise(F.col("c_name")).alias("name"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("file_date"), F.col("o_orderkey").alias("pos"))
    c = table(s, d, "customer").where("c_acctbal > 0")
    directory = c.select(F.col("c_custkey").alias("cik"), F.when(F.col("c_custkey") % 9 == 0, "abcdw").otherwise(F.concat(F.lit("tk"), F.col("c_custkey") % 50)).alias("ticker"))
    return rows, directory


@register("ev10_report_pocket", "WITH " + _REPORT + """, deny AS (SELECT DISTINCT 'TK' || s_suppkey % 50 AS ticker FROM supplier WHERE s_acctbal < 0)
SELECT ticker, file_date, adsh, f.cik, ['1.01', '3.03'] AS matched FROM f JOIN dir USING (cik) WHERE items = '1-URGENT' AND NOT blank AND NOT shell AND ticker <> 'ABCDW' AND ticker NOT IN (SELECT ticker FROM deny) QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, file_date ORDER BY pos) = 1""")
def pocket(s, d):
    """Orders stand for reports, pairs of them for one accession; priorities for items, debtors for denied names."""
    rows, directory = _reports(s, d)
    denied = table(s, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("TK"), F.col("s_suppkey") % 50).alias("ticker"))
    return E.pocket(rows, directory, denied)


@register("ev10b_vetoes", "WITH " + _REPORT + " SELECT ticker, f.cik, adsh, file_date, CASE items WHEN '2-HIGH' THEN ['4.02'] ELSE ['3.01', '5.01'] END AS items FROM f JOIN dir USING (cik) WHERE items IN ('2-HIGH', '5-LOW')")
def vetoes(s, d):
    return E.vetoes(*_reports(s, d))


@register("ev13_earnings_summary", cte("news") + """, r AS (SELECT ticker, ts AS period, CASE WHEN event_id % 7 <> 0 THEN ROUND(value - 50, 4) END AS sp, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ts DESC) AS n FROM news WHERE event_type = 'purchase'),
a AS (SELECT ticker, COALESCE(list(sp ORDER BY n) FILTER (sp IS NOT NULL), []) AS surprises, COUNT_IF(sp > 0) AS beats, MAX(period) AS period FROM r WHERE n <= 8 GROUP BY ticker),
c AS (SELECT ticker, MIN(ts) FILTER (ts >= TIMESTAMP '2024-01-20' AND value < 50) AS next_day, MAX(ts) FILTER (ts <= TIMESTAMP '2024-01-20' AND value >= 50) AS told FROM news WHERE event_type = 'error' GROUP BY ticker)
SELECT COALESCE(a.ticker, c.ticker) AS ticker, surprises, CASE WHEN len(surprises) > 0 THEN CAST(len(surprises) AS INT) END AS quarters, CASE WHEN len(surprises) > 0 THEN beats END AS beats, surprises[1] AS last_surprise, next_day, COALESCE(told, period) AS last_report, told IS NULL AS estimated FROM a FULL JOIN c ON a.ticker = c.ticker""")
def earnings(s, d):
    """Purchases stand for reports, errors for the calendar: a value of 50 or more is an actual."""
    e = view(s, d, "news")
    reports = e.where("event_type = 'purchase'").select("ticker", F.col("ts").alias("period"), F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") - 50, 4)).alias("surprise"))
    calendar = e.where("event_type = 'error'").select("ticker", F.col("ts").alias("day"), F.when(F.col("value") >= 50, F.col("value")).alias("actual"))
    return E.earnings_summary(reports, calendar, F.lit("2024-01-20").cast("timestamp"))


@register("ev14_rating_revision", "WITH m AS (SELECT user_id AS ticker, date_trunc('week', ts) AS w, COUNT_IF(event_type = 'purchase') AS buy, COUNT(*) AS n FROM events GROUP BY ALL) SELECT ticker, ARG_MAX(buy, w) AS newest, ARG_MAX(buy, w) - ARG_MIN(buy, w) AS change FROM m GROUP BY ticker")
def ratings(s, d):
    m = view(s, d, "news").groupBy("ticker", F.date_trunc("week", "ts").alias("w")).agg(F.count_if(F.col("event_type") == "purchase").alias("buy"))
    return m.groupBy("ticker").agg(F.max_by("buy", "w").alias("newest"), (F.max_by("buy", "w") - F.min_by("buy", "w")).alias("change"))


@register("ev16_deduplicated_spend", cte("insider") + """, u AS (SELECT ticker, d, ARG_MIN(value, accession) AS spend, ARG_MIN(owner, accession) AS owner FROM insider GROUP BY ALL)
SELECT ticker, ROUND(SUM(CASE WHEN DATE '2000-06-30' - d BETWEEN 0 AND 364 THEN spend ELSE 0 END), 2) AS ttm, COUNT(DISTINCT owner) AS registrants FROM u GROUP BY ticker""")
def spend(s, d):
    u = M.first_by(view(s, d, "insider"), ["ticker", "d"], ["accession"])
    age = F.datediff(F.lit("2000-06-30").cast("date"), "d")
    return u.groupBy("ticker").agg(F.round(F.sum(F.when(age.between(0, 364), F.col("value")).otherwise(0.0)), 2).alias("ttm"), F.count_distinct("owner").alias("registrants"))


@register("ev17_by_filing_day", "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS filings, MIN(o_orderkey) AS first_id FROM orders GROUP BY ALL")
def by_day(s, d):
    return view(s, d, "insider").groupBy(F.col("d").alias("day")).agg(F.count("*").alias("filings"), F.min("accession").alias("first_id"))


@register("pf04_relative_move", cte("stmts") + """, g AS (SELECT entity, fiscal_year, revenue, 100 * (revenue / NULLIF(LAG(revenue) OVER (PARTITION BY entity ORDER BY fiscal_year), 0) - 1) AS r FROM stmts), y AS (SELECT *, entity % 10 AS sector FROM g WHERE r IS NOT NULL),
p AS (SELECT a.entity, a.fiscal_year, a.r, MEDIAN(b.r) AS med, COUNT(b.r) AS n FROM y a LEFT JOIN y b ON b.sector = a.sector AND b.fiscal_year = a.fiscal_year AND b.entity <> a.entity GROUP BY ALL),
m AS (SELECT fiscal_year, MEDIAN(r) AS mkt FROM y GROUP BY 1), c AS (SELECT sector, fiscal_year, SUM(revenue) / SUM(revenue / (1 + r / 100)) - 1 AS together FROM y WHERE r > -100 GROUP BY ALL), x AS (SELECT p.*, med - mkt AS shared, r - med AS gap FROM p JOIN m USING (fiscal_year))
SELECT entity, x.fiscal_year, ROUND(gap, 4) AS gap, ROUND(shared, 4) AS shared, CASE WHEN ABS(gap) < 5 AND ABS(shared) < 5 THEN 'small' WHEN ABS(gap) >= ABS(shared) THEN 'own' ELSE 'shared' END AS verdict, ROUND(together, 6) AS together
FROM x JOIN c ON c.sector = entity % 10 AND c.fiscal_year = x.fiscal_year WHERE n >= 3""")
def relative(s, d):
    """Revenue growth of every year against sector peers (the name itself left out) and against all names."""
    w = Window.partitionBy("entity").orderBy("fiscal_year")
    y = view(s, d, "stmts").withColumn("r", 100 * (C.ratio(F.col("revenue"), F.lag("revenue").over(w)) - 1)).where("r is not null").withColumn("sector", F.col("entity") % 10)
    mkt = y.groupBy("fiscal_year").agg(F.median("r").alias("mkt"))
    together = y.groupBy("sector", "fiscal_year").agg(G.combined_growth(F.col("revenue"), F.lit(1.0), F.col("r") / 100).alias("together"))
    # the median of the others of a group: by place, from the group's sorted returns around the own place
    seen = G.median_of_others(y, ["sector", "fiscal_year"], "entity", "r")
    x = seen.join(F.broadcast(mkt), "fiscal_year").join(together, ["sector", "fiscal_year"])  # one row a year
    split = G.relative(F.col("r"), F.col("med"), F.col("n"), F.col("mkt"), 3)
    return x.withColumn("x", split).where("x is not null").select("entity", "fiscal_year", F.round("x.gap", 4).alias("gap"), F.round("x.shared", 4).alias("shared"), "x.verdict", F.round("together", 6).alias("together"))


@register("ud01_signal_registry", cte("signals") + " SELECT m, ticker, 'cheap' AS signal, s1 AS value FROM signals UNION ALL SELECT m, ticker, 'busy', s2 FROM signals")
def registry(s, d):
    """Pluggable signals: functions from a frame to long rows, unioned; no per-row callbacks."""
    sources = {"cheap": lambda x: x.select("m", "ticker", F.col("s1").alias("value")), "busy": lambda x: x.select("m", "ticker", F.col("s2").cast("double").alias("value"))}
    frame = view(s, d, "signals")
    out = None
    for name, f in sources.items():
        rows = f(frame).select("m", "ticker", F.lit(name).alias("signal"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out
