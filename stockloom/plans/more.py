"""Further queries: feeds and statement selection, merges, study reports, peers, guarded calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.functions import columns as C
from stockloom.functions.ranks import mid_rank
from stockloom.operators import merge as M
from stockloom.operators import peers as G
from stockloom.operators import pit as T
from stockloom.operators import scoring as S
from stockloom.operators import study as D
from stockloom.plans import fundamentals as PF
from stockloom.plans import research as PR
from stockloom.sources import files


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# ---------------------------------------------------------------- feeds


@register("src08_newest_settlement", "WITH n AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders)) SELECT upper(o_orderpriority) AS symbol, ARG_MAX(o_totalprice, o_orderkey) AS shares, CAST(ARG_MAX(o_orderstatus, o_orderkey) = 'F' AS BOOLEAN) AS rising FROM (SELECT replace(o_orderpriority, '-', '') AS o_orderpriority, o_totalprice, o_orderkey, o_orderstatus FROM n) GROUP BY 1")
def newest_settlement(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("string").alias("shares"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("mark"), F.to_date("o_orderdate").cast("string").alias("settled"))
    return files.short_interest(rows).select("symbol", "shares", "rising")


@register("src09_mentions", "WITH m AS (SELECT user_id, event_type, COUNT(*) AS mentions, MAX(event_id) AS pos, MIN(event_id) % 50 AS day_ago FROM events GROUP BY ALL) SELECT upper(event_type) AS symbol, mentions, day_ago, pos, ROUND(CASE WHEN day_ago > 0 THEN mentions / day_ago - 1 END, 6) AS delta, mentions > day_ago AS rising FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY upper(event_type) ORDER BY mentions DESC, pos DESC) = 1")
def mentions(s, d):
    m = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.count("*").alias("mentions"), F.max("event_id").alias("pos"), (F.min("event_id") % 50).alias("day_ago"))
    return files.mentions(m).select("symbol", "mentions", "day_ago", "pos", _r("delta"), "rising")


@register("src12_directory", "WITH x AS (SELECT s_nationkey AS cik, s_suppkey AS pos, 'T' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '-UN' ELSE '' END AS ticker FROM supplier), g AS (SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, ARG_MIN(ticker, pos) AS first, list(DISTINCT ticker) AS every FROM x GROUP BY 1) SELECT cik, first AS ticker FROM g")
def directory(s, d):
    x = table(s, d, "supplier").select(F.col("s_nationkey").alias("cik"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "-UN").otherwise("")).alias("ticker"))
    return files.directory(x)


@register("src15_stale_names", "SELECT DISTINCT o_custkey AS ticker FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def stale(s, d):
    return files.stale_names(table(s, d, "orders").select(F.col("o_custkey").alias("ticker")), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ticker")))


_CONCEPT = "x AS (SELECT o_custkey AS cik, CAST(YEAR(o_orderdate) AS INT) AS yr, o_orderpriority AS concept, MAX(o_totalprice) AS val FROM orders GROUP BY ALL)"


def _concepts(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("end"), F.col("o_orderpriority").alias("concept")).agg(F.max("o_totalprice").alias("val")).withColumn("level", F.lit(1)).withColumn("pos", F.lit(0))


@register("src18_complete_concept", f"WITH {_CONCEPT}, p AS (SELECT cik, COUNT(DISTINCT yr) AS n FROM x GROUP BY 1), k AS (SELECT cik, concept, CASE concept WHEN '1-URGENT' THEN 0 ELSE 1 END AS prio FROM x JOIN p USING (cik) WHERE concept IN ('1-URGENT', '2-HIGH') GROUP BY cik, concept, n HAVING COUNT(val) = n), b AS (SELECT cik, ARG_MIN(concept, prio) AS concept FROM k GROUP BY 1) SELECT x.cik, x.yr, x.concept, x.val FROM x JOIN b ON b.cik = x.cik AND b.concept = x.concept")
def complete_concept(s, d):
    return files.complete_concept(_concepts(s, d), ["1-URGENT", "2-HIGH"]).withColumnRenamed("end", "yr")


@register("src19_summed_concepts", f"WITH {_CONCEPT}, g AS (SELECT cik, yr, SUM(val) FILTER (concept IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS val FROM x GROUP BY ALL) SELECT cik, yr, ROUND(val, 2) AS val FROM g WHERE cik NOT IN (SELECT cik FROM g WHERE val IS NULL)")
def summed_concepts(s, d):
    return files.summed_concepts(_concepts(s, d), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("cik", F.col("end").alias("yr"), _r("val", 2))


@register("src20_fetch_status", "SELECT event_type || ':' || user_id AS source, CASE MIN(CASE WHEN event_id % 97 = 1 THEN 0 WHEN event_id % 50 = 1 THEN 1 WHEN event_id % 7 = 1 THEN 2 ELSE 3 END) WHEN 0 THEN 'limit' WHEN 1 THEN 'throttled' WHEN 2 THEN 'error' ELSE 'ok' END AS status FROM events GROUP BY 1")
def fetch_status(s, d):
    error = F.when(F.col("event_id") % 97 == 1, "http 402").when(F.col("event_id") % 50 == 1, "429 slow down").when(F.col("event_id") % 7 == 1, "broken 4021")
    return files.fetch_status(table(s, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("source"), error.alias("error")))


@register("src17_vendor_statements", "WITH i AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS income FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS assets FROM lineitem WHERE l_linenumber = 2) SELECT x.ticker, x.date, income, assets FROM (SELECT ticker, date, ARG_MIN(income, pos) AS income FROM i GROUP BY ALL) x LEFT JOIN (SELECT ticker, date, ARG_MIN(assets, pos) AS assets FROM b GROUP BY ALL) y ON x.ticker = y.ticker AND x.date = y.date")
def vendor(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    part = lambda n, c, name: li.where(F.col("l_linenumber") == n).select("ticker", "date", "pos", F.col(c).alias(name))
    return files.join_statements(part(1, "l_extendedprice", "income"), part(2, "l_quantity", "assets"), part(3, "l_tax", "cash")).select("ticker", "date", "income", "assets")


# ---------------------------------------------------------------- merges and point in time


@register("jn09_insider_merge", "WITH x AS (SELECT o_custkey AS k, o_orderstatus AS source, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, COUNT(*) AS trades, CASE WHEN COUNT(*) > 2 THEN ROUND(SUM(o_totalprice), 2) END AS mood FROM orders GROUP BY ALL) SELECT k, ARG_MIN(source, rank) AS trade_source, ARG_MIN(trades, rank) AS trades, ARG_MIN(mood, rank) FILTER (mood IS NOT NULL) AS mood FROM x GROUP BY k")
def insider_merge(s, d):
    """Trades come whole from one source; the mood is picked independently."""
    x = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("trades"), F.when(F.count("*") > 2, F.round(F.sum("o_totalprice"), 2)).alias("mood"))
    x = M.ranked_sources(x, ["F", "O"])
    return M.pick_first(x, "k", ["trades"]).select("k", F.col("source").alias("trade_source"), "trades").join(M.merge_fields(x, "k", ["mood"]).select("k", "mood"), "k")


@register("pit13_capital_by_year", cte("stmts") + " SELECT entity, fiscal_year, ROUND(net_income * 0.75, 4) AS nopat, ROUND(total_debt + total_equity, 2) AS invested, ROUND(net_income * 0.75 / NULLIF(total_debt + total_equity, 0), 6) AS roic FROM stmts WHERE total_debt + total_equity > 0")
def capital_by_year(s, d):
    cap = F.col("total_debt") + F.col("total_equity")
    return view(s, d, "stmts").where(cap > 0).select("entity", "fiscal_year", F.round(F.col("net_income") * 0.75, 4).alias("nopat"), F.round(cap, 2).alias("invested"), F.round(C.ratio(F.col("net_income") * 0.75, cap), 6).alias("roic"))


@register("st08_fact_versions", cte("facts") + " SELECT cik, tag, fy_end, COUNT(*) AS versions, MIN(filed) AS first_filed, MAX(filed) AS last_filed FROM facts GROUP BY ALL")
def versions(s, d):
    return view(s, d, "facts").groupBy("cik", "tag", "fy_end").agg(F.count("*").alias("versions"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"))


@register("bt17_fundamental_replay", cte("facts") + """, g AS (SELECT MAKE_DATE(y, 6, 30) AS as_of FROM range(1997, 2004) t(y)), k AS (SELECT f.*, g.as_of FROM facts f JOIN g ON f.filed <= g.as_of AND f.fy_end <= g.as_of),
t AS (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, tag, fy_end ORDER BY filed DESC, pos) = 1), w AS (SELECT cik, as_of, fy_end, MAX(val) FILTER (tag = '1-URGENT') AS a, MAX(val) FILTER (tag = '2-HIGH') AS b FROM t GROUP BY ALL)
SELECT as_of, cik, ROUND(ARG_MAX(a / NULLIF(b, 0), fy_end), 6) AS value FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def replay(s, d):
    """One signal per (filer, grid date) from what was known then, all dates in one job."""
    dates = s.range(1997, 2004).select(F.make_date(F.col("id").cast("int"), F.lit(6), F.lit(30)).alias("as_of"))
    wide = T.panel(T.per_tag(T.known(view(s, d, "facts"), dates)), {"1-URGENT": "a", "2-HIGH": "b"})
    return T.latest_ratio(wide, "a", "b").select("as_of", "cik", F.round("ratio", 6).alias("value"))


# ---------------------------------------------------------------- study reports


@register("ds02_mid_rank", PR._ROWS + f" SELECT firm, year, ROUND({PR._MID}, 6) AS pct FROM r")
def mid(s, d):
    return PR._rows(s, d).select("firm", "year", F.round(mid_rank("roic", "year"), 6).alias("pct"))


@register("ds04_capital_growth", cte("stmts") + """, r AS (SELECT entity AS firm, fiscal_year AS year, total_debt + total_equity AS cap, net_income AS ni, revenue FROM stmts WHERE total_debt + total_equity > 0),
s AS (SELECT firm % 5 AS peers, year, SUM(revenue) AS total FROM r GROUP BY ALL)
SELECT a.firm, a.year, ROUND(-(a.cap / b.cap - 1), 6) AS restraint, ROUND((a.ni - c.ni) / NULLIF(a.cap - c.cap, 0), 5) AS added_return, ROUND(a.revenue / s.total, 6) AS share FROM r a LEFT JOIN r b ON b.firm = a.firm AND b.year = a.year - 1 LEFT JOIN r c ON c.firm = a.firm AND c.year = a.year - 3 JOIN s ON s.peers = a.firm % 5 AND s.year = a.year""")
def capital_growth(s, d):
    cap = F.col("total_debt") + F.col("total_equity")
    r = view(s, d, "stmts").where(cap > 0).select(F.col("entity").alias("firm"), F.col("fiscal_year").alias("year"), cap.alias("cap"), F.col("net_income").alias("ni"), "revenue")
    past = lambda n, p: r.select("firm", (F.col("year") + n).alias("year"), F.col("cap").alias(f"cap{p}"), F.col("ni").alias(f"ni{p}"))
    peers = r.groupBy((F.col("firm") % 5).alias("peers"), "year").agg(F.sum("revenue").alias("total"))
    j = r.join(past(1, 1), ["firm", "year"], "left").join(past(3, 3), ["firm", "year"], "left").withColumn("peers", F.col("firm") % 5).join(peers, ["peers", "year"])
    return j.select("firm", "year", F.round(-(C.ratio(F.col("cap"), F.col("cap1")) - 1), 6).alias("restraint"), F.round(C.ratio(F.col("ni") - F.col("ni3"), F.col("cap") - F.col("cap3")), 5).alias("added_return"), F.round(C.ratio(F.col("revenue"), F.col("total")), 6).alias("share"))


@register("ds07_samples", PR._COHORT + " SELECT state, COUNT(*) AS n, COUNT(CASE WHEN state = 'exit' THEN 0.0 ELSE held END) AS coded FROM z GROUP BY state")
def samples(s, d):
    """Exits coded as not held; gaps and low capital left out of the outcome."""
    z = PR._cohort(s, d).withColumn("coded", F.when(F.col("state") == "exit", 0.0).otherwise(F.col("held")))
    return z.groupBy("state").agg(F.count("*").alias("n"), F.count("coded").alias("coded"))


@register("ds11_measures", PR._COHORT + """, p AS (SELECT 'held' AS outcome, 'rank' AS pred, cell, year, held AS y, rank AS x FROM z UNION ALL SELECT 'beat', 'rank', cell, year, beat, rank FROM z UNION ALL SELECT 'held', 'size', cell, year, held, LN(revenue) FROM z),
e AS (SELECT outcome, pred, y - AVG(y) OVER w AS dy, x - AVG(x) OVER w AS dx FROM p WHERE y IS NOT NULL AND x IS NOT NULL WINDOW w AS (PARTITION BY outcome, pred, cell, year))
SELECT outcome, pred, COUNT(*) AS n, ROUND(SUM(dx * dy) / NULLIF(SUM(dx * dx), 0), 6) AS slope, SUM(dx * dy) / NULLIF(SUM(dx * dx), 0) > 0 AS positive FROM e GROUP BY ALL""")
def measures(s, d):
    """The matrix of predictors and outcomes as one job: tests are exploded, then one fixed-effect slope for each."""
    z = PR._cohort(s, d)
    tests = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("pred"), F.col(o).alias("y"), x.alias("x")) for o, p, x in (("held", "rank", F.col("rank")), ("beat", "rank", F.col("rank")), ("held", "size", F.ln("revenue")))]))
    rows = z.select("cell", "year", tests.alias("t")).select("cell", "year", "t.*").where("y is not null and x is not null")
    w = Window.partitionBy("outcome", "pred", "cell", "year")
    e = rows.select("outcome", "pred", (F.col("y") - F.avg("y").over(w)).alias("dy"), (F.col("x") - F.avg("x").over(w)).alias("dx"))
    slope = C.ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") * F.col("dx")))
    return e.groupBy("outcome", "pred").agg(F.count("*").alias("n"), F.round(slope, 6).alias("slope"), (slope > 0).alias("positive"))


@register("ds14_profile", PR._ROWS + """, q AS (SELECT year, roic, 2 * (RANK() OVER (PARTITION BY year ORDER BY roic) - 1) + COUNT(*) OVER (PARTITION BY year, roic) AS r, COUNT(*) OVER (PARTITION BY year) AS n FROM r), c AS (SELECT year, MIN(roic) FILTER (3 * r >= 2 * n) AS middle, MIN(roic) FILTER (3 * r >= 4 * n) AS top FROM q GROUP BY year),
l AS (SELECT firm, MAX(year) AS year, COUNT(*) AS years FROM r GROUP BY firm), m AS (SELECT MAX(year) AS newest FROM r)
SELECT l.firm, CASE WHEN l.years < 3 THEN 'short history' WHEN m.newest - l.year > 1 THEN 'stale' WHEN c.top IS NULL THEN 'no reference' END AS reason, CASE WHEN l.years >= 3 AND m.newest - l.year <= 1 THEN CASE WHEN r.roic >= c.top THEN 'top' WHEN r.roic >= c.middle THEN 'middle' ELSE 'bottom' END END AS third FROM l JOIN r ON r.firm = l.firm AND r.year = l.year JOIN c ON c.year = l.year, m""")
def profile(s, d):
    rows = PR._rows(s, d)
    last = rows.groupBy("firm").agg(F.max("year").alias("year"), F.count("*").alias("years"))
    newest = rows.agg(F.max("year").alias("newest"))
    j = last.join(rows.select("firm", "year", "roic"), ["firm", "year"]).join(D.thirds(rows, "roic", "year"), "year").join(F.broadcast(newest))  # one row
    reason = F.when(F.col("years") < 3, "short history").when(F.col("newest") - F.col("year") > 1, "stale").when(F.col("top").isNull(), "no reference")
    third = F.when(F.col("roic") >= F.col("top"), "top").when(F.col("roic") >= F.col("middle"), "middle").otherwise("bottom")
    return j.select("firm", reason.alias("reason"), F.when(reason.isNull(), third).alias("third"))


# ---------------------------------------------------------------- peers, cards, notes


@register("pf05_peer_table", PR._PEERS + " SELECT p.ticker, COUNT(*) AS peers, ROUND(MEDIAN(b.margin), 6) AS margin_median, ROUND(MEDIAN(LN(b.cap)), 6) AS size_median FROM p JOIN k b ON b.ticker = p.peer GROUP BY p.ticker")
def peer_table(s, d):
    m = PR._members(s, d).withColumn("size", F.ln("cap"))
    t = G.measure_rows(G.closest_in_size(m, 3), m, ["margin", "size"])
    pick = lambda n: F.round(F.max(F.when(F.col("measure") == n, F.col("median"))), 6).alias(f"{n}_median")
    return t.groupBy("ticker").agg(F.max("usable").alias("peers"), pick("margin"), pick("size"))


@register("sc24_guarded_calls", PF._CARDS + f""", q AS (SELECT ticker, ROUND(COALESCE(({PF._NUM}) / NULLIF({PF._DEN}, 0), 0), 1) AS composite, ROUND(({PF._DEN}) / ({PF._APPL}), 3) AS confidence,
  list_filter([CASE WHEN fcf < 0 AND NOT COALESCE(rc >= 0.15 AND rp >= 0.70, FALSE) AND bucket NOT IN ('reit', 'financials') THEN 'negative_fcf' END, CASE WHEN market_cap < 3e8 THEN 'below_min_mktcap' END,
    CASE WHEN dte > 5 AND dte <= 20 AND bucket NOT IN ('reit', 'financials') THEN 'over_leveraged' END], lambda x: x IS NOT NULL) AS gates,
  value >= 60 AND (COALESCE(quality < 40, FALSE) OR COALESCE(growth < 40, FALSE)) AS trap, sc >= 0.03 AS diluted, growth, quality,
  quality IS NULL OR growth IS NULL OR value IS NULL OR momentum IS NULL OR insider IS NULL OR (moat IS NULL AND bucket NOT IN ('reit', 'financials')) AS gaps FROM c),
s AS (SELECT *, CASE WHEN composite >= 55 THEN 'STRONG_BUY' WHEN composite >= 45 THEN 'BUY' WHEN composite >= 30 THEN 'HOLD' ELSE 'AVOID' END AS asked, CASE WHEN ticker % 3 = 0 THEN FALSE ELSE gaps END AS missing FROM q),
k AS (SELECT *, CASE WHEN list_contains(gates, 'negative_fcf') OR list_contains(gates, 'over_leveraged') THEN 3 WHEN len(gates) > 0 THEN 2 ELSE -1 END AS ceil_,
  CASE asked WHEN 'STRONG_BUY' THEN 0 WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 2 ELSE 3 END AS now_ FROM s),
v AS (SELECT *, ceil_ > now_ AS clamped, GREATEST(CASE WHEN ceil_ > now_ THEN 1 ELSE 0 END, CASE WHEN confidence < 0.45 THEN 2 WHEN confidence < 0.7 THEN 1 ELSE 0 END, CASE WHEN missing THEN 1 ELSE 0 END) AS cap FROM k),
w AS (SELECT *, CASE WHEN clamped THEN (['STRONG_BUY', 'BUY', 'HOLD', 'AVOID', 'STRONG_AVOID'])[ceil_ + 1] ELSE asked END AS stance FROM v),
x AS (SELECT *, confidence >= 0.7 AND CASE WHEN asked IN ('STRONG_BUY', 'BUY') THEN COALESCE(growth >= 50, FALSE) AND NOT COALESCE(trap, FALSE) WHEN asked = 'AVOID' THEN COALESCE(quality < 30, FALSE) OR COALESCE(diluted, FALSE) ELSE COALESCE(growth >= 50, FALSE) OR COALESCE(quality < 30, FALSE) END AS backed FROM w)
SELECT ticker, asked, stance, (['HIGH', 'MEDIUM', 'LOW'])[CASE WHEN cap = 0 AND NOT backed THEN 1 ELSE cap END + 1] AS conviction, clamped AS stance_clamped,
  CASE WHEN clamped THEN list_filter(gates, lambda g: CASE WHEN g IN ('negative_fcf', 'over_leveraged') THEN 3 ELSE 2 END = ceil_) END AS clamp_gates FROM x""")
def guarded(s, d):
    """Calls asked for by the composite, all at high conviction; sub-scores stand for the evidence."""
    cards = S.score(PF.metrics(s, d))
    c = F.col("composite")
    asked = F.when(c >= 55, "STRONG_BUY").when(c >= 45, "BUY").when(c >= 30, "HOLD").otherwise("AVOID")
    cards = cards.withColumn("asked", asked).withColumn("missing", F.when(F.col("ticker") % 3 != 0, _gap_names(lambda n: ~_inapplicable(n))))
    backed = S.corroborated(F.col("asked"), F.col("confidence"), F.col("flags"), F.col("growth") >= 50, F.col("quality") < 30, F.array_contains("flags", "dilution"))
    call = S.clamp_call(F.col("asked"), F.lit("HIGH"), F.col("gates"), F.col("confidence"), F.col("missing"), backed)
    return cards.withColumn("call", call).select("ticker", "asked", "call.stance", "call.conviction", "call.stance_clamped", "call.clamp_gates")


def _inapplicable(name: str):
    return F.array_contains("abstained", f"{name}:inapplicable")


def _gap_names(keep):
    """Sub-scores that are missing and satisfy a condition."""
    return F.filter(F.array(*[F.when(F.col(n).isNull() & keep(n), F.lit(n)) for n in S.WEIGHTS]), lambda x: x.isNotNull())


@register("sc21_coverage_gaps", PF._CARDS + " SELECT ticker, list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN moat IS NULL AND bucket NOT IN ('reit', 'financials') THEN 'moat' END, CASE WHEN growth IS NULL THEN 'growth' END, CASE WHEN momentum IS NULL THEN 'momentum' END, CASE WHEN value IS NULL THEN 'value' END, CASE WHEN insider IS NULL THEN 'insider' END], lambda x: x IS NOT NULL) AS gaps, list_filter([CASE WHEN moat IS NULL AND bucket IN ('reit', 'financials') THEN 'moat' END], lambda x: x IS NOT NULL) AS not_applicable FROM c")
def gaps(s, d):
    """Sub-scores that are missing, apart from those that do not apply to the sector."""
    return S.score(PF.metrics(s, d)).select("ticker", _gap_names(lambda n: ~_inapplicable(n)).alias("gaps"), _gap_names(_inapplicable).alias("not_applicable"))


@register("tx06b_story_clusters", """WITH g AS (SELECT user_id AS ticker, event_type, ts, event_id, CASE WHEN ts <= LAG(ts) OVER w + INTERVAL 4 DAY THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), s AS (SELECT *, SUM(b) OVER (PARTITION BY ticker, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS story FROM g)
SELECT ticker, event_type, CAST(story AS BIGINT) AS story, COUNT(*) AS n, ARG_MIN(event_id, (ts, event_id)) AS first_id FROM s GROUP BY ALL""")
def clusters(s, d):
    """Items with one key belong to a story while gaps stay inside four days; its first item represents it."""
    e = view(s, d, "news")
    w = Window.partitionBy("ticker", "event_type").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 4 DAY")
    g = e.withColumn("b", F.when(near, 0).otherwise(1)).withColumn("story", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("ticker", "event_type", "story").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@register("pit12_flat_metrics", PF._METRICS + " SELECT ticker, bucket, ROUND(fcf, 2) AS fcf, ROUND(market_cap, 0) AS market_cap, ROUND(net_margin, 6) AS net_margin, ROUND(debt_to_equity, 5) AS debt_to_equity, ROUND(gross_margin, 6) AS gross_margin, ROUND(gross_margin_stability, 6) AS gross_margin_stability, ROUND(roic, 6) AS roic, ROUND(revenue_cagr, 6) AS revenue_cagr, ROUND(fcf_cagr, 6) AS fcf_cagr, ROUND(share_count_cagr, 6) AS share_count_cagr, ROUND(price_vs_200dma, 6) AS price_vs_200dma, ROUND(max_drawdown, 6) AS max_drawdown FROM m")
def flat_metrics(s, d):
    """The wide derived projection: statements, prices and sector to one flat row per name."""
    m = PF.metrics(s, d).withColumn("bucket", S.bucket(F.col("sic")))
    return m.select("ticker", "bucket", _r("fcf", 2), _r("market_cap", 0), _r("net_margin"), _r("debt_to_equity", 5), *[_r(c) for c in ("gross_margin", "gross_margin_stability", "roic", "revenue_cagr", "fcf_cagr", "share_count_cagr", "price_vs_200dma", "max_drawdown")])


@register("pit06_panel_with_price", cte("facts", "prices") + """, g AS (SELECT CAST(x AS DATE) AS as_of FROM (VALUES ('1998-06-30'), ('2000-06-30'), ('2002-12-31')) v(x)), k AS (SELECT f.*, g.as_of FROM facts f JOIN g ON f.filed <= g.as_of AND f.fy_end <= g.as_of),
t AS (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, as_of, tag, fy_end ORDER BY filed DESC, pos) = 1), w AS (SELECT cik, as_of, fy_end, MAX(val) FILTER (tag = '1-URGENT') AS a, MAX(val) FILTER (tag = '2-HIGH') AS b FROM t GROUP BY ALL),
l AS (SELECT cik, as_of, ARG_MAX(a, fy_end) FILTER (a IS NOT NULL) AS a, MAX(fy_end) FILTER (a IS NOT NULL) AS ae, ARG_MAX(b, fy_end) FILTER (b IS NOT NULL) AS b, MAX(fy_end) FILTER (b IS NOT NULL) AS be FROM w GROUP BY ALL),
p AS (SELECT l.*, x.close FROM l ASOF LEFT JOIN prices x ON x.ticker = l.cik % 100 AND l.as_of >= x.d)
SELECT cik, as_of, close, ROUND(a / NULLIF(close, 0), 4) AS income_to_price, ROUND(CASE WHEN ae = be THEN (a - b) / NULLIF(close, 0) END, 4) AS free_to_price FROM p""")
def panel_with_price(s, d):
    """The latest of each series with the price known on the date; the difference only where both end together."""
    dates = s.createDataFrame([("1998-06-30",), ("2000-06-30",), ("2002-12-31",)], "x string").select(F.to_date("x").alias("as_of"))
    wide = T.panel(T.per_tag(T.known(view(s, d, "facts"), dates)), {"1-URGENT": "a", "2-HIGH": "b"})
    end = lambda c: F.when(F.col(c).isNotNull(), F.col("fy_end"))
    last = wide.groupBy("cik", "as_of").agg(*[x for c in ("a", "b") for x in (F.max_by(c, end(c)).alias(c), F.max(end(c)).alias(c + "e"))]).withColumn("ticker", F.col("cik") % 100)
    from stockloom.operators import prices as P

    seen = P.as_of(last.select("ticker", "as_of").distinct(), view(s, d, "prices"), "as_of").select("ticker", "as_of", "close")
    j = last.join(seen, ["ticker", "as_of"], "left")
    return j.select("cik", "as_of", "close", F.round(C.ratio(F.col("a"), F.col("close")), 4).alias("income_to_price"), F.round(F.when(F.col("ae") == F.col("be"), C.ratio(F.col("a") - F.col("b"), F.col("close"))), 4).alias("free_to_price"))
