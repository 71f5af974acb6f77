"""Readers on the given tables: each query writes a table in a landed form to the shared folder and reads it back by the reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.bindings import cte, table, view
from stockloom.catalog import register
from stockloom.operators import merge as M
from stockloom.operators import options as O
from stockloom.session import checkpoint_dir
from stockloom.sources import files, partials, store


def _place(s) -> str:
    return f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"


@register("src01_chart_prices", cte("prices") + " SELECT 'T' || ticker AS ticker, d, close, CASE WHEN DAY(d) % 5 <> 0 THEN close * 2 END AS nominal FROM prices WHERE DAY(d) % 7 <> 0")
def chart(s, d):
    """One chart document for each ticker, packed one a line, with holes in both price series."""
    p = view(s, d, "prices").select("ticker", F.unix_timestamp(F.col("d").cast("timestamp")).alias("t"), F.when(F.dayofmonth("d") % 7 != 0, F.col("close")).alias("c"), F.when(F.dayofmonth("d") % 5 != 0, F.col("close") * 2).alias("n"))
    days = p.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("t", "c", "n"))).alias("x"))  # one ticker's history is one document
    part = lambda k: F.transform("x", lambda v: v[k])
    result = F.struct(F.struct(F.concat(F.lit("T"), F.col("ticker")).alias("symbol")).alias("meta"), part("t").alias("timestamp"), F.struct(F.array(F.struct(part("c").alias("adjclose"))).alias("adjclose"), F.array(F.struct(part("n").alias("close"))).alias("quote")).alias("indicators"))
    place = _place(s)
    days.select(F.struct(F.array(result).alias("result")).alias("chart")).write.option("ignoreNullFields", False).json(place)
    return files.chart_prices(s, place, lines=True)


@register("src03_company_facts", cte("facts") + " SELECT cik, tag, fy_end, filed, val, CASE WHEN pos % 3 = 0 THEN '10-K' ELSE '10-K/A' END AS form FROM facts WHERE tag IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND pos % 4 <> 1")
def facts(s, d):
    """Facts of each filer as one document, packed one a line: tags to units to rows; foreign annual forms count as the domestic ones."""
    form = F.when(F.col("pos") % 4 == 1, "8-K").when(F.col("pos") % 3 == 0, F.when(F.col("pos") % 2 == 0, "20-F").otherwise("10-K")).otherwise(F.when(F.col("pos") % 2 == 0, "20-F/A").otherwise("10-K/A"))
    x = view(s, d, "facts").select("cik", "tag", F.struct(F.col("fy_end").cast("string").alias("start"), F.col("fy_end").cast("string").alias("end"), F.col("val").cast("double").alias("val"), F.col("filed").cast("string").alias("filed"), form.alias("form")).alias("f"))
    tags = x.groupBy("cik", "tag").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list("f")).alias("units")).alias("u"))
    docs = tags.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", "u"))).alias("m")).select("cik", F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))
    place = _place(s)
    docs.write.json(place)
    got = files.company_facts(s, place, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["10-K", "10-K/A"], relabel={"20-F": "10-K", "20-F/A": "10-K/A"}, lines=True)
    return got.select("cik", "tag", F.col("end").alias("fy_end"), "filed", "val", "form")


_SEC = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st, o_totalprice AS p FROM orders)"


@register("src04_insider_tables", _SEC + " SELECT 'a' || k AS accession, CAST(c % 50 AS VARCHAR) AS cik, 'TK' || c % 50 AS ticker, CAST(c AS VARCHAR) AS owner, k % 3 = 0 AS joint, d, CASE st WHEN 'P' THEN 'P' ELSE 'S' END AS code, CAST(k % 90 AS DOUBLE) AS shares, ROUND((k % 90) * p, 2) AS value FROM o WHERE k % 5 <> 0")
def insider_tables(s, d):
    """Submissions, owners (a second one every third time) and trades as tab-separated tables."""
    o = table(s, d, "orders").withColumn("a", F.concat(F.lit("a"), F.col("o_orderkey")))
    places = [_place(s) for _ in range(3)]
    tsv = lambda df, at: df.write.option("header", True).option("sep", "\t").csv(at)
    tsv(o.select(F.col("a").alias("ACCESSION_NUMBER"), F.when(F.col("o_orderkey") % 5 == 0, "4/A").otherwise("4").alias("DOCUMENT_TYPE"), (F.col("o_custkey") % 50).alias("ISSUERCIK"), F.concat(F.lit("tk"), F.col("o_custkey") % 50).alias("ISSUERTRADINGSYMBOL")), places[0])
    owners = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("o_custkey").alias("c")), F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit(1).alias("i"), (F.col("o_custkey") + 1).alias("c")))), lambda x: x.isNotNull())
    flat = o.select("a", F.explode(owners).alias("w")).select("a", "w.*").repartition("a").sortWithinPartitions("a", "i")
    tsv(flat.select(F.col("a").alias("ACCESSION_NUMBER"), F.col("c").alias("RPTOWNERCIK"), F.lit("Director,Officer").alias("RPTOWNER_RELATIONSHIP")), places[1])
    tsv(o.select(F.col("a").alias("ACCESSION_NUMBER"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("TRANS_DATE"), F.when(F.col("o_orderstatus") == "P", "P").otherwise("S").alias("TRANS_CODE"), (F.col("o_orderkey") % 90).alias("TRANS_SHARES"), F.col("o_totalprice").alias("TRANS_PRICEPERSHARE")), places[2])
    return files.insider_tables(s, *places).select("accession", "cik", "ticker", "owner", "joint", "d", "code", "shares", F.round("value", 2).alias("value"))


@register("src05_ownership_xml", _SEC + " SELECT CAST(c % 50 AS VARCHAR) AS cik, 'TK' || c % 50 AS ticker, CAST(c AS VARCHAR) AS owner, d, CASE st WHEN 'P' THEN 'P' ELSE 'S' END AS code, CAST(k % 90 AS DOUBLE) AS shares, p AS price FROM o")
def ownership(s, d):
    o = table(s, d, "orders")
    value = lambda c: F.struct(c.alias("value"))
    trade = F.struct(value(F.to_date("o_orderdate").cast("string")).alias("transactionDate"), F.struct(F.when(F.col("o_orderstatus") == "P", "P").otherwise("S").alias("transactionCode")).alias("transactionCoding"),
                     F.struct(value((F.col("o_orderkey") % 90).cast("double")).alias("transactionShares"), value(F.col("o_totalprice")).alias("transactionPricePerShare")).alias("transactionAmounts"))
    docs = o.select(F.struct((F.col("o_custkey") % 50).cast("string").alias("issuerCik"), F.concat(F.lit("tk"), F.col("o_custkey") % 50).alias("issuerTradingSymbol")).alias("issuer"), F.struct(F.struct(F.col("o_custkey").cast("string").alias("rptOwnerCik")).alias("reportingOwnerId")).alias("reportingOwner"),
                    F.struct(F.array(trade).alias("nonDerivativeTransaction")).alias("nonDerivativeTable"))
    place = _place(s)
    docs.write.format("xml").option("rootTag", "documents").option("rowTag", "ownershipDocument").save(place)
    return files.ownership_xml(s, place)


@register("src06_holdings_xml", cte("book") + " SELECT 'C' || cusip AS cusip, 'FUND ' || fund AS name, value, shares, CASE WHEN cusip % 7 = 0 THEN 'PRN' ELSE 'SH' END AS kind, CASE WHEN cusip % 11 = 0 THEN 'Put' END AS option FROM book")
def holdings(s, d):
    b = view(s, d, "book")
    rows = b.select(F.concat(F.lit("FUND "), F.col("fund")).alias("nameOfIssuer"), F.concat(F.lit("C"), F.col("cusip")).alias("cusip"), "value", F.struct(F.col("shares").cast("double").alias("sshPrnamt"), F.when(F.col("cusip") % 7 == 0, "PRN").otherwise("SH").alias("sshPrnamtType")).alias("shrsOrPrnAmt"), F.when(F.col("cusip") % 11 == 0, "Put").alias("putCall"))
    place = _place(s)
    rows.write.format("xml").option("rootTag", "informationTable").option("rowTag", "infoTable").save(place)
    return files.holdings_xml(s, place)


@register("src06b_filing_pairs", _SEC + """, f AS (SELECT c % 40 AS fund, k AS accession, d AS filed, CASE WHEN k % 4 = 0 THEN '13F-HR/A' WHEN k % 9 = 0 THEN '13F-NT' ELSE '13F-HR' END AS form, CAST(date_trunc('quarter', d) AS DATE) AS period FROM o),
h AS (SELECT fund, period, ARG_MAX(accession, (filed, accession)) AS accession, ARG_MAX(filed, (filed, accession)) AS filed FROM f WHERE form = '13F-HR' GROUP BY fund, period)
SELECT fund, period, accession, LAG(accession) OVER (PARTITION BY fund ORDER BY period) AS prior_accession FROM h""")
def filing_pairs(s, d):
    """Each fund's exact original filings, the last of a period, beside the one of the period before."""
    o = table(s, d, "orders")
    f = o.select((F.col("o_custkey") % 40).alias("fund"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"), F.when(F.col("o_orderkey") % 4 == 0, "13F-HR/A").when(F.col("o_orderkey") % 9 == 0, "13F-NT").otherwise("13F-HR").alias("form"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"))
    return files.filing_pairs(f, "13F-HR")


@register("src07_pipe_fails", _SEC + " SELECT strftime(d, '%Y%m%d') AS settled, 'C' || c AS cusip, 'S' || k % 100 AS symbol FROM o")
def fails(s, d):
    o = table(s, d, "orders")
    line = F.concat_ws("|", F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("C"), F.col("o_custkey")), F.concat(F.lit("S"), F.col("o_orderkey") % 100), F.lit("7"))
    noise = o.limit(0).select(F.lit("").alias("value")).union(s.sql("SELECT 'SETTLEMENT DATE|CUSIP|SYMBOL' AS value UNION ALL SELECT '' UNION ALL SELECT 'Trailer record count 2'"))
    place = _place(s)
    o.select(line.alias("value")).union(noise).write.text(place)
    return files.pipe_fails(s, place)


@register("src10_listed_universe", "WITH t AS (SELECT 0 AS o, 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_acctbal > 0 THEN c_acctbal END AS cap FROM customer UNION ALL SELECT 1, 'S' || s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END FROM supplier) SELECT symbol, ARG_MAX(CAST(COALESCE(cap, -1) AS DOUBLE), o) AS cap FROM t GROUP BY symbol")
def universe(s, d):
    text = lambda c: F.concat(F.lit("$ "), F.format_number(c, 2))
    first = table(s, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey")).alias("symbol"), F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(text("c_acctbal")).alias("cap"), F.lit("1").alias("volume"))
    second = table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), text("s_acctbal").alias("cap"), F.lit("1").alias("volume"))
    return files.listed_universe([first, second]).select("symbol", F.coalesce("cap", F.lit(-1.0)).alias("cap"))


@register("src11_search_hits", _SEC + " SELECT 'a' || k AS accession, lpad(CAST(c AS VARCHAR), 10, '0') AS cik, ['1.01', CAST(k % 9 AS VARCHAR) || '.02'] AS items, d AS filed, '8-K' AS form, 'NAME ' || c % 20 AS name FROM o WHERE k % 6 <> 0")
def hits(s, d):
    """Search hits as JSON lines; those without an accession or a filer are junk."""
    o = table(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    source = F.struct(F.when(k % 12 != 0, F.concat(F.lit("a"), k)).alias("adsh"), F.when(k % 6 != 0, F.array(c.cast("string"))).otherwise(F.array().cast("array<string>")).alias("ciks"), F.array(F.lit("1.01"), F.concat(k % 9, F.lit(".02"))).alias("items"),
                      F.to_date("o_orderdate").cast("string").alias("file_date"), F.lit("8-K").alias("file_type"), F.array(F.concat(F.lit("NAME "), c % 20)).alias("display_names"))
    place = _place(s)
    o.select(k.cast("string").alias("_id"), source.alias("_source")).write.json(place)
    return files.search_hits(s, place)


@register("src13_snapshot_store", """WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, ROUND(SUM(value) * 2, 4) AS v, BOOL_OR(event_type = 'purchase') AS again FROM events GROUP BY ALL), x AS (SELECT ticker, day, CASE WHEN again THEN v ELSE -1 END AS v FROM e)
SELECT ticker, COUNT(*) AS days, COUNT(*) FILTER (v = -1) AS first_saved, ARG_MAX(v, day) AS v, MAX(day) AS day FROM x GROUP BY ticker""")
def snapshot_store(s, d):
    """Every name and day saved once; then those with a purchase are saved again with other values. The others of the same days
    must stand as they were; the newest record of each name is read, and how many of its days hold the first values."""
    e = table(s, d, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day"))
    rows = e.agg(F.round(F.sum("value") * 2, 4).alias("v"), F.bool_or(F.col("event_type") == "purchase").alias("again"))
    place = _place(s)
    store.save_snapshots(rows.withColumn("v", F.lit(-1.0)).drop("again"), place)
    store.save_snapshots(rows.where("again").drop("again"), place)
    days = store.snapshots(s, place).groupBy("ticker").agg(F.count("*").alias("days"), F.count_if(F.col("v") == -1).alias("first_saved"))
    return store.latest_snapshots(s, place).join(days, "ticker").select("ticker", "days", "first_saved", "v", "day")


@register("src14_card_sinks", "SELECT s_suppkey AS ticker, round_even(s_acctbal, 1) AS shown, s_acctbal AS stored, 'a;b' AS gates FROM supplier")
def sinks(s, d):
    """Cards written as CSV (rounded for display, lists joined) and JSON, both read back."""
    cards = table(s, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").cast("double").alias("x"), F.array(F.lit("a"), F.lit("b")).alias("gates"))
    place = _place(s)
    files.write_cards(cards, place)
    shown = s.read.option("header", True).schema("ticker long, x double, gates string").csv(f"{place}/cards.csv")
    stored = s.read.schema("ticker long, x double").json(f"{place}/cards.json").withColumnRenamed("x", "stored")
    return shown.join(stored, "ticker").select("ticker", F.col("x").alias("shown"), "stored", "gates")


# ---------------------------------------------------------------- options and proxy tables

_CHAIN = """c AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) - 20 + CAST(l_linenumber * 9 AS INT) AS expiry, CAST(l_shipdate AS DATE) - 20 AS day, CASE WHEN l_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, l_partkey % 37 + 10.0 AS strike, l_quantity AS bid,
  l_quantity + (l_orderkey % 11 - 1) / 2.0 AS ask, (l_partkey % 100) / 100.0 AS delta, 0.2 + l_discount AS iv, l_extendedprice AS spot FROM lineitem WHERE l_returnflag = 'R')"""


def _chain(s, d):
    li = table(s, d, "lineitem").where("l_returnflag = 'R'")
    day = F.date_sub(F.to_date("l_shipdate"), 20)
    return li.select(
        F.col("l_suppkey").alias("ticker"), F.date_add(day, (F.col("l_linenumber") * 9).cast("int")).alias("expiry"), day.alias("day"), F.when(F.col("l_orderkey") % 2 == 0, "call").otherwise("put").alias("side"), (F.col("l_partkey") % 37 + 10.0).alias("strike"),
        F.col("l_quantity").alias("bid"), (F.col("l_quantity") + (F.col("l_orderkey") % 11 - 1) / 2.0).alias("ask"), ((F.col("l_partkey") % 100) / 100.0).alias("delta"), (0.2 + F.col("l_discount")).alias("iv"), F.col("l_extendedprice").alias("spot"))


@register("ev19_option_surface", "WITH " + _CHAIN + """, q AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) AS width, expiry - day AS dte FROM c WHERE bid > 0 AND ask >= bid AND expiry > day),
a AS (SELECT ticker, expiry, side, COUNT(*) AS n, MIN(abs(delta - 0.5)) AS gap FROM q WHERE abs(delta - 0.5) <= 0.15 GROUP BY ALL)
SELECT ticker, expiry, side, n, ROUND(gap, 6) AS gap FROM a""")
def surface(s, d):
    """Two-sided live quotes near the money: how many, and how near the nearest is."""
    near = O.quotes(_chain(s, d)).where(F.abs(F.col("delta") - 0.5) <= 0.15)
    counted = near.groupBy("ticker", "expiry", "side").agg(F.count("*").alias("n"))
    best = O.at_delta(O.quotes(_chain(s, d)).withColumn("iv", F.abs(F.col("delta") - 0.5)), 0.5, 0.15).select("ticker", "expiry", "side", F.round("iv", 6).alias("gap"))
    return counted.join(best, ["ticker", "expiry", "side"])


@register("ev20_earnings_expiry", "WITH " + _CHAIN + """, e AS (SELECT DISTINCT ticker, expiry, CAST(expiry - DATE '1995-01-01' AS INT) AS dte FROM c), n AS (SELECT s_suppkey AS ticker, 300 + s_nationkey * 20 AS days FROM supplier)
SELECT ticker, ARG_MIN(expiry, dte) AS expiry, MIN(dte) AS dte FROM e JOIN n USING (ticker) WHERE dte BETWEEN days + 1 AND days + 20 GROUP BY ticker""")
def expiry(s, d):
    e = _chain(s, d).select("ticker", "expiry", F.datediff("expiry", F.lit("1995-01-01").cast("date")).alias("dte")).distinct()
    return O.earnings_expiry(e, table(s, d, "supplier").select(F.col("s_suppkey").alias("ticker"), (300 + F.col("s_nationkey") * 20).alias("days")))


@register("ev21_pay_direction", cte("stmts") + """, p AS (SELECT entity AS ticker, fiscal_year AS year, revenue AS pay, CASE WHEN fiscal_year % 4 <> 0 THEN net_income END AS ret FROM stmts), g AS (SELECT ticker, COUNT(*) AS years, ARG_MAX(pay, year) - ARG_MIN(pay, year) AS pc, ARG_MAX(ret, year) - ARG_MIN(ret, year) AS rc FROM p WHERE ret IS NOT NULL GROUP BY ticker)
SELECT ticker, years, ROUND(pc, 1) AS pay_change, ROUND(rc, 1) AS return_change, CASE WHEN years >= 2 THEN sign(pc) = sign(rc) END AS aligned FROM g""")
def pay(s, d):
    rows = view(s, d, "stmts").select(F.col("entity").alias("ticker"), F.col("fiscal_year").alias("year"), F.col("revenue").alias("pay"), F.when(F.col("fiscal_year") % 4 != 0, F.col("net_income")).alias("total_return"))
    return O.pay_direction(rows).select("ticker", "years", F.round("pay_change", 1).alias("pay_change"), F.round("return_change", 1).alias("return_change"), "aligned")


@register("ev21b_concentrated_holders", "WITH h AS (SELECT o_custkey % 60 AS ticker, 'H' || o_orderkey AS name, ROUND(o_totalprice / 30000, 3) AS pct FROM orders) SELECT ticker, COUNT(*) AS holders, ROUND(SUM(pct), 3) AS total, ARG_MAX(name, (pct, name)) AS largest, SUM(pct) >= 50 AS controlled FROM h WHERE pct >= 5 GROUP BY ticker")
def concentrated(s, d):
    h = table(s, d, "orders").select((F.col("o_custkey") % 60).alias("ticker"), F.concat(F.lit("H"), F.col("o_orderkey")).alias("name"), F.round(F.col("o_totalprice") / 30000, 3).alias("percent"))
    return O.concentrated(h).select("ticker", "holders", F.round("total", 3).alias("total"), "largest", "controlled")


@register("src16_industry_codes", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_nationkey % 5 <> 4 THEN CAST(3500 + s_nationkey AS INT) END AS sic FROM supplier")
def industry(s, d):
    """Filer to industry code: submissions documents, each with its code as text; one that is no number gives none."""
    code = F.when(F.col("s_nationkey") % 5 != 4, (3500 + F.col("s_nationkey")).cast("string")).otherwise("n/a")
    place = _place(s)
    table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("cik"), code.alias("sic"), F.lit("x").alias("name")).write.json(place)
    return files.industry_codes(s, place)


@register("ud02b_data_source", """WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS price, CAST(s_nationkey AS BIGINT) AS staff FROM supplier), b AS (SELECT c_custkey AS k, c_acctbal AS price, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS sector FROM customer)
SELECT 'T' || COALESCE(a.k, b.k) AS ticker, COALESCE(a.price, b.price) AS price, a.staff, b.sector,
  list_sort(list_distinct(list_filter([CASE WHEN a.price IS NOT NULL THEN 'vendor' WHEN b.price IS NOT NULL THEN 'filings' END, CASE WHEN a.staff IS NOT NULL THEN 'vendor' END, CASE WHEN b.sector IS NOT NULL THEN 'filings' END], lambda x: x IS NOT NULL))) AS sources
FROM a FULL JOIN b ON a.k = b.k""")
def data_source(s, d):
    """Suppliers and customers land as the JSON lines of two sources, are read by the library's data source, and merge field by field."""
    place, fields = _place(s), "price double, staff bigint, sector string"
    t = lambda k: F.concat(F.lit("t"), F.col(k)).alias("ticker")
    table(s, d, "supplier").select(t("s_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")).alias("price"), F.col("s_nationkey").alias("staff")).write.json(f"{place}/vendor")
    table(s, d, "customer").select(t("c_custkey"), F.col("c_acctbal").cast("double").alias("price"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("sector")).write.json(f"{place}/filings")
    rows = partials.partial_records(s, f"{place}/vendor", "vendor", fields).unionByName(partials.partial_records(s, f"{place}/filings", "filings", fields))
    return M.merge_fields(M.ranked_sources(rows, ["vendor", "filings"]), "ticker", ["price", "staff", "sector"])
