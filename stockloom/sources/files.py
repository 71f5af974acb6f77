"""Readers and writers of landed files, with explicit schemas. Malformed rows give nulls or no row, never a failed job.

Every reader takes a path or glob that Spark can read and returns a flat DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHART = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<long>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<close: array<double>>>>>>>"
FACTS = "cik long, facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, filed: string, form: string>>>>>>"
HIT = "_id string, _source struct<adsh: string, ciks: array<string>, items: array<string>, file_date: string, file_type: string, sics: array<string>, display_names: array<string>>"


def _finite(c):
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def chart_prices(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ticker, d (UTC), close (adjusted), nominal. A row without a finite adjusted close is dropped; the nominal one may be missing.
    A file is one document, or with ``lines`` a pack of them, one a line: a large universe is not one file a ticker."""
    r = spark.read.schema(CHART).option("multiLine", not lines).json(path).where(F.size("chart.result") > 0).select(F.col("chart.result")[0].alias("r"))
    zipped = F.arrays_zip(F.col("r.timestamp").alias("ts"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("close"), F.get(F.col("r.indicators.quote"), F.lit(0))["close"].alias("nominal"))
    rows = r.select(F.col("r.meta.symbol").alias("ticker"), F.explode(zipped).alias("x")).select("ticker", F.to_date(F.timestamp_seconds("x.ts")).alias("d"), _finite(F.col("x.close")).alias("close"), _finite(F.col("x.nominal")).alias("nominal"))
    return rows.where("close is not null and d is not null")


def company_facts(spark: SparkSession, path: str, tags: list[str], forms: list[str], unit: str = "USD", relabel: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """cik, taxonomy, tag, start, end, val, filed, form, pos: listed tags and forms only; filers without any listed tag are gone.
    ``relabel`` names foreign forms as the domestic ones that they stand for; ``lines``: a file packs documents, one a line."""
    raw = spark.read.schema(FACTS).option("multiLine", not lines).json(path)
    by_tag = raw.select("cik", F.explode("facts").alias("taxonomy", "t")).select("cik", "taxonomy", F.explode("t").alias("tag", "u")).where(F.col("tag").isin(tags))
    rows = by_tag.select("cik", "taxonomy", "tag", F.posexplode(F.col("u.units")[unit]).alias("pos", "f")).withColumn("form", F.coalesce(*[F.when(F.col("f.form") == a, F.lit(b)) for a, b in (relabel or {}).items()], F.col("f.form"))).where(F.col("form").isin(forms))
    date = lambda c: F.try_to_date(c) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c))
    return rows.select("cik", "taxonomy", "tag", date(F.col("f.start")).alias("start"), date(F.col("f.end")).alias("end"), "f.val", date(F.col("f.filed")).alias("filed"), "form", "pos").where("end is not null and filed is not null and val is not null")


def insider_tables(spark: SparkSession, submissions: str, owners: str, trades: str) -> DataFrame:
    """Three tab-separated tables joined by accession: annual document type 4 only, the first owner, and a joint mark."""
    tsv = lambda p: spark.read.option("header", True).option("sep", "\t").csv(p)
    sub = tsv(submissions).where("DOCUMENT_TYPE = '4'").select("ACCESSION_NUMBER", F.col("ISSUERCIK").alias("cik"), F.upper("ISSUERTRADINGSYMBOL").alias("ticker"))
    own = tsv(owners).select("ACCESSION_NUMBER", F.monotonically_increasing_id().alias("pos"), F.col("RPTOWNERCIK").alias("owner"), F.split("RPTOWNER_RELATIONSHIP", ",").alias("roles"))
    first = own.groupBy("ACCESSION_NUMBER").agg(F.min_by(F.struct("owner", "roles"), "pos").alias("o"), (F.count("*") > 1).alias("joint"))
    day = F.to_date(F.try_to_timestamp(F.initcap(F.lower("TRANS_DATE")), F.lit("dd-MMM-yyyy")))
    number = lambda c: _finite(F.col(c).try_cast("double"))
    t = tsv(trades).select("ACCESSION_NUMBER", day.alias("d"), F.col("TRANS_CODE").alias("code"), number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price"))
    return t.join(sub, "ACCESSION_NUMBER").join(first, "ACCESSION_NUMBER").select(F.col("ACCESSION_NUMBER").alias("accession"), "cik", "ticker", "o.owner", "o.roles", "joint", "d", "code", "shares", "price", (F.col("shares") * F.col("price")).alias("value"))


def ownership_xml(spark: SparkSession, path: str) -> DataFrame:
    """Trades of ownership documents in XML; a malformed document gives no row."""
    schema = "issuer struct<issuerCik: string, issuerTradingSymbol: string>, reportingOwner struct<reportingOwnerId: struct<rptOwnerCik: string>>, nonDerivativeTable struct<nonDerivativeTransaction: array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: struct<value: double>, transactionPricePerShare: struct<value: double>>>>>"
    docs = spark.read.format("xml").option("rowTag", "ownershipDocument").schema(schema).load(path)
    return docs.select(F.col("issuer.issuerCik").alias("cik"), F.upper("issuer.issuerTradingSymbol").alias("ticker"), F.col("reportingOwner.reportingOwnerId.rptOwnerCik").alias("owner"), F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("t")).select(
        "cik", "ticker", "owner", F.to_date("t.transactionDate.value").alias("d"), F.col("t.transactionCoding.transactionCode").alias("code"), F.col("t.transactionAmounts.transactionShares.value").alias("shares"), F.col("t.transactionAmounts.transactionPricePerShare.value").alias("price"))


def holdings_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an information table: cusip, name, value, shares, kind, option."""
    schema = "nameOfIssuer string, cusip string, value double, shrsOrPrnAmt struct<sshPrnamt: double, sshPrnamtType: string>, putCall string"
    t = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", True).schema(schema).load(path)
    return t.select("cusip", F.col("nameOfIssuer").alias("name"), "value", F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.col("shrsOrPrnAmt.sshPrnamtType").alias("kind"), F.col("putCall").alias("option"))


def filing_pairs(filings: DataFrame, form: str) -> DataFrame:
    """fund, period, accession, prior_accession: filings (fund, accession, filed, form, period) of exactly this form, the last of each
    period, with the one of the fund's period before."""
    last = filings.where(F.col("form") == form).groupBy("fund", "period").agg(F.max(F.struct("filed", "accession"))["accession"].alias("accession"))
    return last.withColumn("prior_accession", F.lag("accession").over(Window.partitionBy("fund").orderBy("period")))


def industry_codes(spark: SparkSession, path: str) -> DataFrame:
    """cik (ten figures), sic of submissions documents; a code that is no number is NULL. The last of a filer's documents
    in order of code wins."""
    rows = spark.read.schema("cik string, sic string").json(path).where("cik is not null")
    return rows.groupBy(F.lpad("cik", 10, "0").alias("cik")).agg(F.max(F.col("sic").try_cast("int")).alias("sic"))


def pipe_fails(spark: SparkSession, path: str) -> DataFrame:
    """settled, cusip, symbol from pipe-separated text; headers, short and blank lines are skipped."""
    p = F.split("value", r"\|")
    return spark.read.text(path).where(F.size(p) >= 3).select(F.get(p, F.lit(0)).alias("settled"), F.get(p, F.lit(1)).alias("cusip"), F.get(p, F.lit(2)).alias("symbol")).where(F.col("settled").rlike(r"^\d{8}$"))


def short_interest(rows: DataFrame) -> DataFrame:
    """The newest settlement only, numbers or null, Y/N marks, symbols without separators; the last row of a symbol wins."""
    newest = rows.agg(F.max("settled").alias("settled"))
    key = F.regexp_replace(F.upper("symbol"), "[-.]", "")
    clean = rows.join(F.broadcast(newest), "settled").select(key.alias("symbol"), "pos", _finite(F.col("shares").try_cast("double")).alias("shares"), F.when(F.col("mark") == "Y", True).when(F.col("mark") == "N", False).alias("rising"), "settled")  # one row
    return clean.groupBy("symbol").agg(F.max_by(F.struct("shares", "rising", "settled"), "pos").alias("x")).select("symbol", "x.*")


def mentions(rows: DataFrame) -> DataFrame:
    """One row per symbol, most mentions first, the later row on ties; delta and rising against a day ago."""
    w = Window.partitionBy("symbol").orderBy(F.desc(F.coalesce("mentions", F.lit(0))), F.desc("pos"))
    one = rows.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one.withColumn("delta", F.when(F.col("day_ago") > 0, F.col("mentions") / F.col("day_ago") - 1)).withColumn("rising", F.col("mentions") > F.col("day_ago"))


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """accession, cik, items, filed, form, name of filing-search hits; junk is dropped."""
    s = spark.read.schema(HIT).json(path).where("_source.adsh is not null and size(_source.ciks) > 0")
    return s.select(F.col("_source.adsh").alias("accession"), F.lpad(F.col("_source.ciks")[0], 10, "0").alias("cik"), F.col("_source.items").alias("items"), F.to_date("_source.file_date").alias("filed"), F.col("_source.file_type").alias("form"), F.get(F.col("_source.display_names"), F.lit(0)).alias("name"))


def money(c):
    """Positive amount of a money string, else NULL."""
    v = F.regexp_replace(c, r"[$,\s]", "").try_cast("double")
    return F.when(v > 0, _finite(v))


def listed_universe(tables: list[DataFrame]) -> DataFrame:
    """Listings (symbol, cap, volume as text) of several exchanges; a later one overrides."""
    rows = None
    for i, t in enumerate(tables):
        x = t.select(F.upper("symbol").alias("symbol"), money(F.col("cap")).alias("cap"), money(F.col("volume")).alias("volume"), F.lit(i).alias("order"))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("symbol").agg(F.max_by(F.struct("cap", "volume"), "order").alias("x")).select("symbol", "x.*")


def directory(rows: DataFrame) -> DataFrame:
    """cik to ticker: the first seen, but a unit, warrant or preferred symbol gives way to its base if that is listed too."""
    g = rows.groupBy(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).agg(F.min_by(F.upper("ticker"), "pos").alias("first"), F.collect_set(F.upper("ticker")).alias("every"))  # one filer's symbols
    base = F.regexp_extract("first", r"^([A-Z]+?)(?:-[A-Z]+|[UWR])$", 1)
    return g.select("cik", F.when((base != "") & F.array_contains("every", base), base).otherwise(F.col("first")).alias("ticker"))


# ---------------------------------------------------------------- sinks


def write_cards(cards: DataFrame, root: str, decimals: int = 1) -> None:
    """Ranked cards as CSV (numbers rounded for display) and JSON."""
    flat = [F.bround(c, decimals).alias(c) if t == "double" else (F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c)) for c, t in cards.dtypes]
    cards.select(*flat).write.mode("overwrite").option("header", True).csv(f"{root}/cards.csv")
    cards.write.mode("overwrite").json(f"{root}/cards.json")


def stale_names(universe: DataFrame, known: DataFrame) -> DataFrame:
    """Names that the directory does not have; with an empty directory nothing can be told, so none."""
    any_ = known.agg((F.count("*") > 0).alias("any"))
    return universe.dropDuplicates(["ticker"]).join(known.select("ticker"), "ticker", "left_anti").join(F.broadcast(any_)).where("any").drop("any")  # one row


def fetch_status(rows: DataFrame) -> DataFrame:
    """Worst status of every source from its error texts: limit (402), throttled (429), error, ok."""
    text = F.coalesce("error", F.lit(""))
    rank = F.when(text.rlike(r"\b402\b"), 0).when(text.rlike(r"\b429\b"), 1).when(text != "", 2).otherwise(3)
    return rows.groupBy("source").agg(F.min(rank).alias("r")).select("source", F.element_at(F.array(F.lit("limit"), F.lit("throttled"), F.lit("error"), F.lit("ok")), F.col("r") + 1).alias("status"))


def join_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Yearly statements of one vendor joined by (ticker, date), the first row of a date on each side."""
    one = lambda df: df.groupBy("ticker", "date").agg(*[F.min_by(c, "pos").alias(c) for c in df.columns if c not in ("ticker", "date", "pos")])
    return one(income).join(one(balance), ["ticker", "date"], "left").join(one(cash), ["ticker", "date"], "left")


def complete_concept(rows: DataFrame, order: list[str]) -> DataFrame:
    """Per filer, the first concept in order (then lowest level, then position) that has a value for every period: all or nothing."""
    prio = F.coalesce(*[F.when(F.col("concept") == c, F.lit(i)) for i, c in enumerate(order)])
    periods = rows.groupBy("cik").agg(F.count_distinct("end").alias("periods"))
    series = rows.withColumn("prio", prio).where("prio is not null").groupBy("cik", "concept", "level", "pos", "prio").agg(F.count("val").alias("filled"))
    best = series.join(periods, "cik").where("filled = periods").groupBy("cik").agg(F.min(F.struct("prio", "level", "pos", "concept")).alias("b"))
    return rows.join(best, "cik").where((F.col("concept") == F.col("b.concept")) & (F.col("level") == F.col("b.level")) & (F.col("pos") == F.col("b.pos"))).select("cik", "end", "concept", "val")


def summed_concepts(rows: DataFrame, concepts: list[str]) -> DataFrame:
    """Sum of several concepts per period; a filer with a period that none covers abstains."""
    g = rows.groupBy("cik", "end").agg(F.sum(F.when(F.col("concept").isin(concepts), F.col("val"))).alias("val"))
    whole = g.groupBy("cik").agg(F.count_if(F.col("val").isNull()).alias("holes")).where("holes = 0")
    return g.join(whole.select("cik"), "cik", "left_semi")
