"""File readers on small files, the snapshot store, and streams drained with availableNow against their batch twins."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from stockloom.sources import files
from stockloom.streaming import operators as O


def put(path, body):
    path.write_text(body)
    return str(path)


def test_chart_prices(spark, tmp_path):
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [0, 86400, 172800], "indicators": {"adjclose": [{"adjclose": [1.0, None, 3.0]}], "quote": [{"close": [1.5, 2.5, None]}]}}]}}
    put(tmp_path / "a.json", json.dumps(chart))
    put(tmp_path / "bad.json", json.dumps({"chart": {"result": None, "error": "404"}}))
    got = files.chart_prices(spark, f"{tmp_path}/*.json").orderBy("d").collect()
    assert [tuple(r) for r in got] == [("A", date(1970, 1, 1), 1.0, 1.5), ("A", date(1970, 1, 3), 3.0, None)]


def test_company_facts(spark, tmp_path):
    row = lambda **k: {"start": "2019-01-01", "end": "2019-12-31", "val": 5.0, "filed": "2020-03-01", "form": "10-K"} | k
    put(tmp_path / "f.json", json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [row(), row(form="8-K"), row(end="nonsense"), row(val=6.0)]}}, "Other": {"units": {"USD": [row()]}}}}}))
    got = files.company_facts(spark, str(tmp_path / "f.json"), ["Revenues"], ["10-K"]).orderBy("pos").collect()
    assert [(r.cik, r.tag, r.val, r.pos) for r in got] == [(7, "Revenues", 5.0, 0), (7, "Revenues", 6.0, 3)]


def test_insider_tables(spark, tmp_path):
    s = put(tmp_path / "s.tsv", "ACCESSION_NUMBER\tDOCUMENT_TYPE\tISSUERCIK\tISSUERTRADINGSYMBOL\na1\t4\t9\tabc\na2\t4/A\t9\tabc\n")
    o = put(tmp_path / "o.tsv", "ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNER_RELATIONSHIP\na1\t11\tDirector,Officer\na1\t12\tOfficer\n")
    t = put(tmp_path / "t.tsv", "ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\na1\t05-MAR-2025\tP\t10\t2.5\na1\tbad\tS\tx\t1\na2\t05-MAR-2025\tP\t1\t1\n")
    got = sorted(files.insider_tables(spark, s, o, t).collect(), key=lambda r: r.code)
    assert (got[0].ticker, got[0].owner, got[0].joint, got[0].d, got[0].value) == ("ABC", "11", True, date(2025, 3, 5), 25.0)
    assert got[1].d is None and got[1].shares is None and len(got) == 2


def test_xml_readers(spark, tmp_path):
    doc = "<ownershipDocument><issuer><issuerCik>9</issuerCik><issuerTradingSymbol>abc</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>11</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2025-03-05</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    put(tmp_path / "o.xml", doc)
    got = files.ownership_xml(spark, str(tmp_path / "o.xml")).collect()
    assert [(r.ticker, r.owner, r.code, r.shares * r.price) for r in got] == [("ABC", "11", "P", 25.0)]
    put(tmp_path / "i.xml", '<n:informationTable xmlns:n="u"><n:infoTable><n:nameOfIssuer>X</n:nameOfIssuer><n:cusip>1</n:cusip><n:value>5</n:value><n:shrsOrPrnAmt><n:sshPrnamt>2</n:sshPrnamt><n:sshPrnamtType>SH</n:sshPrnamtType></n:shrsOrPrnAmt></n:infoTable></n:informationTable>')
    assert [(r.cusip, r.value, r.shares, r.kind, r.option) for r in files.holdings_xml(spark, str(tmp_path / "i.xml")).collect()] == [("1", 5.0, 2.0, "SH", None)]


def test_text_feeds(spark, tmp_path):
    p = put(tmp_path / "f.txt", "SETTLEMENT DATE|CUSIP|SYMBOL|QTY\n20250102|123|ABC|5\nshort|line\n\n")
    assert [tuple(r) for r in files.pipe_fails(spark, p).collect()] == [("20250102", "123", "ABC")]
    si = spark.createDataFrame([("BRK.B", 0, "5", "Y", "2025-01-15"), ("BRK-B", 1, "6", "N", "2025-01-15"), ("A", 2, "x", "?", "2025-01-15"), ("A", 3, "9", "Y", "2024-12-31")], "symbol string, pos int, shares string, mark string, settled string")
    assert {r.symbol: (r.shares, r.rising) for r in files.short_interest(si).collect()} == {"BRKB": (6.0, False), "A": (None, None)}
    m = spark.createDataFrame([("a", 5, 4, 0), ("A", 5, 10, 1), ("A", None, 1, 2)], "symbol string, mentions int, day_ago int, pos int")
    got = files.mentions(m).collect()
    assert [(r.symbol, r.pos, r.delta, r.rising) for r in got] == [("A", 1, -0.5, False)]
    u = spark.createDataFrame([("a", "$1,000", "0")], "symbol string, cap string, volume string")
    assert [tuple(r) for r in files.listed_universe([u, u.withColumn("cap", F.lit("n/a"))]).collect()] == [("A", None, None)]
    d = spark.createDataFrame([(1, "abc-un", 0), (1, "abc", 1), (2, "xyzw", 2)], "cik int, ticker string, pos int")
    assert {r.cik: r.ticker for r in files.directory(d).collect()} == {"0000000001": "ABC", "0000000002": "XYZW"}
    f = spark.createDataFrame([("s", "http 402"), ("s", None), ("t", "4021"), ("u", None)], "source string, error string")
    assert {r.source: r.status for r in files.fetch_status(f).collect()} == {"s": "limit", "t": "error", "u": "ok"}
    empty = spark.createDataFrame([], "ticker string")
    names = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert files.stale_names(names, empty).count() == 0 and [r.ticker for r in files.stale_names(names, names.where("ticker = 'A'")).collect()] == ["B"]


def test_cards(spark, tmp_path):
    files.write_cards(spark.createDataFrame([("A", 1.25, ["x", "y"])], "ticker string, composite double, gates array<string>"), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "cards.csv")).first().composite == "1.2"


def test_concepts(spark):
    rows = [(1, 2020, "a", 1, 0, 5.0), (1, 2021, "a", 1, 0, None), (1, 2020, "b", 1, 1, 6.0), (1, 2021, "b", 1, 1, 7.0)]
    df = spark.createDataFrame(rows, "cik int, end int, concept string, level int, pos int, val double")
    assert sorted((r.end, r.concept, r.val) for r in files.complete_concept(df, ["a", "b"]).collect()) == [(2020, "b", 6.0), (2021, "b", 7.0)]
    assert sorted(r.val for r in files.summed_concepts(df, ["a", "b"]).collect()) == [7.0, 11.0] and files.summed_concepts(df, ["a"]).count() == 0


def test_streams_match_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 3, i // 2, start + timedelta(hours=7 * i), "click", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, O.NEWS)
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    closing = spark.createDataFrame([(99, 10_000, start + timedelta(days=90), "end", 0.0)], O.NEWS)  # moves the watermark past all
    stream = lambda: spark.readStream.schema(O.NEWS).option("maxFilesPerTrigger", 1).parquet(src)
    closing.coalesce(1).write.mode("append").parquet(src)
    for k, f in enumerate((O.daily_counts, O.one_a_day, lambda e: O.stories(e, "8 hours"))):
        got = O.run_once(f(stream()), str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}")).where("ticker <> 99")
        assert sorted(map(str, got.collect())) == sorted(map(str, f(events).collect()))
    once = O.run_once(O.deduplicated(stream(), ["event_id"]), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert once.where("ticker <> 99").count() == 20
    days = str(tmp_path / "days")
    O.upsert_days(events.sparkSession.readStream.schema(O.NEWS).parquet(src).withColumn("day", F.to_date("ts")), days, str(tmp_path / "uc"))
    assert O.newest_days(spark, days, ["ticker", "event_id", "ts"]).count() == 41


def test_packed_documents_are_read_whole(spark, tmp_path):
    fact = lambda c: {"cik": c, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2019-01-01", "end": "2019-12-31", "val": 5.0, "filed": "2020-03-01", "form": "10-K"}]}}}}}
    chart = lambda t: {"chart": {"result": [{"meta": {"symbol": t}, "timestamp": [0], "indicators": {"adjclose": [{"adjclose": [1.0]}], "quote": [{"close": [1.5]}]}}]}}
    facts = put(tmp_path / "f.json", "\n".join(json.dumps(fact(c)) for c in (7, 8)) + "\nbroken\n")
    charts = put(tmp_path / "c.json", "\n".join(json.dumps(chart(t)) for t in "AB"))
    assert sorted(r.cik for r in files.company_facts(spark, facts, ["Revenues"], ["10-K"], lines=True).collect()) == [7, 8]
    assert sorted(r.ticker for r in files.chart_prices(spark, charts, lines=True).collect()) == ["A", "B"]


def test_documents_do_not_land_one_a_file(spark):
    from pathlib import Path

    from stockloom import catalog

    base = Path(spark.conf.get("spark.checkpoint.dir"))
    for name in ("src01_chart_prices", "src03_company_facts"):
        before = set(base.glob("landed-*"))
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert len([f for p in set(base.glob("landed-*")) - before for f in p.rglob("part-*")]) <= 8
