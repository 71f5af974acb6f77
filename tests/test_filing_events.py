"""Stakes, report pockets, earnings and text safety on literal rows."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom.operators import events as E
from stockloom.operators import predicates as Q


def test_stakes(spark):
    rows = [
        ("abc", 1, "Target Systems", "Elliott Management", "SC 13D", 1, None), ("ABC", 1, "Target Systems", "Other Fund LP", "SCHEDULE 13D", 2, 6.5), ("ABC", 1, "Target Systems", "Elliott Management", "SC 13D", 3, 7.0),
        ("DEF", 2, "Hawkeye Systems", "Hawkeye HoldCo LLC", "SC 13D", 4, None), ("GHI", 3, "Big Acquisition Corp. II", "Some One", "SC 13D", 5, None), ("JKL", 4, "Plain Co", "Some One", "SC 13D/A", 6, None),
        ("N/A", 5, "Plain Co", "Some One", "SC 13D", 7, None), ("MNO", 6, "Value Capital Partners", "Capital Value Management", "SC 13D", 8, None)]
    df = spark.createDataFrame(rows, "ticker string, cik int, subject string, activist string, form string, pos int, pct double")
    got = {r.ticker: (r.activists, r.marquee, round(r.strength, 6), r.pct) for r in E.stakes(df).collect()}
    assert got == {"ABC": (2, "Elliott", 0.95, 6.5), "MNO": (1, None, 0.7, None)}
    assert {r.ticker for r in E.stakes(df, drop_shells=False, drop_affiliates=False).collect()} == {"ABC", "DEF", "GHI", "MNO"}


def test_report_pocket_order(spark):
    d = date(2024, 1, 2)
    rows = [
        ("a1", "8-K/A", "1.01 3.03", None, "X", 1, d, 1), ("a1", "8-K", "Item 1.01, Item 3.03", None, "X", 1, d, 2), ("a1", "8-K", "4.02", None, "X", 1, d, 3), ("a2", "8-K", "3.03,1.01", None, "X", 1, d, 4), ("a3", "8-K", "1.01", None, "X", 1, d, 5),
        ("a4", "8-K", "1.01,3.03", ["6770"], "X", 2, d, 6), ("a5", "8-K", "1.01,3.03", None, "Blank Check Co", 2, d, 7), ("a6", "8-K", "1.01,3.03", None, None, 9, d, 8), ("", "8-K", "1.01,3.03", None, "X", 2, d, 9), ("a7", "8-K", "1.01,3.03", None, "X", 3, d, 10), ("a8", "8-K", "2.06 4.02", None, "SPAC", 4, d, 11)]
    df = spark.createDataFrame(rows, "adsh string, file_type string, items string, sics array<string>, name string, cik int, file_date date, pos int")
    directory = spark.createDataFrame([(1, "tk"), (2, "two"), (3, "ABCDW"), (4, "den")], "cik int, ticker string")
    denied = spark.createDataFrame([("DEN",)], "ticker string")
    assert [(r.ticker, r.adsh, r.matched) for r in E.pocket(df, directory, denied).collect()] == [("TK", "a1", ["1.01", "3.03"])]
    assert [(r.ticker, r.adsh, r["items"]) for r in E.vetoes(df, directory).collect()] == [("DEN", "a8", ["2.06", "4.02"])]


def test_earnings_summary(spark):
    today = date(2024, 5, 1)
    reports = spark.createDataFrame([("A", date(2023, 12, 31), 5.0), ("A", date(2024, 3, 31), -1.0), ("A", date(2023, 9, 30), None), ("B", date(2023, 12, 31), None)], "ticker string, period date, surprise double")
    calendar = spark.createDataFrame([("A", date(2024, 4, 25), 1.0), ("A", today, None), ("A", date(2024, 4, 1), None), ("C", date(2024, 8, 1), None)], "ticker string, day date, actual double")
    got = {r.ticker: (r.surprises, r.quarters, r.beats, r.last_surprise, r.next_day, r.last_report, r.estimated) for r in E.earnings_summary(reports, calendar, F.lit(today)).collect()}
    assert got["A"] == ([-1.0, 5.0], 2, 1, -1.0, today, date(2024, 4, 25), False)
    assert got["B"] == ([], None, None, None, None, date(2023, 12, 31), True) and got["C"][4:] == (date(2024, 8, 1), None, True)


@pytest.mark.parametrize(("raw", "want"), [
    ("AT&amp;T  up\n\t5%", "AT&T up 5%"), ("ﬁne ‮text​", "fine text"), ("a\x00b\x07", "ab"), (None, ""), ("x" * 40, "x" * 19 + "…"), ("café １２", "café 12"), ("word " * 10, "word word word word…")])
def test_safe_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(Q.safe_text(F.col("t"), 20).alias("x")).first().x == want


def test_urls_and_percentages(spark):
    urls = ["https://a.b/c", " HTTP://x ", "javascript:alert(1)", "http://a b", "http://a​", None, ""]
    assert [r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").select(Q.safe_url(F.col("u")).alias("u")).collect()] == ["https://a.b/c", "HTTP://x", "", "", "", "", ""]
    docs = ["<ns:percentOfClass> 7.5 %</x> PERCENT OF CLASS 99%", "PERCENT OF\n CLASS <b>represented</b> 5.1 % and PERCENT OF CLASS 9.9%", "<percentOfClass>0</percentOfClass> PERCENT OF CLASS 8%", "8% of nothing", None, "percent of class 250%"]
    assert [r.p for r in spark.createDataFrame([(x,) for x in docs], "d string").select(Q.stake_percent(F.col("d")).alias("p")).collect()] == [7.5, 9.9, None, None, None, None]
