"""Literal cases of the rules that need more than one table row: regimes, surprises, guards, tiers, sessions, gates, controls."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom.operators import backtest, events, fundamentals, news, predicates, prices, scoring, text


@pytest.mark.parametrize(
    ("values", "want"),
    [({"hy": 9.0}, "risk_off"), ({"curve": -0.5}, "risk_off"), ({"curve": 99.0, "vix": 12.0}, "risk_on"), ({"hy": 4.0, "vix": 20.0, "curve": 1.0}, "neutral"), ({}, None), ({"hy": 9.0, "vix": 10.0}, "risk_off")])
def test_regime_any_condition_trips(spark, values, want):
    rows = [(k, date(2024, 1, 2), v) for k, v in values.items()] + [(k, date(2024, 1, 1), 5.0) for k in values]
    got = fundamentals.regime(spark.createDataFrame(rows, "name string, d date, value double"), {"hy": 6.0, "vix": 30.0}, {"curve": -0.25}, {"hy": 3.0, "vix": 15.0}).first()
    assert (got.regime if want else got.regime) == (want or "neutral")


def test_surprise_floor_and_decay(spark):
    rows = [(4.0, 0.001, 10), (4.0, 2.0, None), (4.0, 2.0, -30), (4.0, 2.0, 30), (4.0, 2.0, 90), (None, 2.0, 1), (4.0, None, 1)]
    got = [r.x for r in spark.createDataFrame(rows, "s double, sigma double, days int").select(fundamentals.decayed(F.col("s"), F.col("sigma"), F.col("days")).alias("x")).collect()]
    assert got == [None, 2.0, 2.0, 1.0, 0.0, None, None]


def test_owner_tiers(spark):
    routine = [("routine", y, 3) for y in (2021, 2022, 2023)]
    gap = [("gap", y, m) for y, m in ((2019, 3), (2021, 3), (2023, 3))]  # a gap year makes an opportunistic trader
    short = [("short", 2022, 1), ("short", 2023, 1)]
    stale = [("stale", y, 5) for y in (2015, 2016, 2017, 2018)]
    old = [("old_streak", y, 5) for y in (2015, 2016, 2017)] + [("old_streak", 2023, 1)]
    got = {r.owner: r.tier for r in events.owner_tier(spark.createDataFrame(routine + gap + short + stale + old, "owner string, y int, m int"), 2024).collect()}
    assert got == {"routine": "routine", "gap": "opportunistic", "short": "unclassified", "stale": "unclassified", "old_streak": "opportunistic"}


def test_purchase_strength(spark):
    rows = [
        ("A", "o1", 7, "P", 1_000_000.0, "Chief Financial Officer", False, False, ["officer"]), ("A", "o2", 7, "P", 500_000.0, "Director", False, False, ["director"]),
        ("B", "o1", 8, "P", 200_000.0, "CEO", False, False, ["officer"]), ("B", "o3", 9, "P", 200_000.0, "CEO", False, False, ["officer"]),  # two issuers
        ("C", "o3", 5, "P", 99_999.0, "CFO", False, False, ["officer"]), ("C", "o3", 5, "S", 900_000.0, "CFO", False, False, ["officer"]),
        ("D", "r", 4, "P", 900_000.0, "CFO", False, False, ["officer"]), ("D", "o1", 4, "P", 900_000.0, "CFO", True, False, ["officer"]), ("D", "o1", 4, "P", 900_000.0, "CFO", False, True, ["officer"]),
        ("E", "new", None, "P", 100_000.0, None, None, None, ["director"]), ("F", "o1", 1, "P", 900_000.0, "CFO", False, False, ["owner"])]
    trades = spark.createDataFrame(rows, "ticker string, owner string, issuer int, code string, value double, title string, joint boolean, planned boolean, roles array<string>")
    tiers = spark.createDataFrame([("o1", "opportunistic"), ("o2", "unclassified"), ("r", "routine"), ("o3", "unclassified")], "owner string, tier string")
    got = {r.ticker: (r.owners, r.tier, r.strength) for r in events.strength(events.qualifying(trades, tiers)).collect()}
    assert got == {"A": (2, "opportunistic", 0.9), "E": (1, "unclassified", round((0.5 + 0.02) * 0.8 * 0.6, 4))}


def test_sessions_cross_the_year(spark):
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),), (date(2023, 12, 31),)], "day date")
    shut = spark.createDataFrame([(date(2024, 1, 1),), (date(2023, 12, 25),)], "day date")
    got = {r.day: (r.open, r.last_session) for r in predicates.sessions(days, shut).collect()}
    assert got == {date(2024, 1, 1): (False, date(2023, 12, 29)), date(2024, 1, 2): (True, date(2024, 1, 2)), date(2023, 12, 31): (False, date(2023, 12, 29))}


def test_history_has_no_horizon(spark):
    p = spark.createDataFrame([("A", date(2000, 1, 1), 1.0), ("A", date(2010, 1, 1), 2.0), ("A", date(2020, 1, 1), 4.0)], "ticker string, d date, close double")
    asks = spark.createDataFrame([("A", date(2010, 1, 1)), ("A", date(1999, 1, 1)), ("A", date(2021, 1, 1)), ("B", date(2021, 1, 1))], "ticker string, ask date")
    got = {(r.ticker, r.ask.year): (r.n, r.sum_close, r.first_d) for r in prices.history_counts(asks, p).collect()}
    assert got == {("A", 2010): (2, 3.0, date(2000, 1, 1)), ("A", 1999): (0, None, None), ("A", 2021): (3, 7.0, date(2000, 1, 1)), ("B", 2021): (0, None, None)}


def clamp(spark, stance, conviction, gates=(), confidence=0.9, gaps=(), backed=True):
    call = scoring.clamp_call(F.lit(stance), F.lit(conviction), F.lit(list(gates)).cast("array<string>"), F.lit(confidence).cast("double"), F.lit(list(gaps)).cast("array<string>"), F.lit(backed))
    return spark.range(1).select(call.alias("c")).first().c


def test_guards(spark):
    assert clamp(spark, "STRONG_BUY", "HIGH")[:4] == ("STRONG_BUY", "HIGH", False, False)
    got = clamp(spark, "BUY", "HIGH", ["below_min_mktcap", "negative_fcf", "over_leveraged"])
    assert got[:3] == ("AVOID", "MEDIUM", True) and got.clamp_gates == ["negative_fcf", "over_leveraged"]
    assert clamp(spark, "BUY", "HIGH", ["below_min_mktcap"]).stance == "HOLD"
    assert clamp(spark, "STRONG_AVOID", "HIGH", ["negative_fcf"])[:3] == ("STRONG_AVOID", "HIGH", False)  # never towards hope
    assert clamp(spark, "BUY", "HIGH", confidence=0.44).conviction == "LOW" and clamp(spark, "BUY", "HIGH", confidence=None).conviction == "LOW"
    assert clamp(spark, "BUY", "HIGH", confidence=0.69).conviction == "MEDIUM" and clamp(spark, "BUY", "LOW").conviction == "LOW"
    assert clamp(spark, "BUY", "HIGH", gaps=["moat"]).conviction == "MEDIUM" and clamp(spark, "BUY", "HIGH", backed=False).conviction == "MEDIUM"
    yes = lambda *a: spark.range(1).select(scoring.corroborated(*[F.lit(list(x)).cast("array<string>") if isinstance(x, (list, tuple)) else F.lit(x) for x in a]).alias("x")).first().x
    assert yes("BUY", 0.8, [], True, False, False) and not yes("BUY", 0.8, ["value_trap"], True, False, False) and not yes("BUY", 0.8, [], False, True, True)
    assert yes("AVOID", 0.8, [], False, False, True) and not yes("AVOID", 0.6, [], False, True, True) and yes("HOLD", 0.8, [], False, True, False)


def test_gate_names_the_first_blocking_rule(spark):
    def verdict(diffs, periods=60):
        rows = [(1, i, float(x), periods) for i, x in enumerate(diffs)]
        return backtest.gate(spark.createDataFrame(rows, "candidate int, fold int, diff double, n_periods int")).first().verdict

    assert verdict([0.03, 0.04, 0.05, 0.04, 0.03]) == "endorsed"
    assert verdict([0.03] * 5, 35) == "periods" and verdict([0.03, 0.04, 0.05, 0.04]) == "folds" and verdict([0.01] * 5) == "edge"
    assert verdict([0.2, 0.2, 0.2, -0.01, -0.01]) == "agreement" and verdict([0.5, 0.001, 0.001, 0.001, -0.001]) == "significance"
    assert verdict([0.03] * 5) == "significance"  # no variance, no t
    ics = spark.createDataFrame([(c, m, 0.1 * c + m / 100) for c in (0, 1) for m in range(13)], "candidate int, m int, ic double")
    got = sorted((r.fold, round(r["diff"], 9), r.n_periods) for r in backtest.fold_differences(ics, 0, 4).collect())
    assert got == [(1, 0.1, 13), (2, 0.1, 13), (3, 0.1, 13)]


ADVERSE = "management concluded that our internal control over financial reporting was not effective because of a weakness. "


def test_adverse_conclusions(spark):
    end = date(2023, 12, 31)
    rows = [
        (1, "As of December 31, 2023, " + ADVERSE, end),
        (2, "As of June 30, 2019, " + ADVERSE, end),  # another period
        (3, "Our controls were effective as of December 31, 2023.", end),
        (4, "As of June 30, 2019, " + ADVERSE + "x " * 400 + ". Later, AS OF JANUARY 5 2024, " + ADVERSE, end),  # a later place fits
        (5, "As of the end of the period covered by this Annual Report, " + ADVERSE, end),
        (6, "As of December 31, 2023 our disclosure controls and procedures were not effective. Also, as of December 31, 2023, " + ADVERSE, end),
        (7, "As of December 31, 2023, " + ADVERSE, None),
        (8, None, end),
        (9, "As of Foobar 31, 2023, " + ADVERSE, end)]
    got = {r.doc_id: (r.phrase, r.as_of, r.quote) for r in text.conclusions(spark.createDataFrame(rows, "doc_id int, text string, period_end date")).collect()}
    assert set(got) == {1, 4, 5, 6}
    assert got[1][:2] == (0, end) and got[4][1] == date(2024, 1, 5) and got[5][1] == end and got[6][0] == 0
    assert got[4][2].startswith("Later, AS OF")
    assert got[1][2] == ("As of December 31, 2023, " + ADVERSE).strip()


def test_headlines(spark):
    rows = [
        ("ACME", "The Acme Rockets, Inc.", "Acme-Rockets sued over patent", 2, True), ("ACME", "The Acme Rockets, Inc.", "ACME posts quarterly results", 1, True),
        ("ACME", "The Acme Rockets, Inc.", "Is ACME cheap after earnings?", 0, True), ("ACME", "The Acme Rockets, Inc.", "Rival names former Acme Rockets CFO", 2, False),
        ("F", "Ford Motor Co", "F grade for schools", 0, False), ("F", "Ford Motor Co", "Why Ford matters", 0, True), ("F", "Ford Motor Co", "Analysts like (F) shares", 0, True), ("F", "Ford Motor Co", None, 0, False)]
    df = spark.createDataFrame(rows, "t string, n string, h string, g int, a boolean")
    got = df.select("h", "g", "a", news.grade(F.col("h")).alias("grade"), news.about(F.col("h"), F.col("t"), F.col("n")).alias("about"), news.dropped(F.col("h")).alias("dropped")).collect()
    assert [(r.grade, r.about) for r in got] == [(r.g, r.a) for r in got]
    assert [r.dropped for r in got][2] and not got[0].dropped


def test_edges_of_words_are_those_of_ascii(spark):
    """As in the SQL: a letter with an accent is no part of a word, and only a line feed ends a line."""
    from stockloom.operators import news

    rows = [("ébid", 2, False), ("bidé", 2, False), ("bids", 0, False), ("What's up?\u0085x", 0, True), ("a?\r", 0, True), ("ÑIS", 0, False), ("Reflecting on  earnings", 1, True)]
    df = spark.createDataFrame(rows, "h string, g int, x boolean")
    for r in df.select("h", "g", "x", news.grade(F.col("h")).alias("grade"), news.dropped(F.col("h")).alias("dropped")).collect():
        assert (r.h, r.grade, r.dropped) == (r.h, r.g, r.x)
