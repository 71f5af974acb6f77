"""Cards of literal inputs: guards of single legs, masks, optional parts, coverage records and merged snapshots."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.ordered import numbered, running
from stockloom.operators import backtest, coverage, merge, peers, scoring, text


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """One-row plans are quicker without compiling them."""
    for key, value in (("spark.sql.codegen.wholeStage", "false"), ("spark.sql.codegen.factoryMode", "NO_CODEGEN")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode"):
        spark.conf.unset(key)


def cards(spark, cases, config=scoring.CONFIG, macro=None):
    """One card for each case (a dictionary of metrics), all in one plan."""
    names = sorted({k for c in cases for k in c} - {"sic"})
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("sic", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    rows = [(f"{i:03d}", c.get("sic"), *[None if c.get(n) is None else float(c[n]) for n in names]) for i, c in enumerate(cases)]
    return scoring.score(spark.createDataFrame(rows, schema), config, macro).orderBy("ticker").collect()


def test_legs(spark):
    got = cards(spark, [
        dict(peg=-1, pe_ttm=10), dict(peg=1, pe_ttm=-5), dict(peg=0.5, pe_ttm=10), dict(roic=0.05, roic_5y_avg=0.30), dict(roic=0.30), dict(roe=float("nan")),
        dict(sic=6022, roe=0.35, debt_to_equity=9, gross_margin=0.5), dict(sic=3571, roe=0.35), dict(roe=0.35)])
    assert [got[i].value for i in range(3)] == [None, None, 100] and got[3].moat == 100 == got[4].moat and got[5].quality is None
    bank = got[6]
    assert bank.quality == 100 and bank.moat is None  # leverage is masked; one of two applicable legs is enough
    said = [tuple(a) for a in bank.abstentions]
    assert ("moat", "inapplicable", "subscore") in said and ("gross_margin", "inapplicable", "leg") in said
    assert got[7].quality is None and got[8].quality == 100  # a known sector needs half its legs


def test_optional_parts(spark):
    sue = {"last_surprise": 4, "surprise_dispersion": 2, "days_since_report": 0, "earnings_quarters": 4}
    cases = [{"eps_cagr": 0.0, "eps_cagr_ps": 0.20}, {"upside_to_target": 0.4}, sue, {**sue, "earnings_quarters": 2}]
    plain = cards(spark, cases)
    on = cards(spark, cases, scoring.configured(quality={"dilution": True}, value={"upside_to_target": False}, momentum={"sue": True}))
    assert (plain[0].growth, on[0].growth) == (0, 100) and (plain[1].value, on[1].value) == (100, None)
    assert (plain[2].momentum, on[2].momentum, on[3].momentum) == (None, 100, None)
    assert cards(spark, [sue], scoring.configured(momentum={"sue": True}, thresholds={"sue": None}))[0].momentum is None  # no band, no leg


def test_insider_conviction_only_raises(spark):
    base = {"insider_sentiment": 0.0, "market_cap": 1e9}
    cases = [{**base, "insider_distinct_buyers": 0}, {**base, "insider_distinct_buyers": 4}, {"insider_net_6m": -500_000, "market_cap": 1e9, "insider_planned_sell_value": 500_000}]
    assert [c.insider for c in cards(spark, cases)] == [50, 50, 0]
    assert [c.insider for c in cards(spark, cases, scoring.configured(insider={"conviction": True}))] == [50, 75, 50]


def test_gates_and_flags(spark):
    short = {"short_pct_outstanding": 0.2, "days_to_cover": 6, "short_interest_rising": 1}
    gates = [
        (dict(fcf=-1), ["negative_fcf"]), (dict(fcf=-1, revenue_cagr=0.15, revenue_growth_persistence=0.7), []), (dict(sic=6798, fcf=-1, debt_to_equity=9), []), (dict(market_cap=None), []), (dict(market_cap=1e8), ["below_min_mktcap"]),
        (dict(debt_to_equity=6), ["over_leveraged"]), (dict(debt_to_equity=25), []), (dict(debt_to_equity=6, interest_coverage=3), []), (dict(ebitda=10, revenue=100, net_debt_to_ebitda=3, debt_to_equity=6), []),
        (dict(ebitda=1, revenue=100, net_debt_to_ebitda=3, debt_to_equity=6), ["over_leveraged"]), (dict(insider_sentiment=-0.7), ["heavy_insider_selling"])]
    flags = [
        (short, ["crowded_short"]), ({**short, "short_data_age_days": 36}, []), (dict(activist_13d=1, late_filing=0, auditor_change=1), ["activist_13d", "auditor_change"]), (dict(news_count_7d=10, news_rising=1, news_truncated=1), []),
        (dict(news_count_7d=10, news_rising=1), ["news_spike"]), (dict(filing_text_similarity=0.1), []), (dict(social_mentions=50, social_rising=1, social_delta=0.4), []), (dict(social_mentions=50, social_rising=1), ["social_hype"])]
    got = cards(spark, [c for c, _ in gates + flags])
    assert [c.gates for c in got[: len(gates)]] == [g for _, g in gates] and [c.flags for c in got[len(gates) :]] == [f for _, f in flags]
    assert cards(spark, [dict(filing_text_similarity=0.1)], scoring.configured(flags={"filing_text_change": {"max_similarity": 0.7}}))[0].flags == ["filing_text_change"]


def test_value_trap_and_risk_off(spark):
    cheap = {"fcf_yield": 0.08, "roe": 0.1}
    assert cards(spark, [cheap])[0].flags == ["value_trap"]
    on = scoring.configured(flags={"value_trap": {**scoring.CONFIG["flags"]["value_trap"], "suppress_at": 0.8, "confirm_at": 0.34}})
    cases = [{**cheap, "piotroski_won": 6, "piotroski_legs": 6}, {**cheap, "piotroski_won": 3, "piotroski_legs": 3}, {"fcf_yield": 0.08, "roe": 0.35, "piotroski_won": 1, "piotroski_legs": 6}]
    assert [c.flags for c in cards(spark, cases, on)] == [[], ["value_trap"], ["value_trap"]]
    exposed = [dict(debt_to_equity=2), dict(debt_to_equity=-2), dict(debt_to_equity=21), dict(net_debt_to_ebitda=3.5)]
    assert ["risk_off_regime" in c.flags for c in cards(spark, exposed, macro=F.lit(True))] == [True, False, False, True] and not any(c.flags for c in cards(spark, exposed, macro=F.lit(False)))


def test_composite_floor_and_thin(spark):
    alone = cards(spark, [dict(realized_vol=0.15)], scoring.configured(weights={"risk": 0.5}))[0]
    assert alone.composite == 100 and not alone.scored  # a tilt alone does not make a card
    strict = scoring.configured(validity={"min_composite_components": 2}, ranking={"thin_below": 0.5})
    plain, other = cards(spark, [dict(roe=0.35)])[0], cards(spark, [dict(roe=0.35)], strict)[0]
    assert plain.scored and not plain.thin and not other.scored and other.thin
    some = scoring.score(spark.createDataFrame([("A", None, 0.1), ("B", None, None)], "ticker string, sic int, roe double"))
    assert {r.ticker: r.x for r in some.select("ticker", scoring.no_data(some).alias("x")).collect()} == {"A": False, "B": True}


def test_coverage(spark):
    outcomes = spark.createDataFrame([("A", "x", "ok"), ("A", "y", "ok"), ("A", "z", "ok"), ("B", "x", "ok"), ("C", "x", "error")], "ticker string, source string, status string")
    gave = spark.createDataFrame([("A", "x"), ("B", "x")], "ticker string, source string")
    dim = spark.createDataFrame([("x", False, True), ("y", True, True), ("z", False, False)], "source string, no_data_is_normal boolean, feeds_axes boolean")
    states = coverage.statuses(outcomes, gave, dim)
    scored = scoring.score(spark.createDataFrame([("A", 6022, 0.35), ("C", None, None)], "ticker string, sic int, roe double"))
    got = {r.ticker: r for r in coverage.records(states, scored).collect()}
    assert set(got) == {"A", "C"} and got["A"].providers == ["x=ok", "y=ok", "z=empty"] and got["A"].axisless == ["z"]
    assert got["A"].unavailable == ["growth", "momentum", "value", "insider"] and "moat" in got["C"].unavailable and got["C"].note == "x: supplied no usable data for this symbol"
    assert {r.ticker: r.gaps for r in coverage.unexplained(states).collect()} == {"A": [], "B": [], "C": ["x"]}
    known = coverage.Sources()
    known.add("one", lambda s, _: s.createDataFrame([("A", 1)], "k string, u int"))
    known.add("two", lambda s, _: s.createDataFrame([("A", 2)], "k string, v int"), no_data_is_normal=True, feeds_axes=False)
    assert {(r.source, r.u, r.v) for r in known.rows(spark, "").collect()} == {("one", 1, None), ("two", None, 2)}
    assert known.aux_only(["one", "two", "other"]) == ["two"] == known.axisless(["two"])
    with pytest.raises(ValueError):
        known.add("one", lambda s, _: s.range(1))


def test_snapshots(spark):
    rows = [("A", "guess", 9.0, 9.0, 9, 9, None), ("A", "second", 2.0, None, None, None, "late"), ("A", "first", None, 0.0, None, 5, "slow"), ("B", "guess", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, source string, price double, high double, n int, m int, error string")
    got = {r.k: r for r in merge.merge_snapshots(df, "k", ["first", "second"], {"price": ["price", "high"]}, {"news": ["n", "m"]}).collect()}
    a, b = got["A"], got["B"]
    assert (a.price, a.high, a.price_sources) == (2.0, 0.0, ["first", "second"])  # zero is a value
    assert (a.n, a.m, a.news_source, a.errors) == (None, 5, "first", ["first: slow", "second: late"])
    assert (b.price, b.price_sources, b.news_source, b.errors) == (None, [], None, [])


def test_orders_without_one_window(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(9)
    got = [(r.v, r.id, r.place, r.upto) for r in running(df, [F.col("v"), F.col("id")], place=F.lit(1), upto=F.col("v")).orderBy("place").collect()]
    assert [g[:2] for g in got] == sorted(g[:2] for g in got) and [g[2] for g in got] == list(range(1, 1001))
    assert all(g[3] == sum(x[0] for x in got[: i + 1]) for i, g in enumerate(got))
    assert numbered(df.limit(0), [F.col("id")]).count() == 0


def test_tau_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(m, t, float(rng.randrange(6 if m else 100)), float(rng.randrange(8))) for m in range(3) for t in range(37)] + [(9, 1, 1.0, 1.0), (8, 1, 1.0, None)]
    got = {r.m: (r.tau, r.pairs) for r in backtest.kendall(spark.createDataFrame(rows, "m int, ticker int, a double, b double"), "a", "b").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for m in range(3):
        g = [r for r in rows if r[0] == m]
        s = [sign(x[2] - y[2]) * sign(x[3] - y[3]) for i, x in enumerate(g) for y in g[:i]]
        assert got[m] == (pytest.approx(sum(s) / len(s)), len(s))
    assert set(got) == {0, 1, 2}


def test_peers_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(3), f"T{i:03d}", rng.choice([None, -1.0, 5.0, 5.0, 7.0, float(rng.randrange(1, 60))])) for i in range(120)]
    got = {}
    for r in peers.closest_in_size(spark.createDataFrame(rows, "sector int, ticker string, cap double"), 3).collect():
        got.setdefault(r.ticker, {})[r.nth] = r.peer
    live = [r for r in rows if r[2] and r[2] > 0]
    for s, t, c in live:
        want = sorted((round(abs(round(math.log(c), 9) - round(math.log(d), 9)), 9), u) for v, u, d in live if v == s and u != t)[:3]
        assert [got[t][n + 1] for n in range(len(want))] == [u for _, u in want]
    vendor = spark.createDataFrame([("me", [" abc", "ME", "abc", "bad ticker", None, "X.Y"])], "ticker string, peers array<string>")
    assert [(r.peer, r.pos) for r in peers.peer_list(vendor).orderBy("pos").collect()] == [("ABC", 1), ("X.Y", 2)]
    others = peers.median_of_others(spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([5, 1, 9, 9])] + [(2, 7, 1.0)], "g int, k int, v double"), ["g"], "k", "v")
    assert {r.k: (r.med, r.n) for r in others.collect()} == {0: (9.0, 3), 1: (9.0, 3), 2: (5.0, 3), 3: (5.0, 3), 7: (None, 0)}


def test_name_matching_recall(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(8)
    words = "northern global harbor metal energy systems bright river united castle motors foods pacific".split()
    base = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(60)]
    alter = lambda x: "".join(c for c in x if rng.random() > 0.06) if rng.random() < 0.6 else " ".join(reversed(x.split()))
    left = [(i, alter(b)) for i, b in enumerate(base)]
    table = lambda rows: spark.createDataFrame(rows, "id int, key string")
    got = {r.id: (r.other, round(r.ratio, 9)) for r in text.fuzzy_names(table(left), table(list(enumerate(base))), 0.8).collect()}
    want = {}
    for i, a in left:
        best = min(((-round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 9), j) for j, b in enumerate(base) if a), default=(0, None))
        if -best[0] >= 0.8:
            want[i] = (best[1], -best[0])
    assert len(want) > 30 and sum(got.get(i) == w for i, w in want.items()) >= 0.97 * len(want)
    alias = spark.createDataFrame([(99, "old harbor")], "id int, phrase string")
    assert text.fuzzy_names(table([(1, "the old harbor works")]), table([(99, "zzz")]), 0.8, alias).first()[:3] == (1, 99, 1.0)


def test_short_quotes(spark):
    claims = spark.createDataFrame([(1, "a short but whole quote"), (2, "Nothing of   the sort stands here at all today"), (3, "tiny"), (4, "the second part of a longer sentence that stands")], "item_id int, text string")
    segments = spark.createDataFrame([(7, "so this is a SHORT but\nwhole quote, and the second part of a longer sentence that stands here"), (5, "a short but whole quote"), (6, None)], "doc_id int, text string")
    assert {r.item_id: (r.doc_id, r.places) for r in text.grounded(claims, segments).collect()} == {1: (5, 2), 4: (7, 1)}


def test_standing_is_the_last_day_of_the_sliding_measures(spark):
    from stockloom.operators import prices as P

    rows = [(t, date(2020, 1, 1) + timedelta(days=i), float((i * 37 + t * 11) % 101 + 1)) for t, n in ((1, 300), (2, 199), (3, 200), (4, 1)) for i in range(n)]
    p = spark.createDataFrame(rows, "ticker int, d date, close double")
    slid = p.select("ticker", "d", "close", P.over_sma(200).alias("x")).groupBy("ticker").agg(F.max_by("close", "d").alias("close"), F.max_by("x", "d").alias("x")).join(P.max_drawdown(p), "ticker")
    near = lambda v: None if v is None else round(v, 9)
    plain = lambda df: sorted((r[0], r[1], near(r[2]), near(r[3])) for r in df.collect())
    assert plain(P.standing(p)) == plain(slid)


def test_metrics_read_the_lines_once_for_statements_and_once_for_prices(spark):
    from stockloom.plans import fundamentals as PF

    plan = PF.metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") and sum("Relation [" in x and "l_orderkey" in x for x in plan.splitlines()) <= 2
