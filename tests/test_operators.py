"""Literal tables with hand-made answers: golden correlations, look-ahead, row order, abstention, ties."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.functions.ranks import ic_summary, spearman_by
from stockloom.operators import backtest, events, fundamentals, merge, pit, prices, scoring, text


def test_golden_rank_correlations(spark):
    """Three names on three dates, one pair swapped once: correlations 1, 1 and 1/2."""
    rows = [(m, t, float(v), float(r)) for m, rs in enumerate([(1, 2, 3), (1, 2, 3), (1, 3, 2)]) for t, (v, r) in enumerate(zip((10, 20, 30), rs, strict=True))]
    ic = spearman_by(spark.createDataFrame(rows, "m int, t int, s double, fwd double"), "s", "fwd", "m")
    got = ic_summary(ic).first()
    assert sorted(r.ic for r in ic.collect()) == pytest.approx([0.5, 1.0, 1.0])
    assert (got.n, got.mean_ic, got.sd_ic, got.t_stat, got.hit_rate) == pytest.approx((3, 0.8333333333333334, 0.28867513459481287, 5.0, 1.0))


def test_flat_or_short_groups_abstain(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 2.0), (2, 2.0, 1.0)], "m int, s double, fwd double")
    assert [r.ic for r in spearman_by(df, "s", "fwd", "m").collect()] == [None, None]


def test_columns(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (5.0,), (20.0,)], "v double")
    got = [r.b for r in df.select(C.band(F.col("v"), 0, 10).alias("b")).collect()]
    assert got == [None, None, 0.0, 50.0, 100.0]
    assert df.select(C.band(F.col("v"), 10, 0).alias("b")).collect()[3].b == 50.0
    assert [r.x for r in df.select(C.ratio(F.lit(1.0), F.col("v")).alias("x")).collect()][2] is None
    assert df.select(C.three_figures(F.lit(123456.0)).alias("x")).first().x == 123000.0
    one = spark.range(1)
    assert one.select(C.mean_present(F.lit(None).cast("double"), F.lit(4.0)).alias("x")).first().x == 4.0
    assert one.select(C.weighted_present([(F.lit(None).cast("double"), 5.0), (F.lit(2.0), 1.0)]).alias("x")).first().x == 2.0


def series(spark, n=300):
    rows = [("A", date.fromordinal(730000 + i), 100.0 + (i * 37 % 23)) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, d date, close double"), rows


def test_trailing_features_ignore_order_and_future(spark):
    df, rows = series(spark)
    shuffled = df.repartition(7).orderBy(F.xxhash64("d"))
    a, b = (sorted(map(tuple, prices.features(x).collect())) for x in (df, shuffled))
    assert a == b
    early = sorted(map(tuple, prices.features(df.where(F.col("d") < rows[250][1])).collect()))
    assert early == a[:250]
    last = {r.d: r for r in prices.features(df).collect()}[rows[-1][1]]
    closes = [c for *_, c in rows]
    assert last.sma_20 == pytest.approx(sum(closes[-20:]) / 20)
    assert last.mom_12_1 == pytest.approx(closes[-22] / closes[-274] - 1)
    assert last.near_high == pytest.approx(closes[-1] / max(closes[-252:]))


def test_time_joins(spark):
    df = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 5), 2.0), ("A", date(2020, 1, 9), 3.0)], "ticker string, d date, close double")
    asks = spark.createDataFrame([("A", date(2019, 12, 31)), ("A", date(2020, 1, 7)), ("A", date(2020, 1, 9)), ("B", date(2020, 1, 9))], "ticker string, ask date")
    seen = {(r.ticker, r.ask): r.close for r in prices.as_of(asks, df).collect()}
    assert seen == {("A", date(2019, 12, 31)): None, ("A", date(2020, 1, 7)): 2.0, ("A", date(2020, 1, 9)): 3.0, ("B", date(2020, 1, 9)): None}
    near = {r.ask: r.close for r in prices.nearest(asks.where("ticker = 'A'"), df, 2).collect()}
    assert near == {date(2019, 12, 31): 1.0, date(2020, 1, 7): 2.0, date(2020, 1, 9): 3.0}  # the earlier day on a tie


def test_grid_clamp_sticks(spark):
    got = [r.d for r in backtest.grid(spark, date(2021, 1, 31), date(2021, 5, 1), 1).collect()]
    assert got == [date(2021, 1, 31), date(2021, 2, 28), date(2021, 3, 28), date(2021, 4, 28)]


def test_fit_finds_the_useful_signal(spark):
    rows = [(m, t, float(t * 7 % 13), float((t * 5 + m) % 11), float(t * 7 % 13)) for m in range(6) for t in range(13)]
    df = spark.createDataFrame(rows, "m int, ticker int, good double, noise double, fwd double")
    got = backtest.fit_weights(df, {"good": 0.5, "noise": 0.5}, sweeps=6)
    assert got["good"] > 0.55 and sum(got.values()) == pytest.approx(1.0)


def test_point_in_time(spark):
    rows = [(1, "x", date(2019, 12, 31), date(2020, 3, 1), 10.0, 0), (1, "x", date(2019, 12, 31), date(2020, 9, 1), 11.0, 1), (1, "x", date(2019, 12, 31), date(2020, 9, 1), 12.0, 2), (1, "y", date(2019, 12, 31), date(2020, 1, 1), 5.0, 3)]
    facts = spark.createDataFrame(rows, "cik int, tag string, fy_end date, filed date, val double, pos int")
    dates = spark.createDataFrame([(date(2020, 2, 1),), (date(2020, 4, 1),), (date(2021, 1, 1),)], "as_of date")
    ask = lambda f: {r.as_of: r.val for r in pit.select(pit.known(f, dates), {"x": 0, "y": 1}).collect()}
    want = {date(2020, 2, 1): 5.0, date(2020, 4, 1): 10.0, date(2021, 1, 1): 11.0}
    assert ask(facts) == want
    later = spark.createDataFrame([(1, "x", date(2019, 12, 31), date(2022, 1, 1), 99.0, 9)], facts.schema)
    assert ask(facts.union(later)) == want


def test_source_merge(spark):
    rows = [(1, "b", 0.0, None), (1, "a", 7.0, 8.0), (1, "zz", 1.0, 1.0), (2, "zz", None, 3.0)]
    df = merge.ranked_sources(spark.createDataFrame(rows, "k int, source string, x double, y double"), ["b", "a"])
    got = {r.k: (r.x, r.y, sorted(r.sources)) for r in merge.merge_fields(df, "k", ["x", "y"]).collect()}
    assert got == {1: (0.0, 8.0, ["a", "b"]), 2: (None, 3.0, ["zz"])}
    years = [(1, "b", 2020, 1.0, None), (1, "b", 2021, 2.0, None), (1, "a", 2020, 9.0, 5.0), (1, "a", 2019, 9.0, 4.0)]
    y = merge.ranked_sources(spark.createDataFrame(years, "k int, source string, fiscal_year int, x double, y double"), ["b", "a"])
    assert sorted(map(tuple, merge.backfill_years(y, "k", ["x", "y"]).collect())) == [(1, 2020, 1.0, 5.0), (1, 2021, 2.0, None)]


def test_names_and_identity(spark):
    df = spark.createDataFrame([("The Acme Holdings, Inc.", "A", 0, 1), ("ACME", "B", 1, 2), ("Zeta Corp", "Z", 2, 3)], "name string, ticker string, pos int, cik int")
    assert {r.key: r.ticker for r in merge.name_keys(df).collect()} == {"zeta": "Z"}
    t = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "accession int, key string")
    assert {r.accession for r in merge.already_reported(t, ["key"]).collect()} == {1, 3, 4}
    pairs = text.fuzzy_names(spark.createDataFrame([(1, "acme widget")], "id int, key string"), spark.createDataFrame([(7, "acme widgets"), (8, "acme road")], "id int, key string"), 0.8)
    assert [(r.id, r.other) for r in pairs.collect()] == [(1, 7)]


def test_scores(spark):
    m = spark.createDataFrame([("A", 3571, 0.15, 0.2, 1e9, -1.0), ("B", 6798, 0.30, 0.9, 1e8, -1.0), ("C", None, None, None, None, None)], "ticker string, sic int, net_margin double, debt_to_equity double, market_cap double, fcf double")
    got = {r.ticker: r for r in scoring.score(m).collect()}
    assert got["A"].quality == pytest.approx((50 + (0.2 - 3) / -3 * 100) / 2)
    assert got["A"].gates == ["negative_fcf"] and got["B"].gates == ["below_min_mktcap"]  # the first gate does not apply to property
    assert got["B"].moat is None and "moat:inapplicable" in got["B"].abstained
    assert got["B"].quality == pytest.approx(100.0)
    assert got["C"].composite == 0.0 and not got["C"].scored
    assert [r.ticker for r in scoring.ranked(scoring.score(m)).orderBy("place").collect()][-1] == "C"


def test_fundamentals_abstain(spark):
    df = spark.createDataFrame([(1, 2019, 1.0), (1, 2021, 4.0), (2, 2019, -1.0), (2, 2020, 2.0), (2, 2021, 3.0), (3, 2019, 1.0), (3, 2020, 2.0), (3, 2021, 4.0)], "entity int, fiscal_year int, v double")
    got = {r.entity: r.g for r in df.groupBy("entity").agg(fundamentals.cagr("v").alias("g")).collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(1.0)
    run = fundamentals.newest_run(df, ["v"]).groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in run} == {1: 1, 2: 3, 3: 3}


def test_new_positions_need_a_prior_book(spark):
    book = spark.createDataFrame([(1, 1, "a", 10.0, 1.0), (1, 2, "a", 10.0, 1.0), (1, 2, "b", 30.0, 1.0), (2, 2, "c", 5.0, 1.0)], "fund int, q int, cusip string, value double, shares double")
    assert [(r.fund, r.cusip) for r in events.new_positions(book, 0.01, 0.5).collect()] == [(1, "b")]


def test_item_codes(spark):
    got = spark.createDataFrame([("Item 1.01, Item 2.02 and 1.01",), ("none",)], "t string").select(events.matched_items(events.item_codes(F.col("t")), [["3.01"], ["2.02", "1.01"]]).alias("m")).collect()
    assert [r.m for r in got] == [["1.01", "2.02"], None]


def test_option_surface(spark):
    from stockloom.operators import options

    day, near, far = date(2025, 1, 1), date(2025, 1, 31), date(2025, 6, 30)
    leg = lambda e, side, k, b, a, d, iv: ("X", e, side, k, b, a, d, iv, 100.0, day)
    rows = [leg(near, "call", 100.0, 2.0, 2.2, 0.52, 0.30), leg(near, "put", 100.0, 1.8, 2.0, -0.48, 0.32), leg(near, "call", 110.0, 0.5, 0.6, 0.24, 0.28), leg(near, "put", 90.0, 0.5, 0.6, -0.26, 0.40), leg(near, "call", 101.0, 0.0, 9.0, 0.50, 9.0),
        leg(far, "call", 100.0, 1.0, 9.0, 0.5, 0.3), leg(far, "put", 100.0, 5.0, 5.2, -0.5, 0.3), leg(date(2024, 12, 1), "call", 100.0, 1.0, 1.1, 0.5, 0.1)]
    chain = spark.createDataFrame(rows, "ticker string, expiry date, side string, strike double, bid double, ask double, delta double, iv double, spot double, day date")
    got = {r.expiry: r for r in options.surface(chain).collect()}
    assert got[near].iv == pytest.approx(0.31) and got[near].move == pytest.approx(0.04) and got[near].skew == pytest.approx(0.12)
    assert got[far].move is None and got[far].skew is None and len(got) == 2
    exp = spark.createDataFrame([("X", near, 30), ("X", far, 180)], "ticker string, expiry date, dte int")
    assert options.earnings_expiry(exp, spark.createDataFrame([("X", 20)], "ticker string, days int")).first().expiry == near
    s = spark.createDataFrame([("AAPL250131C00100500",), ("junk",)], "s string").select(*options.option_symbol(F.col("s"))).collect()
    assert tuple(s[0]) == ("AAPL", near, "call", 100.5) and tuple(s[1]) == (None,) * 4


def test_proxy_tables(spark):
    from stockloom.operators import options

    pay = spark.createDataFrame([("X", 2020, 1.0, 5.0), ("X", 2022, 2.0, 4.0), ("Y", 2020, 1.0, 1.0)], "ticker string, year int, pay double, total_return double")
    assert {r.ticker: r.aligned for r in options.pay_direction(pay).collect()} == {"X": False, "Y": None}
    h = spark.createDataFrame([("X", "a", 30.0), ("X", "b", 21.0), ("X", "c", 4.9)], "ticker string, name string, percent double")
    r = options.concentrated(h).first()
    assert (r.holders, r.total, r.largest, r.controlled) == (2, 51.0, "a", True)


def test_every_added_block_meets_every_prior_block(spark):
    from difflib import SequenceMatcher

    now = ["alpha beta gamma", "kept block", "the rate rose to nine", "zzz", "short words but then a very much longer tail of other things"]
    before = [f"filler number {i} of the old filing" for i in range(40)] + ["kept block", "the rate rose to eight", "short", "alpha beta delta"]
    docs = spark.createDataFrame([(1, "\n\n".join(before)), (2, "\n\n".join(now)), (3, ""), (4, "alone")], "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 1), (4, 3)], "doc_id long, prior_doc_id long")
    got = {(r.doc_id, r.pos): r.ratio for r in text.block_ratios(pairs, docs).collect()}
    want = {(2, i): max(SequenceMatcher(None, b, p).ratio() for p in before) for i, b in enumerate(now) if b != "kept block"}
    assert got == pytest.approx(want | {(4, 0): 0.0})


def test_closest_in_size_rounds_the_gap_not_the_sizes(spark):
    """Sizes a fraction of a billionth apart, against all pairs: gaps are rounded once, ties go by ticker."""
    import math
    import random

    from stockloom.operators import peers as G

    rnd = random.Random(5)
    caps = {t: math.exp(20 + rnd.randrange(60) * 0.37e-9) for t in rnd.sample(range(1000), 80)}
    rows = spark.createDataFrame([(1, t, c) for t, c in caps.items()], "sector int, ticker long, cap double")
    got = {(r.ticker, r.nth): r.peer for r in G.closest_in_size(rows, 3).collect()}
    for t, c in caps.items():
        near = sorted((math.floor(abs(math.log(c) - math.log(x)) * 1e9 + 0.5), p) for p, x in caps.items() if p != t)[:3]
        assert [got[t, i + 1] for i in range(3)] == [p for _, p in near]


def test_members_alike_do_not_differ_by_the_order_of_adding(spark, tmp_path):
    from datetime import datetime

    from stockloom.plans import research

    values = [1234567.1, 0.37, 91823.93, 18.11, 771.57, 402345.29, 5.03]
    rows = [(k, float(v), 1.0, 0.01, 0.0, "O", datetime(1992 + y, 1, 1)) for k in range(7) for y, v in enumerate(values[k:] + values[:k])]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1) for k in range(7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert len({(r.cap, r.margin, r.income) for r in research._members(spark, str(tmp_path)).collect()}) == 1
