"""News events, text selections, study rules, ranking bounds, panels and streamed flows on literal rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.operators import backtest, pit, stories, study, text
from stockloom.streaming import operators as O


def at(day, hour=0):
    return datetime(2024, 3, 1) + timedelta(days=day, hours=hour)


def test_news_events(spark):
    rows = [
        ("A", 1, at(0), "Acme sued by Orion over Patent 5", "", 2), ("A", 2, at(1), "Orion and Acme: Patent fight", "", 1), ("A", 3, at(2), "Weather in Paris stays mild", "", 1),
        ("A", 4, at(3), "Acme to buy Zenith in takeover", "", 2), ("A", 5, at(9), "Zenith takeover talks with Acme go on", "", 2), ("A", 6, at(9, 5), "Zenith rejects the bid", "", 2),
        ("A", 7, at(30), "Quarter results beat forecasts", "", 1), ("A", 8, at(31), "Earnings fall short of hopes", "", 1), ("A", 9, at(60), "Nothing much", "", 0), ("B", 10, at(0), "Acme sued by Orion over Patent 5", "", 2)]
    got = stories.clusters(spark.createDataFrame(rows, "ticker string, id int, ts timestamp, headline string, summary string, grade int"))
    event = {r.id: (r.ticker, r.run, r.event) for r in got.collect()}
    assert len(event) == 10
    assert event[1] == event[2] != event[3] and event[4] == event[5] != event[6]  # a denial stays an item of its own
    assert event[7] == event[8] and event[10] != event[1]  # results come once a window
    top = {r.face: (r.place, r.reports) for r in stories.top_events(got, 3).where("ticker = 'A'").collect()}
    assert set(top) == {1, 4, 6} and top[1][1] == 2 and [k for k, v in sorted(top.items(), key=lambda x: x[1][0])][0] == 6


def test_added_blocks(spark):
    docs = spark.createDataFrame([(1, "old risk about weather\n\nold risk about people"), (2, "Old risk, about weather!\n\nentirely new cyber matters here\n\nold risk about peoples\n\nfresh tariff words 123456789"), (3, ""), (4, "something")], "doc_id int, text string")
    pairs = spark.createDataFrame([(2, 1), (4, 3)], "doc_id int, prior_doc_id int")
    got = [(r.doc_id, r.pos, r.block) for r in text.added_blocks(pairs, docs).orderBy("pos").collect()]
    assert got == [(2, 1, "entirely new cyber matters here"), (2, 3, "fresh tariff words 123456789")]  # no baseline, nothing new
    assert [r.block for r in text.added_blocks(pairs, docs, most_blocks=1, most_chars=8).collect()] == ["entirely"]


def test_notes_and_reports(spark):
    notes = spark.createDataFrame([("f", 1, "Leases", "x" * 9), ("f", 2, "Long-term DEBT", "y" * 9), ("f", 3, "Debt policy", "z"), ("f", 4, "Credit facility debt", "w" * 9), ("g", 1, "Other", "q")], "filing string, pos int, title string, text string")
    got = [(r.filing, r.pos, r.family, r.place, r.text) for r in text.select_notes(notes, [("debt", "debt|credit", "policy"), ("leases", "lease", None)], 3, 6, 14).orderBy("place").collect()]
    assert got == [("f", 2, "debt", 1, "y" * 6), ("f", 4, "debt", 2, "w" * 6), ("f", 1, "leases", 3, "xx")]
    d = date(2024, 5, 1)
    reports = spark.createDataFrame([("A", 1, "8-K", d, ["2.02"]), ("A", 2, "8-K", date(2024, 4, 1), ["4.02", "9.01"]), ("A", 3, "8-K/A", d, ["4.02"]), ("A", 4, "8-K", date(2020, 1, 1), ["4.02"]), ("A", 5, "8-K", d, ["9.01"]), ("A", 6, "8-K", d, ["2.02", "4.02"])], "filer string, id int, form string, filed date, items array<string>")
    got = [(r.id, r.hits, r.place) for r in text.rank_reports(reports, ["4.02", "2.02"], F.lit(date(2024, 1, 1)), 2).orderBy("place").collect()]
    assert got == [(6, ["4.02", "2.02"], 1), (2, ["4.02"], 2)]


def test_pass_rules_and_checks(spark):
    good = dict(k=1, beta=0.2, se=0.05, bound_held=0.05, bound_not=0.04, rank_beta=0.1, beta_sub=0.1, hold_beta=0.1, hold_se=0.02, hold_sub=0.06)
    bad = [{**good, "se": 0.11}, {**good, "bound_not": 0.02}, {**good, "rank_beta": 0.0}, {**good, "beta_sub": None}, {**good, "hold_sub": 0.04}, {**good, "se": None}]
    rows = [{**r, "k": i} for i, r in enumerate([good, *bad])]
    got = {r.k: r for r in study.pass_rules(spark.createDataFrame(rows, "k int, beta double, se double, bound_held double, bound_not double, rank_beta double, beta_sub double, hold_beta double, hold_se double, hold_sub double")).collect()}
    assert [got[i].passed for i in range(7)] == [True] + [False] * 6
    assert [got[1].magnitude, got[2].bounds, got[3].continuous_sign, got[4].sub_industry, got[5].holdout, got[6].magnitude] == [False] * 6
    sizes = spark.createDataFrame([(2020, 100), (2021, 86), (2023, 115)], "year int, n int")
    want = spark.createDataFrame([(y, 100) for y in (2020, 2021, 2022, 2023)], "year int, expected int")
    assert [(r.year, r.got) for r in study.reproduction_failures(sizes, want).collect()] == [(2022, 0)]
    rates = spark.createDataFrame([(2018, 0.1), (2019, 0.2), (2020, 0.12), (2021, 0.3), (2023, 0.0)], "year int, rate double")
    assert [r.year for r in study.gap_spikes(rates).collect()] == [2019]


def test_ranking_bound(spark):
    rows = [(m, t, float(t), float(t * (1 if m else 37) % 40), float(t % 7)) for m in (0, 1) for t in range(40)]
    df = spark.createDataFrame(rows, "m int, ticker int, inc double, c1 double, other double")
    churn, verdict = backtest.prize_bound(df, {"other": 1e-6, "inc": 0.5}, "inc", ["c1"], trials=5)
    got = {(r.m, r.kind, r.name): r for r in churn.collect()}
    assert got[0, "reversed", ""].tau < -0.99 and got[1, "candidate", "c1"].tau == 1.0 and got[1, "candidate", "c1"].overlap == 1.0 and len(got) == 2 * 7
    assert {r.m: r.verdict for r in verdict.collect()} == {0: "proceed", 1: "collinear"}
    assert {r.verdict for r in backtest.prize_bound(df, {"other": 1.0, "inc": 1e-9}, "inc", ["c1"])[1].collect()} == {"weight_inert"}


def test_replay_and_proposal(spark):
    cards = spark.createDataFrame([("A", 1, 0.5, 60.0, 70.0, None), ("B", 1, 0.2, 10.0, None, 5.0)], "ticker string, day int, confidence double, composite double, quality double, value double")
    assert {tuple(r) for r in backtest.replay(cards, 0.34, ("quality", "value")).collect()} == {("A", 1, "composite", 60.0), ("A", 1, "quality", 70.0), ("B", 1, "value", 5.0)}
    w = spark.createDataFrame([("a", 0.3, 3.0), ("b", 0.3, 1.0), ("c", 0.4, 9.0)], "axis string, prior double, fitted double")
    assert {r.axis: round(r.proposed, 9) for r in backtest.proposal(w, F.col("axis") != "c").collect()} == {"a": 0.45, "b": 0.15, "c": 0.4}
    with pytest.raises(ValueError):
        backtest.residuals(cards, "quality", [])


def test_full_panel(spark):
    d = lambda y: date(y, 12, 31)
    facts = [(1, "R1", d(2020), date(2021, 2, 1), 10.0, 1), (1, "R2", d(2020), date(2021, 2, 1), 99.0, 2), (1, "R2", d(2021), date(2022, 2, 1), 20.0, 3), (1, "R1", d(2020), date(2022, 2, 1), 11.0, 4), (1, "D1", d(2021), date(2022, 2, 1), 2.0, 5), (1, "D2", d(2021), date(2022, 2, 1), 3.0, 6),
             (1, "R1", d(2022), date(2023, 2, 1), 50.0, 7), (1, "C", d(2021), date(2022, 2, 1), 5.0, 8)]
    tags = {n: [n] for n in pit.SERIES} | {"revenue": ["R1", "R2"], "dividends_paid": ["D1", "D2"], "cost": ["C"]}
    known = pit.known(spark.createDataFrame(facts, "cik int, tag string, fy_end date, filed date, val double, pos int"), spark.createDataFrame([(date(2022, 6, 30),)], "as_of date"))
    got = {r.fy_end.year: r for r in pit.full_panel(known, tags).collect()}
    assert set(got) == {2020, 2021} and (got[2020].revenue, got[2021].revenue) == (11.0, 20.0)  # restated, then the second tag; nothing later
    assert got[2021].dividends_paid == 5.0 and got[2021].gross_profit == 15.0 and got[2020].gross_profit is None
    none = spark.createDataFrame([], "cik int, as_of date, fy_end date, px double"), spark.createDataFrame([(1, date(2022, 6, 30), None)], "cik int, as_of date, price double")
    m = pit.panel_metrics(pit.full_panel(known, tags), *none).first()
    assert m.gross_margin == 0.75 and m.revenue == 20.0 and m.market_cap is None and m.revenue_cagr is None and m.piotroski_legs is None
    one = spark.createDataFrame([(10.0, 3.0, 5.0, 40.0, 60.0), (10.0, -1.0, 5.0, 40.0, 60.0), (10.0, 1.0, 5.0, None, 60.0), (10.0, 1.0, -5.0, 40.0, 60.0), (10.0, 1.0, 5.0, 40.0, -60.0)], "i double, t double, p double, d double, e double")
    assert [r.x for r in one.select(pit.taxed_return(*[F.col(c) for c in "itpde"]).alias("x")).collect()] == pytest.approx([0.079, 0.079, None, 0.079, None])


def test_streamed_flow_equals_batch(spark, tmp_path):
    d = lambda n: date(2024, 1, 1) + timedelta(days=n)
    rows = [("A", 1, d(0), "P", 10.0), ("A", 2, d(5), "P", 5.0), ("A", 1, d(5), "P", 1.0), ("A", 3, d(5), "S", 4.0), ("A", 3, d(184), "A", 9.0), ("A", 2, d(188), "P", 2.0), ("B", 9, d(3), "S", 1.0)]
    schema = "ticker string, owner int, d date, code string, value double"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        O.daily_owner_flow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.ticker, (r.d - d(0)).days): (r.flow, r.buyers) for r in O.half_year_flow(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {("A", 0): (10.0, 1), ("A", 5): (12.0, 2), ("A", 184): (2.0, 2), ("A", 188): (4.0, 2), ("B", 3): (-1.0, 0)}


def test_flat_metrics(spark):
    from stockloom.operators.flatten import flat_metrics

    row = dict(ticker="A", as_of=date(2024, 5, 1), market_cap=1000.0, price=10.0, operating_income0=50.0, interest_expense0=-5.0, total_debt0=300.0, cash0=100.0, ebitda0=-4.0, fcf0=-20.0, diluted_eps0=0.5, pe_median=30.0, short_shares=90.0, prev_short_shares=80.0, split_flag=1.0,
               days_to_cover=999.99, settlement_day=date(2024, 4, 15), social_mentions=6.0, mentions_day_ago=0.0, contract_ttm=5.0, contract_prior=-1.0, last_report_day=date(2024, 3, 31), last_report_estimated=1.0, last_report_filed=date(2024, 4, 20), next_report_day=date(2024, 5, 11), quarters=4.0, beats=3.0)
    m = flat_metrics(spark.createDataFrame([row])).first()
    assert (m.interest_coverage, m.net_debt_to_ebitda, m.fcf_yield, m.fcf_positive, m.pe_ttm, m.pe_vs_history) == (10.0, None, -0.02, False, 20.0, 0.5)
    assert m.ebit_ev_yield == pytest.approx(50 / 1200) and m.short_pct_outstanding is None and m.short_interest_rising is None and m.days_to_cover is None and m.short_data_age_days == 16
    assert (m.social_rising, m.social_delta, m.contract_growth, m.days_since_report, m.days_to_report, m.beat_rate) == (True, None, None, 11, 10, 0.75)
    given = flat_metrics(spark.createDataFrame([{**row, "interest_coverage": 3.0, "roic": 0.2, "ebitda": 50.0, "last_report_estimated": 0.0}])).first()
    assert (given.interest_coverage, given.roic, given.net_debt_to_ebitda, given.days_since_report) == (3.0, 0.2, 4.0, 31)
