"""Long trailing windows by running aggregates: against plain sums at every length, and no long frame slides in a plan."""

from __future__ import annotations

import random
import re
from datetime import date
from statistics import fmean, stdev

import pytest
from pyspark.sql import functions as F

from stockloom.operators import prices as P


def test_trailing_windows(spark):
    r = random.Random(5)
    rows = [(t, date.fromordinal(730000 + 2 * i), None if r.random() < holes else round(r.uniform(10, 90), 4)) for t, n, holes in (("A", 23, 0), ("B", 7, 0), ("C", 40, 0.2), ("D", 1, 0), ("E", 8, 1)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "ticker string, d date, close double")
    for n in (1, 2, 7, 8):
        got = {(x.ticker, x.d): x for x in P.trailing(df, n, mean=("close", "mean"), sd=("close", "deviation"), top=("close", "top")).collect()}
        assert len(got) == len(rows)
        for t in "ABCDE":
            own = sorted((d, c) for k, d, c in rows if k == t)
            for i, (d, _) in enumerate(own):
                held, x = [c for _, c in own[max(0, i - n + 1) : i + 1] if c is not None], got[t, d]
                assert x.top == (max(held) if held else None)
                assert x.mean == (pytest.approx(fmean(held)) if len(held) >= n else None)
                assert x.sd == (pytest.approx(stdev(held)) if len(held) >= 2 else None)


def test_flat_after_lively(spark):
    closes = [100.0 + i * 37 % 23 for i in range(300)] + [55.0] * 300
    df = spark.createDataFrame([("A", date.fromordinal(730000 + i), c) for i, c in enumerate(closes)], "ticker string, d date, close double")
    last = P.features(df).orderBy(F.desc("d")).first()
    assert (last.vol, last.vol_126, last.vol_scaled, last.over_200) == (0.0, 0.0, None, 0.0)


@pytest.mark.parametrize("name", ["ts01_sma", "ts04_volatility", "ts08_vol_scaled_momentum", "ts11_feature_panel", "sc23b_screen_from_tables"])
def test_no_long_frame_slides(spark, name):
    from stockloom import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all(int(n) < 32 for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan))


def test_dates_are_sent_to_rows(spark):
    spark_rows = [("A", date(2020, 1, 1), 1.0, 0), ("A", date(2020, 1, 1), 2.0, 1), ("B", date(2020, 1, 2), 3.0, 0), ("B", date(2020, 1, 3), 4.0, 0)]
    a = spark.createDataFrame(spark_rows, "ticker string, d date, close double, pos int")
    joined = P.join_on_dates(a, a.where("d < '2020-01-03'").drop("ticker"))
    assert sorted(map(tuple, joined.select("ticker", "d", "close_a", "close_b").collect())) == [("A", date(2020, 1, 1), 1.0, 2.0), ("B", date(2020, 1, 2), 3.0, 3.0)]
    assert "strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()
