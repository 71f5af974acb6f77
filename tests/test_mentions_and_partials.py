"""Mention deltas on a stream in parcels against the batch form, and the data source of partial records."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stockloom.operators import merge
from stockloom.sources.partials import partial_records
from stockloom.streaming import operators as O
from stockloom.streaming.mentions import mention_delta


def test_parcels_with_late_rows(spark, tmp_path):
    r, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(r.randrange(4), start + timedelta(hours=r.randrange(24 * 20))) for _ in range(300)]
    parcels = [[], [], [], []]
    for t, ts in rows:
        day = (ts - start).days
        parcels[min(3, day // 5 + (r.random() < 0.3 and day % 5 > 2))].append((t, ts))  # some a parcel late
    parcels[3].append((-1, start + timedelta(days=90)))
    src = str(tmp_path / "in")
    for parcel in parcels:
        spark.createDataFrame(parcel, "ticker long, ts timestamp").write.mode("append").parquet(src)
        got = O.run_once(mention_delta(spark.readStream.schema("ticker long, ts timestamp").parquet(src), "9 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    daily = spark.createDataFrame(rows, "ticker long, ts timestamp").groupBy("ticker", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    want = O.mention_delta(daily).select("ticker", "day", "c", "delta")
    assert sorted(map(str, got.where("ticker >= 0").collect())) == sorted(map(str, want.collect()))


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    start, src = datetime(2024, 1, 1), str(tmp_path / "in")
    for hours in ([1, 30, 24 * 9], [2, 24 * 9 + 1], [24 * 40]):  # hour 2 of the first day comes after that day is closed
        spark.createDataFrame([(7, start + timedelta(hours=h)) for h in hours], "ticker long, ts timestamp").write.mode("append").parquet(src)
        got = O.run_once(mention_delta(spark.readStream.schema("ticker long, ts timestamp").parquet(src)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((str(x.day), x.c, x.delta) for x in got.collect()) == [("2024-01-01", 1, None), ("2024-01-02", 1, 0), ("2024-01-10", 2, None)]


def test_partial_records(spark, tmp_path):
    for name, lines in {"vendor": [{"ticker": "a", "price": 5}, {"ticker": "b", "price": "x", "staff": 3}, {"price": 1.0}, 7], "filings": [{"ticker": "A", "price": 4.5, "staff": 9, "error": "late"}]}.items():
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / "deep" / "part-0.json").write_text("\n".join(map(json.dumps, lines)) + ("\n{broken\n\n" if name == "vendor" else ""))
        (tmp_path / name / "_SUCCESS").write_text("")
    fields = "price double, staff bigint"
    vendor, filings = (partial_records(spark, str(tmp_path / n), n, fields) for n in ("vendor", "filings"))
    assert vendor.columns == ["ticker", "source", "error", "price", "staff"]
    assert sorted(map(str, map(tuple, vendor.collect()))) == sorted(map(str, [("A", "vendor", None, 5.0, None), ("B", "vendor", "wrong kind: price", None, 3), (None, "vendor", "unreadable line", None, None)]))
    assert [tuple(r) for r in filings.collect()] == [("A", "filings", "late", 4.5, 9)]
    both = merge.merge_fields(merge.ranked_sources(vendor.unionByName(filings).where("ticker is not null"), ["vendor", "filings"]), "ticker", ["price", "staff"])
    assert {r.ticker: (r.price, r.staff, list(r.sources)) for r in both.collect()} == {"A": (5.0, 9, ["filings", "vendor"]), "B": (None, 3, ["vendor"])}
    assert partial_records(spark, str(tmp_path / "nothing"), "none", fields).count() == 0
