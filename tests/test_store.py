"""Stores: nothing but the saved record changes; captures, refusals and facts are the same in one parcel or in several."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.sources import store
from stockloom.streaming import operators as O

ROW = "ticker string, day date, x int"


def rows(spark, *cells):
    return spark.createDataFrame([(t, date.fromisoformat(d), x) for t, d, x in cells], ROW)


def test_saving_one_name_keeps_the_others(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.latest_snapshots(spark, root)
    assert store.captured_days(spark, root).count() == 0
    store.save_snapshots(rows(spark, ("A", "2025-01-01", 1), ("B", "2025-01-01", 2)), root)
    store.save_snapshots(rows(spark, ("A", "2025-01-01", 3)), root)  # the same day, one name
    store.save_snapshots(rows(spark, ("A", "2025-01-02", 4)), root)
    assert {(r.ticker, r.x) for r in store.snapshots(spark, root, "2025-01-01").collect()} == {("A", 3), ("B", 2)}
    assert {(r.ticker, str(r.day), r.x) for r in store.latest_snapshots(spark, root).collect()} == {("A", "2025-01-02", 4), ("B", "2025-01-01", 2)}
    assert store.captured_days(spark, root).count() == 3
    store.save_snapshots(rows(spark), root)  # nothing to save
    assert store.snapshots(spark, root).count() == 3


def test_an_interrupted_save_leaves_the_old_record(spark, tmp_path):
    root = str(tmp_path / "s")
    store.save_snapshots(rows(spark, ("A", "2025-01-01", 1)), root)
    broken = rows(spark, ("A", "2025-01-01", 2)).withColumn("x", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.save_snapshots(broken, root)
    assert [r.x for r in store.latest_snapshots(spark, root).collect()] == [1]


def test_a_version_written_twice_counts_once(spark, tmp_path):
    root = str(tmp_path / "s")
    for x in (1, 2):
        store.save_snapshots(rows(spark, ("A", "2025-01-01", x)), root, version=7)
    assert [r.x for r in store.records(spark, f"{root}/records").collect()] == [2]


def test_accumulate(spark, tmp_path):
    root, today = str(tmp_path / "s"), "2025-03-01"
    schema = "ticker string, day date, a double, b double, c double"
    d, old = date(2025, 3, 1), date(2025, 2, 28)
    one = spark.createDataFrame([("FULL", d, 1.0, 1.0, None), ("THIN", d, None, None, 3.0), ("VOID", d, None, None, None), ("OLD", old, 1.0, 1.0, None), ("NONE", None, None, None, None)], schema)
    told = lambda df: {r.ticker: r.outcome for r in df.collect()}
    assert told(store.accumulate(one, root, today, ["a", "b"], ["c"])) == {"FULL": "captured", "THIN": "thin", "VOID": "failed", "OLD": "failed", "NONE": "failed"}
    two = spark.createDataFrame([("FULL", d, 9.0, 9.0, None), ("LATE", d, 1.0, None, None), ("LOW", d, None, None, 3.0)], schema)
    assert told(store.accumulate(two, root, today, ["a", "b"], ["c"], floor=0.5)) == {"FULL": "skipped", "LATE": "captured", "LOW": "gated"}
    assert {r.ticker: r.a for r in store.snapshots(spark, root, today).collect()} == {"FULL": 1.0, "THIN": None, "LATE": 1.0}
    assert told(store.accumulate(two.where("ticker = 'FULL'"), root, today, ["a", "b"], force=True)) == {"FULL": "captured"}
    assert {r.a for r in store.snapshots(spark, root, today).where("ticker = 'FULL'").collect()} == {9.0}
    log = {r.attempted: r for r in store.runs(spark, root).collect()}
    assert (log[5].captured, log[5].thin, log[5].failed, log[5].mean_coverage) == (1, 1, 3, 0.5) and (log[3].skipped, log[3].gated) == (1, 1)


def news(spark, cells):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(t, i, start + timedelta(hours=h), "e", 0.0, (start + timedelta(hours=h)).date()) for t, i, h in cells], f"{O.NEWS}, day date")


def kept(spark, place):
    return sorted((r.ticker, str(r.day), r.event_id) for r in store.records(spark, f"{place}/records").collect())


def test_capture_in_parcels_is_capture_at_once(spark, tmp_path):
    cells = [(k % 3, k, 5 * k) for k in range(60)]
    parcels = [cells[:30], [*cells[20:45], (0, 900, 3)], [*cells[45:], *cells[:10]]]  # replayed rows, and late ones
    src, today = str(tmp_path / "in"), "2024-01-04"
    for parcel in parcels:
        news(spark, parcel).write.mode("append").parquet(src)
        O.captured(spark.readStream.schema(f"{O.NEWS}, day date").parquet(src), str(tmp_path / "many"), str(tmp_path / "c1"), today, ["ts", "event_id"])
    store.capture(news(spark, [c for p in parcels for c in p]), str(tmp_path / "once"), today, ["ts", "event_id"], 0)
    assert kept(spark, tmp_path / "many") == kept(spark, tmp_path / "once")
    late = lambda at: sorted(r.event_id for r in store.rejects(spark, str(tmp_path / at)).collect())
    assert late("many") == late("once") == [*range(15), 900]
    runs = store.runs(spark, str(tmp_path / "many")).collect()
    assert len(runs) == 3 and all(r.attempted == r.captured + r.skipped + r.failed for r in runs)
    store.capture(news(spark, parcels[1]), str(tmp_path / "many"), today, ["ts", "event_id"], 1)  # the second batch is replayed
    assert kept(spark, tmp_path / "many") == kept(spark, tmp_path / "once")
    store.capture(news(spark, []), str(tmp_path / "none"), today, ["ts", "event_id"], 0)
    assert store.rejects(spark, str(tmp_path / "none")) is None


def test_facts_keep_their_past(spark, tmp_path):
    root, schema = str(tmp_path / "f"), "cik long, tag string, fy_end date, filed date, val double"
    day = date.fromisoformat
    fact = lambda c, filed, v: (c, "R", day("2020-12-31"), day(filed), v)
    first = spark.createDataFrame([fact(1, "2021-02-01", 10.0), fact(2, "2021-02-01", 20.0)], schema)
    later = spark.createDataFrame([fact(1, "2022-02-01", 11.0), fact(1, "2022-02-01", 12.0), fact(3, "2022-03-01", 30.0)], schema)
    store.extend_facts(first, root, 0)
    before = sorted(map(tuple, store.facts_known(spark, root, "2021-06-01").collect()))
    store.extend_facts(later, root, 1)
    assert sorted(map(tuple, store.facts_known(spark, root, "2021-06-01").collect())) == before
    assert {(r.cik, r.val) for r in store.facts_known(spark, root, "2022-02-01").collect()} == {(1, 11.0), (2, 20.0)}
    store.extend_facts(later, root, 1)  # replayed
    got = sorted((r.cik, str(r.known_from), str(r.known_to), r.version_of_fact, r.val) for r in store.facts_known(spark, root).collect())
    assert got == [(1, "2021-02-01", "2022-02-01", 1, 10.0), (1, "2022-02-01", "None", 2, 11.0), (2, "2021-02-01", "None", 1, 20.0), (3, "2022-03-01", "None", 1, 30.0)]
