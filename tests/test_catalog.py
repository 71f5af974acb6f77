"""Queries run on the smallest tables and agree with DuckDB; a sample of families keeps the suite short."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()
NAMES = ["bt00_momentum_ic", "bt05_spearman_ic", "bt08_quantile_spread", "jn02_as_of_close", "jn03_nearest_day", "ts10_residual_momentum", "fn06_six_tests", "sc19_ranked_screen", "pit01_annual_series", "jn06_field_merge", "jn15_resolve_ticker", "ev01_insider_flow", "ev06_new_positions", "ev12_news_volume", "tx02_year_over_year", "tx10_grounded", "pf03_measure_rows", "ds06_finished", "st04_stories"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    from stockloom import catalog

    df = catalog.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [list(got.columns).index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=key)
    assert ours == theirs


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
