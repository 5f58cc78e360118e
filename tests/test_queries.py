"""Queries against their SQL in DuckDB. PANELSPARK_ALL=1 runs all of them, else a sample of each kind."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.queries.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
SAMPLE = ["src5_ohlcv_ingest", "src11_universe_top_n", "wn4_volatility", "wn15_forward_volatility", "wn27_lookback_windows", "jn9_origins_anti", "bt5_calibration_split", "ag5_score", "ag9_metric_tables", "ag18_gap_statistics", "wn24_volume_z96", "bt14_cv_forecasts", "stream_bars"]
NAMES = sorted(SQL) if os.environ.get("PANELSPARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "lineitem", "events", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    rows = lambda x: sorted(tuple("" if v is None or v != v else str(v)[:19] if hasattr(v, "year") else str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in x[sorted(a.columns)].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and 60 < row[0]["coverage"] < 95


def test_fold_sizes(spark):
    found = {(str(r["fold"])[:4], r["part"]): r["rows"] for r in QUERIES["bt5_calibration_split"](spark, DIR).collect()}
    assert set(found) == {(y, p) for y in ("1998", "1999", "2000", "2001") for p in ("fit", "cal")}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
