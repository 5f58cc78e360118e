"""Windows over blocks give the columns of windows over whole series, and a long series spreads."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import blocks, features, intraday, walk

START = dt.datetime(2020, 1, 1)
PRICES = "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double"


def panel(spark, sizes, step=dt.timedelta(days=1), seed=4, gaps=0.0):
    """Series of given lengths, with null, zero and equal prices, and volumes of 0."""
    rng = np.random.default_rng(seed)
    rows = []
    for asset, n in sizes.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            if 0 < i < n - 1 and rng.random() < gaps:
                continue
            c = None if gaps == 0 and i % 97 == 50 else 0.0 if gaps == 0 and i % 89 == 40 else float(close[i])
            rows.append((asset, START + i * step, c, None if c is None else c * 1.01, None if c is None else c * 0.99, c, float(i % 7)))
    return spark.createDataFrame(rows, PRICES).repartition(5)


def same(a, b, keys=("asset", "date")):
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (x.select(*keys, *sorted(set(x.columns) - set(keys))).toPandas() for x in (a, b))
    a, b = (x.sort_values(list(keys), na_position="first", ignore_index=True) for x in (a, b))
    assert len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=1e-8, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].isna() == b[c].isna()).all() and (a[c] == b[c])[a[c].notna()].all(), c


SIZES = {"A": 700, "B": 64, "C": 1, "D": 128, None: 131, "E": 65}


@pytest.mark.parametrize("rows", [64, 67, 1000])
def test_daily_features(spark, rows):
    p = panel(spark, SIZES)
    same(features.daily_features(p, rows).drop("pos"), features.daily_features(p))


def test_feature_frame(spark):
    p = panel(spark, {k: v for k, v in SIZES.items() if k})
    funding = p.select("asset", "date", (F.col("volume") / 7).alias("funding_sum"))
    same(walk.feature_frame(p, "A", funding, 64), walk.feature_frame(p, "A", funding))


def test_intraday_features(spark):
    bars = panel(spark, {"A": 2500, "B": 700, "C": 3}, dt.timedelta(minutes=15), gaps=0.2)
    grid = intraday.complete_grid(bars)
    cut = intraday.complete_grid(bars, block_rows=700)
    same(cut.drop("pos"), grid)
    same(intraday.intraday_features(cut, 700), intraday.intraday_features(grid))
    same(intraday.gap_runs(cut, 50).drop("pos"), intraday.gap_runs(grid))


def test_values_are_carried_over_whole_blocks_of_nulls(spark):
    rows = [("A", START + dt.timedelta(days=i), 5.0 if i == 3 else None, 1.0 * i if i % 10 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "asset string, date timestamp_ntz, x double, y double").repartition(3)
    got = {r["pos"]: (r["last_x"], r["last_y"]) for r in blocks.carried(df, ["x", "y"], 4).collect()}
    assert got == {i: (5.0 if i >= 3 else None, 10.0 * (i // 10)) for i in range(100)}


def test_a_long_series_spreads(spark):
    p = panel(spark, {"A": 4000})
    whole, cut = features._daily(p), blocks.blocked(p, features._daily, back=64, rows=100)
    most = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("vol_63d")).collect())
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert most(whole) == 4000 and most(cut) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert blocks.block_rows(p, 1999) == 1999 and blocks.block_rows(p, 2000) is None


def test_blocks_hold_their_frames(spark):
    with pytest.raises(ValueError, match="frames"):
        features.daily_features(panel(spark, {"A": 5}), 10)


def test_no_rows(spark):
    assert features.daily_features(panel(spark, {"A": 5}).where("false"), 64).count() == 0
