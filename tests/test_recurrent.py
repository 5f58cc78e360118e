"""The recurrent network: gradients, training that tasks share, and its way through the walk."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import features, recurrent, score, splits, walk

START = dt.datetime(2022, 1, 1)


def test_gradients_are_those_of_finite_differences():
    plan, rng = recurrent.Plan(hidden=5), np.random.default_rng(1)
    x, y = rng.normal(size=(6, 7, 4)), rng.normal(size=(6, 3))
    w = recurrent.begun(4, 3, plan) * 2
    mask = (rng.random((6, 5)) > 0.2) / 0.8
    found = recurrent.gradient(w, x, y, plan, mask, 0.1)

    def loss(w):
        p = recurrent.parts_of(w, 4, 5, 3)
        return 0.1 * ((((recurrent.run(p, x)[0] * mask) @ p["head"] + p["bias"]) - y) ** 2).sum()

    step = 1e-5 * np.eye(len(w))
    assert np.allclose(found, [(loss(w + e) - loss(w - e)) / 2e-5 for e in step], atol=1e-7)


def test_state_by_state():
    """The layer by loops over rows and units."""
    plan, rng = recurrent.Plan(hidden=3), np.random.default_rng(2)
    x, w = rng.normal(size=(4, 5, 2)), recurrent.begun(2, 1, plan)
    p = recurrent.parts_of(w, 2, 3, 1)
    s = lambda v: 1 / (1 + np.exp(-v))
    for row in range(4):
        h, c = np.zeros(3), np.zeros(3)
        for t in range(5):
            z = x[row, t] @ p["wx"] + p["bx"] + h @ p["wh"] + p["bh"]
            c = s(z[3:6]) * c + s(z[:3]) * np.tanh(z[6:9])
            h = s(z[9:]) * np.tanh(c)
        assert np.allclose(recurrent.predict(w, x, plan, 1)[row], h @ p["head"] + p["bias"])


FOLDS = (dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
SMALL = recurrent.Plan(hidden=6, batch=64, piece=8, epochs=3, rate=0.02, patience=3)


def rows(spark, n=150, bars=6):
    rng = np.random.default_rng(3)
    data = []
    for fold in FOLDS:
        for i in range(n):
            window = rng.normal(size=(bars, 4))
            data.append((fold, "fit" if i < n * 0.8 else "cal", f"a{i % 3}", START + dt.timedelta(days=i), [tuple(map(float, v)) for v in window], float(np.tanh(window[-1, 0]) - window[-2, 1] / 2), float(window[:, 2].mean())))
    return spark.createDataFrame(data, "fold timestamp_ntz, part string, asset string, date timestamp_ntz, window array<struct<r: double, ar: double, rng: double, dv: double>>, t1 double, t2 double").repartition(5)


def test_weights_are_the_same_for_one_task_and_four(spark):
    df = rows(spark)
    one, four = (recurrent.networks(df, ["t1", "t2"], SMALL, limit, tasks) for limit, tasks in ((1000, 1), (0, 4)))
    assert set(one) == set(FOLDS) == set(four)
    for fold in FOLDS:
        for a, b in zip(one[fold], four[fold], strict=True):
            assert np.array_equal(a, b)


def test_training_goes_on_from_its_last_epoch(tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(64, 5, 4)), rng.normal(size=(64, 2))
    fit = {k: (x[8 * k : 8 * k + 8], y[8 * k : 8 * k + 8]) for k in range(6)}
    valid = {k - 6: (x[8 * k : 8 * k + 8], y[8 * k : 8 * k + 8]) for k in (6, 7)}
    whole = recurrent.train(fit, valid, 48, 16, (4, 2), SMALL, recurrent.alone)
    states = recurrent.States(str(tmp_path))
    calls = []

    def fails(own):
        calls.append(1)
        if len(calls) == 8:
            raise RuntimeError("lost")
        return recurrent.alone(own)

    with pytest.raises(RuntimeError, match="lost"):
        recurrent.train(fit, valid, 48, 16, (4, 2), SMALL, fails, states)
    assert states.last()["epoch"] == 2
    again = recurrent.train(fit, valid, 48, 16, (4, 2), SMALL, recurrent.alone, states)
    assert np.array_equal(whole[0], again[0]) and whole[1:] == again[1:]


def test_training_learns_and_stops_early():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8, 4))
    y = np.stack([np.tanh(x[:, -1, 0]) + 0.5 * x[:, -2, 1], x[:, :, 2].mean(1)], 1)
    cut = lambda lo, hi: {k - lo // 50: (x[50 * k : 50 * k + 50], y[50 * k : 50 * k + 50]) for k in range(lo // 50, hi // 50)}
    w, epochs, loss = recurrent.train(cut(0, 500), cut(500, 600), 500, 100, (4, 2), recurrent.Plan(hidden=12, batch=50, piece=50, rate=0.01, epochs=60, patience=8), recurrent.alone)
    assert loss < 0.35 * y[500:].var() and np.isclose(((recurrent.predict(w, x[500:], recurrent.Plan(hidden=12), 2) - y[500:]) ** 2).mean(), loss)
    noise = recurrent.train(cut(0, 500), {0: (x[500:], rng.normal(size=(100, 2)))}, 500, 100, (4, 2), recurrent.Plan(hidden=12, batch=50, piece=50, rate=0.01, epochs=60, patience=3), recurrent.alone)
    assert noise[1] < 60


def test_network_in_the_walk(spark):
    """z-table and scores follow; what the test rows say changes no weight, nor do later bars a window."""
    rng = np.random.default_rng(6)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 640)))
    data = [("BTC", START + dt.timedelta(days=i), p, p * 1.01, p * 0.99, p, 10.0 + i % 5) for i, p in enumerate(price.tolist())]
    panel = spark.createDataFrame(data, "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    ready = walk.feature_frame(panel).cache()
    folds = splits.fold_calendar(ready, "2023-01-01").where("fold < '2024-01-01'")
    parts = walk.parts(ready, folds, ["vol_21d"]).cache()
    plan = recurrent.Plan(hidden=4, batch=64, piece=64, epochs=2)
    windows = features.lookback_windows(panel)
    long = walk.lstm(parts, windows, plan=plan).cache()
    assert long.where("part = 'test'").count() == 7 * parts.where("part = 'test'").count() > 0
    assert long.where("sigma <= 0 or sigma > 0.3 or sigma is null").count() == 0
    found = score.score(walk.predictions(long)).collect()
    assert len(found) == 1 and 40 < found[0]["coverage"] <= 100
    worse = parts
    for h in features.HORIZONS:
        worse = worse.withColumn(f"rv{h}", F.when(F.col("part") == "test", F.lit(0.2)).otherwise(F.col(f"rv{h}")))
    a, b = (sorted((str(r["date"]), r["h"], r["sigma"]) for r in walk.lstm(p, windows, plan=plan).collect()) for p in (parts, worse))
    assert a == b
