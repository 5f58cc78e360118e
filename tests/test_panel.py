"""Literal expectations, metamorphic checks and error contracts of the panel operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import exprs
from panelspark.operators import boosting, calibrate, ensemble, features, intraday, models, report, score, splits, validate, walk
from panelspark.schemas import OHLCV, PREDICTIONS
from panelspark.sources import ingest

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def ramp(spark, n=100, skip=()):
    rows = []
    for a, asset in enumerate(("BTC", "ETH")):
        for i in range(n):
            if (asset, i) not in skip:
                v = float(i + 100 + 50 * a)
                rows.append((asset, START + i * DAY, v, v + 2, v - 1, v + 1, float(i + 1000 + 100 * a)))
    return spark.createDataFrame(rows, OHLCV)


def prediction(**changes):
    row = {"model": "xgb", "asset": "BTC", "origin": dt.datetime(2025, 1, 1), "fold": dt.datetime(2025, 1, 1), "h": 1, "y": 101.0, "last": 100.0, "sigma": 0.02, "rv": 0.018, "regime_driver": 0.02, "q10": 95.0, "q50": 100.0, "q90": 105.0}
    return tuple((row | changes).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PREDICTIONS)


def test_null_and_zero_rules(spark):
    r = spark.sql("select 0D a, cast(null as double) n, -1D m, double('NaN') x").select(exprs.safe_ln("a").alias("a"), exprs.safe_ln("m").alias("b"), exprs.safe_div("m", "a").alias("c"), exprs.floor_at("n", 1e-6).alias("d"), exprs.clip_sigma("n").alias("e"), exprs.clip_sigma("x").alias("f"), exprs.clip_sigma(F.lit(9.0)).alias("g")).first()
    assert tuple(r) == (None, None, None, None, 1e-4, 1e-4, 0.3)


def test_labels_follow_the_assets_own_rows(spark):
    rows = features.with_labels(features.with_return(ramp(spark, 20, {("ETH", 8)}))).where("asset = 'ETH'").orderBy("date").collect()
    dates = [r["date"] for r in rows]
    for i, r in enumerate(rows):
        for h in features.HORIZONS:
            assert r[f"label_end{h}"] == (dates[i + h] if i + h < len(dates) else None)


def test_rolling_matches_numpy(spark):
    rows = features.daily_features(ramp(spark)).where("asset = 'BTC'").orderBy("date").collect()
    close = np.arange(100) + 101.0
    lr = np.diff(np.log(close))
    assert rows[20]["vol_21d"] is None and rows[4]["ret_5d"] is None
    for i in (30, 80):
        assert math.isclose(rows[i]["vol_21d"], lr[i - 21 : i].std(ddof=1), rel_tol=1e-9)
        assert math.isclose(rows[i]["ret_5d"], lr[i - 5 : i].sum(), rel_tol=1e-9)
        assert math.isclose(rows[i]["naive_mae"], 1.0) and rows[i]["ret_lag1"] == rows[i]["lr"]
        assert math.isclose(rows[i]["har_5d"], math.log(math.sqrt((lr[i - 5 : i] ** 2).mean())), rel_tol=1e-9)
    assert rows[70]["drawdown_63d"] == 0


def test_long_sums_are_rolling_sums(spark):
    df = ramp(spark).withColumn("x", F.when(F.day("date") % 9 > 0, F.sin("close")))
    both = exprs.long_sums(df, {"fast": ("x", 7)}).withColumn("slow", exprs.rolling(F.sum, "x", 7))
    assert both.where("(fast is null) <> (slow is null) or abs(fast - slow) > 1e-9").count() == 0 and both.where("fast is null").count() > 20


def test_later_prices_leave_earlier_features_alone(spark):
    panel, until = ramp(spark), F.lit(START + 70 * DAY).cast("timestamp_ntz")
    worse = panel.withColumn("close", F.when(F.col("date") >= until, F.col("close") * 3).otherwise(F.col("close")))
    cols = features.feature_columns(features.daily_features(panel).columns)
    assert features.altered(features.daily_features(panel), features.daily_features(worse), until, cols).count() == 0
    a, b = (features.with_labels(features.with_return(x)) for x in (panel, worse))
    assert features.altered(a, b, until, ["y1"]).count() > 0


def test_groups_cover_every_feature(spark):
    cols = features.feature_columns(features.daily_features(ramp(spark)).columns)
    groups = features.feature_groups(cols)
    assert sorted(c for g in groups.values() for c in g) == sorted(cols) and "vol_ratio" in groups["volatility"] and not any(c.startswith("har_") for c in cols)
    with pytest.raises(ValueError, match="every column once"):
        features.feature_groups([*cols, "other"])


def test_purge_keeps_a_label_that_ends_on_the_boundary(spark):
    rows = features.with_labels(features.with_return(ramp(spark, 30)))
    edge = F.lit(START + 20 * DAY).cast("timestamp_ntz")
    last = rows.where(splits.purged([f"label_end{h}" for h in features.HORIZONS], edge)).agg(F.max("date")).first()[0]
    assert last == START + 13 * DAY


def test_calibration_parts_do_not_meet(spark):
    rows = features.with_labels(features.with_return(ramp(spark, 90))).withColumn("fold", F.lit(START + 85 * DAY).cast("timestamp_ntz"))
    split = splits.split_calibration(rows.where(splits.purged([f"label_end{h}" for h in features.HORIZONS], F.col("fold"))))
    fit, cal = (split.where(F.col("part") == p).agg(F.max("label_end7"), F.min("date")).first() for p in ("fit", "cal"))
    assert fit[0] <= cal[1]


def test_pinball_percent_is_scaled_row_by_row(spark):
    rows = frame(spark, *(prediction(model="m", y=100.0, last=x, q10=110.0, q50=110.0, q90=110.0, asset=str(x)) for x in (100.0, 1000.0)))
    assert math.isclose(score.score(rows).first()["pinball_%"], 2.75)


def test_metric_tables(spark):
    rows = frame(spark, prediction(), prediction(asset="ETH", y=110.0))
    found = {(r["grain"], r["asset"]): r["coverage"] for r in score.metric_tables(rows).collect()}
    assert found[("overall", None)] == 50 and found[("asset", "BTC")] == 100 and found[("asset", "ETH")] == 0


def test_regimes_ignore_outcomes(spark):
    rows = [prediction(asset=a, regime_driver=d, y=y, h=h) for a, d in (("A", 0.01), ("B", 0.02), ("C", 0.03)) for h in (1, 2) for y in (1.0,)]
    for changed in (rows, [tuple(50.0 if i == 5 else v for i, v in enumerate(r)) for r in rows]):
        assert {(r["asset"], r["regime"]) for r in score.with_regimes(frame(spark, *changed)).collect()} == {("A", "low"), ("B", "medium"), ("C", "high")}


def test_point_baselines(spark):
    flat = spark.createDataFrame([("T", START + i * DAY, 100.0, 100.0, 100.0, 100.0, 1.0) for i in range(200)], OHLCV)
    assert all(r["MAE"] == 0 for r in score.report(models.point_baselines(flat)).collect())
    mae = {r["model"]: r["MAE"] for r in score.report(models.point_baselines(ramp(spark, 200))).collect()}
    assert mae["drift"] < mae["flat"] and mae["drift"] < 1e-9
    trend = score.report(models.trend_forecasts(ramp(spark, 200))).first()
    assert trend["MAE"] < 1e-6


def test_blend_by_key_not_by_position(spark):
    left = frame(spark, prediction(asset="BTC", sigma=0.02), prediction(asset="ETH", q10=190.0, q50=200.0, q90=210.0, sigma=0.04))
    right = frame(spark, prediction(model="lgbm", asset="ETH", q10=194.0, q50=204.0, q90=214.0, sigma=0.06), prediction(model="lgbm", asset="BTC", q10=97.0, q50=102.0, q90=107.0, sigma=0.04))
    got = {r["asset"]: (r["q50"], round(r["sigma"], 6)) for r in ensemble.blend(left, right, 0.25).collect()}
    assert got == {"BTC": (101.5, 0.035), "ETH": (203.0, 0.055)}
    for bad in (right.where("asset = 'BTC'"), right.withColumn("y", F.col("y") + 1)):
        with pytest.raises(ValueError, match="do not align"):
            ensemble.blend(left, bad, 0.5)
    with pytest.raises(ValueError, match="between 0 and 1"):
        ensemble.blend(left, right, 1.5)


def test_weight_ties_go_to_the_middle(spark):
    one = frame(spark, prediction(), prediction(asset="ETH"))
    assert ensemble.select_weight(one, one, [0.0, 0.25, 0.75, 1.0]).first()["weight"] == 0.25
    with pytest.raises(ValueError, match="no weights"):
        ensemble.select_weight(one, one, [])


def test_z_table_and_bands(spark):
    y = np.linspace(-0.3, 0.5, 40)
    rows = spark.createDataFrame([("f", "m", 4, float(v), 0.1) for v in y] + [("f", "m", 4, 1.0, 0.0)], "fold string, model string, h int, y double, sigma double")
    z = calibrate.z_table(rows)
    assert np.allclose(tuple(z.first())[3:], np.quantile(y / 0.2, [0.1, 0.5, 0.9])) and calibrate.crossed(z).count() == 0
    out = calibrate.bands(spark.createDataFrame([("f", "m", 4, 100.0, 0.1)], "fold string, model string, h int, last double, sigma double"), z).first()
    assert math.isclose(out["q90"], 100 * math.exp(np.quantile(y, 0.9)))


def test_one_sided_widening_never_tightens(spark):
    rows = spark.createDataFrame([(h, float(y), 101.0, 102.0, 104.0) for h in (1, 2) for y in range(96, 106)], "h int, y double, q10 double, q50 double, q90 double")
    m = {r["h"]: (r["lower"], r["upper"]) for r in calibrate.one_sided_margins(rows).collect()}
    low, high = np.log(101 / np.arange(96, 106)), np.log(np.arange(96, 106) / 104)
    level = min(1.0, math.ceil(11 * 0.9) / 10)
    assert np.allclose(m[1], [max(0, np.quantile(x, level, method="higher")) for x in (low, high)])
    wide = calibrate.widen(rows.withColumn("model", F.lit("m")), calibrate.one_sided_margins(rows))
    assert wide.where("q10 > 101 or q90 < 104 or q50 <> 102").count() == 0


def test_linear_fits_are_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) / 10
    rows = spark.createDataFrame([("k", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [("k", None, 1.0, 1.0, 1.0)], "g string, a double, b double, c double, y double")
    fit = models.linear_fits(rows, ["g"], ["a", "b", "c"], "y").first()
    want = np.linalg.lstsq(np.c_[np.ones(60), x], y, rcond=None)[0]
    assert np.allclose([fit["intercept"], *fit["coefficients"]], want)
    ridge = models.linear_fits(rows, ["g"], ["a", "b", "c"], "y", alpha=1.0).first()
    c, d = x - x.mean(0), y - y.mean()
    assert np.allclose(ridge["coefficients"], np.linalg.solve(c.T @ c + np.eye(3), c.T @ d))


def test_predictors_fall_back_to_the_last_price(spark):
    def fails(history):
        raise ValueError

    found = models.walk_forward(ramp(spark), fails).collect()
    assert found and all(r["yhat"] == r["last"] for r in found)


def test_garch_leaves_out_an_asset_that_does_not_move(spark):
    from panelspark.operators import walk

    r = np.random.default_rng(2).normal(size=260) / 50
    closes = {"M": 100 * np.exp(np.cumsum(r)), "F": np.full(260, 7.0)}
    days = [START + i * DAY for i in range(260)]
    panel = spark.createDataFrame([(a, t, float(c)) for a, cs in closes.items() for t, c in zip(days, cs, strict=True)], "asset string, date timestamp_ntz, close double")
    ends = {f"label_end{h}": F.col("date") + F.make_dt_interval(days=F.lit(h)) for h in range(1, 8)}
    ready = {f"{k}{h}": F.lit(0.01) for k in ("y", "rv") for h in range(1, 8)}
    part = F.when(F.col("date") < days[240], "fit").otherwise("test")
    rows = panel.withColumns({"fold": F.lit(days[240]), "part": part, "vol_21d": F.lit(0.02), **ends, **ready})
    found = walk.garch(rows, panel).where("part = 'test'").toPandas()
    assert set(found["asset"]) == {"M"} and len(found) == 20 * 7 and found["sigma"].between(0.005, 0.1).all()


def test_garch_reacts_to_large_returns():
    r = np.random.default_rng(1).normal(size=400)
    omega, a, b = models.garch_fit(r)
    assert omega > 0 and a > 0 and a + b < 1
    r[-1] = 8.0
    v = models.garch_filter(r, omega, a, b)
    assert v[-1] > v[-2]


def bars(spark, skip=()):
    rows = []
    for a, asset in enumerate(("BTC", "ETH")):
        for i in range(4):
            if i not in skip:
                c = 100.0 + 50 * a + i
                rows.append((asset, dt.datetime(2026, 1, 1) + i * dt.timedelta(minutes=15), c - 0.2, c + 0.5, c - 0.5, c, 10.0 + i))
    return spark.createDataFrame(rows, OHLCV)


def test_gap_is_filled_with_the_last_close(spark):
    grid = intraday.complete_grid(bars(spark, {2}))
    gap = grid.where("asset = 'BTC' and missing_bar = 1").collect()
    assert len(gap) == 1 and gap[0]["open"] == gap[0]["close"] == 101 and gap[0]["volume"] == 0
    assert {tuple(r) for r in intraday.gap_statistics(grid).collect()} == {("BTC", 3, 1, 1, 1), ("ETH", 3, 1, 1, 1)}


def test_intraday_validation_reports_in_order(spark):
    good, as_of = bars(spark), F.lit("2026-01-02").cast("timestamp_ntz")
    validate.check_intraday(good, ["BTC", "ETH"], as_of)
    cases = {
        "unsupported assets": (good, ["BTC"]), "missing assets": (good, ["BTC", "ETH", "SOL"]), "duplicate": (good.unionByName(good), ["BTC", "ETH"]),
        "15 minutes": (good.withColumn("date", F.col("date") + F.expr("interval 1 minute")), ["BTC", "ETH"]), "finite": (good.withColumn("volume", F.lit(float("nan"))), ["BTC", "ETH"]),
        "positive": (good.withColumn("low", -F.col("low")), ["BTC", "ETH"]), "not be negative": (good.withColumn("volume", -F.col("volume")), ["BTC", "ETH"]), "high below": (good.withColumn("high", F.col("low")), ["BTC", "ETH"]),
    }
    for message, (df, assets) in cases.items():
        with pytest.raises(ValueError, match=message):
            validate.check_intraday(df, assets, as_of)
    with pytest.raises(ValueError, match="not complete"):
        validate.check_intraday(good, ["BTC", "ETH"], F.lit("2026-01-01 00:50:00").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="missing columns"):
        validate.check_intraday(good.drop("open"), ["BTC", "ETH"], as_of)


def test_prediction_validation(spark):
    columns = [c.split()[0] for c in PREDICTIONS.split(", ")]
    good = frame(spark, prediction())
    validate.check_predictions(good, columns)
    for message, df in {"missing prediction columns": good.drop("rv"), "not numeric": good.withColumn("regime_driver", F.lit("x")), "null": frame(spark, prediction(y=None)), "duplicate": good.unionByName(good), "crossed": frame(spark, prediction(q10=101.0)), "horizons": frame(spark, prediction(h=8))}.items():
        with pytest.raises(ValueError, match=message):
            validate.check_predictions(df, columns)


def test_comparable_bundles(spark):
    a = frame(spark, *(prediction(h=h) for h in (1, 2)))
    b = a.withColumn("model", F.lit("lgbm"))
    validate.check_comparable([a, b], [2, 2])
    for message, two in {"several bundles": a, "incomplete": b.where("h = 1"), "shared values": b.withColumn("y", F.col("y") + 1), "differ in keys": b.withColumn("asset", F.lit("ETH"))}.items():
        with pytest.raises(ValueError, match=message):
            validate.check_comparable([a, two], [2, 2])


def test_scheduled_split(spark):
    rows = spark.createDataFrame([(START + i * DAY,) for i in range(12)], "origin timestamp_ntz")
    got = {r["split"]: r["count"] for r in splits.scheduled_split(rows, rows, 6, 4, 0).groupBy("split").count().collect()}
    assert got == {"calibration": 6, "test": 4}
    with pytest.raises(Exception, match="scheduled origins"):
        splits.scheduled_split(rows, rows, 10, 4, 0).collect()
    with pytest.raises(Exception, match="not eligible"):
        splits.scheduled_split(rows, rows.limit(3), 6, 4, 0).collect()
    with pytest.raises(ValueError, match="test origins"):
        splits.scheduled_split(rows, rows, n_test=50)


def test_clustered_direction_interval(spark):
    rows = [("m", a, START + d * DAY, 96, 110.0 if d < 2 else 90.0, 100.0, 105.0, 105.0, 105.0) for d in range(4) for a in ("A", "B")]
    df = spark.createDataFrame(rows, "model string, asset string, origin timestamp_ntz, h int, y double, last double, q10 double, q50 double, q90 double")
    r = score.direction_interval(df).first()
    assert (r["direction_ci_low"], r["direction_ci_high"]) == (0, 100)
    h = score.hashed_interval(df).first()
    assert 0 <= h["direction_ci_low"] <= 20 and 80 <= h["direction_ci_high"] <= 100


def test_ingest_rules(spark):
    pages = spark.createDataFrame([(i, s, int((START + d * DAY).timestamp() * 0 + d * 86_400_000), 1.0, 2.0, 0.5, c, 1.0) for i, (s, d, c) in enumerate([("A/USDT", 0, 1.0), ("A/USDT", 1, 1.1), ("A/USDT", 1, 9.0), ("A/USDT", 2, 1.2), ("B/USDT", 0, 3.0)])], "seq long, symbol string, ts_ms long, open double, high double, low double, close double, volume double")
    got = ingest.ohlcv(pages, F.lit("1970-01-03 10:00:00").cast("timestamp_ntz"), ingest.PRESETS["1d"], 2).orderBy("date").collect()
    assert [(r["asset"], r["close"]) for r in got] == [("A", 1.0), ("A", 1.1)]
    assert ingest.symbol_candidates("PEPE") == ["PEPE/USDT:USDT", "1000PEPE/USDT:USDT"]


def test_upsert_keeps_the_new_row(spark):
    old, new = (spark.createDataFrame(r, "asset string, v int") for r in ([("A", 1), ("B", 2)], [("B", 3), ("C", 4)]))
    assert sorted(map(tuple, ingest.upsert(old, new, ["asset"]).collect())) == [("A", 1), ("B", 3), ("C", 4)]


def test_winner_and_margin(spark):
    rows = spark.createDataFrame([("A", "x", 2.0), ("A", "y", 1.0), ("A", "z", 4.0)], "asset string, model string, pinball double")
    assert tuple(report.winners(rows).first()) == ("A", "y", 1.0)


def test_upsert_keeps_the_last_arrival(spark):
    old = spark.createDataFrame([("A", 9, 1)], "asset string, at long, v int")
    new = spark.createDataFrame([("A", 3, 2), ("A", 7, 3), ("A", 5, 4)], "asset string, at long, v int").coalesce(1)
    assert ingest.upsert(old, new, ["asset"], "at").first()["v"] == 3
    assert ingest.upsert(old, new, ["asset"]).first()["v"] == 4


def test_dates_off_the_grid_by_a_microsecond(spark):
    rows = bars(spark).withColumn("date", F.col("date") + F.expr("interval 1 microsecond"))
    assert validate.intraday_violations(rows, ["BTC", "ETH"], F.lit("2030-01-01").cast("timestamp_ntz")).first()["unaligned"] == rows.count()


def test_losses_of_forecasts_that_do_not_align(spark):
    left = frame(spark, prediction(asset="BTC"), prediction(asset="ETH"))
    for bad in (left.where("asset = 'BTC'"), left.unionByName(left), left.withColumn("rv", F.col("rv") + 1), left.withColumn("fold", F.col("fold") + F.expr("interval 1 day"))):
        with pytest.raises(Exception, match="align|repeat"):
            ensemble.weight_losses(left, bad).collect()


def test_model_features_and_groups(spark):
    from panelspark.queries import walks

    panel = ramp(spark)
    funding = panel.select("asset", "date", F.lit(0.1).alias("funding_sum"))
    names = walk.feature_frame(panel, "BTC", funding).columns
    assert sorted(features.feature_columns(names)) == sorted(walks.COLUMNS) and len(walks.COLUMNS) == 24
    assert len(features.feature_columns(names, use_candidates=True)) == 27
    listed = walk.ablation_candidates(features.feature_columns(names, use_candidates=True))
    assert {k: len(v) for k, v in listed.items()} == {"all": 27, "legacy": 24, "without_returns": 15, "without_volatility": 19, "without_volume": 26, "without_market": 25, "without_funding": 23}


def plain_boost(x, y, shape, trees):
    """Boosting without bins, samples or missing values, by trying every split of every leaf."""
    out, fitted = np.full(len(y), y.mean()), []
    for _ in range(trees):
        left = y - out
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < shape.leaves:
            best = (1e-12, None, None, None)
            for k, (rows, depth) in enumerate(leaves):
                if depth >= shape.depth:
                    continue
                g, n = left[rows].sum(), len(rows)
                for c in range(x.shape[1]):
                    for v in np.unique(x[rows, c])[:-1]:
                        a = rows[x[rows, c] <= v]
                        if len(a) < shape.least or n - len(a) < shape.least:
                            continue
                        s = left[a].sum()
                        gain = s * s / (len(a) + shape.ridge) + (g - s) ** 2 / (n - len(a) + shape.ridge) - g * g / (n + shape.ridge)
                        if gain > best[0]:
                            best = (gain, k, c, v)
            if best[1] is None:
                break
            rows, depth = leaves.pop(best[1])
            low = x[rows, best[2]] <= best[3]
            leaves += [(rows[low], depth + 1), (rows[~low], depth + 1)]
        for rows, _ in leaves:
            out[rows] += shape.rate * left[rows].sum() / (len(rows) + shape.ridge)
        fitted.append(out.copy())
    return fitted[-1]


@pytest.mark.parametrize("shape", [boosting.Shape(6, 64, 0.0, 5, 0.3, 5, 1.1, 1.0), boosting.Shape(8, 2, 1.0, 5, 0.3, 5, 1.1, 1.0)])
def test_trees_on_histograms_are_those_on_all_splits(shape):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (80, 3)).astype(float)
    y = x[:, 0] * 0.3 + (x[:, 1] > 4) + rng.normal(0, 0.1, 80)
    model = boosting.fit(x, y, shape)
    assert np.allclose(model.predict(x), plain_boost(x, y, shape, 5))
    again = boosting.from_bytes(boosting.to_bytes(model))
    assert np.array_equal(again.predict(x), model.predict(x))


def test_trees_send_missing_values_where_they_gain():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 2))
    x[:300, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]) | (x[:, 0] > 1), 3.0, 0.0) + rng.normal(0, 0.05, 900)
    model = boosting.fit(x, y, boosting.KINDS["xgb"])
    assert np.abs(model.predict(x) - y).mean() < 0.1


def walk_rows(n=420, seed=8):
    rng = np.random.default_rng(seed)
    names = [f"x{i}" for i in range(4)]
    rows = pd.DataFrame(rng.normal(size=(n, 4)), columns=names)
    rows.iloc[::9, 1] = np.nan
    rows.iloc[5, 2] = 1e6
    for h in features.HORIZONS:
        rows[f"rv{h}"] = np.exp(-3 + 0.2 * rows["x0"] + 0.01 * h + rng.normal(0, 0.1, n))
    return rows.assign(part=["fit"] * 300 + ["cal"] * 60 + ["test"] * (n - 360)), names


def test_ridge_is_the_closed_form_of_its_fit_part():
    rows, names = walk_rows()
    found = walk.ridge_sigma(rows, names)
    x = rows[names].fillna(0).to_numpy()
    fit = x[:300]
    q = np.quantile(fit, [0.25, 0.5, 0.75], axis=0)
    x = np.clip((x - q[1]) / (q[2] - q[0]), -10, 10)
    wide = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([0, 1, 1, 1, 1])
    for h in features.HORIZONS:
        beta = np.linalg.solve(wide[:300].T @ wide[:300] + penalty, wide[:300].T @ np.log(rows[f"rv{h}"].to_numpy()[:300]))
        assert np.allclose(found[:, h - 1], np.exp(wide @ beta))
    other = rows.copy()
    other.loc[300:, names] = 7.0
    assert np.allclose(walk.ridge_sigma(other, names)[:300], found[:300])


def test_models_learn_from_the_fit_part_alone(spark):
    """What the calibration and test rows say of volatility changes no model."""
    rng = np.random.default_rng(3)
    n = 700
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    data = [("BTC", START + i * DAY, p, p * 1.01, p * 0.99, p, 10.0 + i % 5) for i, p in enumerate(price.tolist())]
    panel = spark.createDataFrame(data, ramp(spark, 3).schema)
    ready = walk.feature_frame(panel).cache()
    folds = splits.fold_calendar(ready, "2025-01-01").where("fold < '2026-01-01'")
    columns = ["ret_5d", "vol_5d", "vol_21d", "range_5d"]
    rows = walk.parts(ready, folds, columns, also=walk.HARS).cache()
    cut = rows.where("part = 'cal'").agg(F.min("date")).first()[0]
    assert rows.where("part = 'fit'").agg(F.max("date")).first()[0] < cut and {r[0] for r in rows.select("part").distinct().collect()} == {"fit", "cal", "test"}
    worse = rows
    for h in features.HORIZONS:
        worse = worse.withColumn(f"rv{h}", F.when(F.col("part") != "fit", F.lit(0.2)).otherwise(F.col(f"rv{h}")))
    shape = {"xgb": boosting.Shape(8, 3, 1.0, trees=5)}
    for family in (walk.har, lambda r: walk.ridge(r, columns), lambda r: walk.trees(r, columns, shape), lambda r: walk.garch(r, panel)):
        a, b = (sorted((str(r["date"]), r["h"], round(r["sigma"], 12)) for r in family(x).collect()) for x in (rows, worse))
        assert a == b and len(a) == 7 * rows.where("part <> 'fit'").count() and all(0 < s <= 0.3 for _, _, s in a)
    long = walk.baseline(rows).unionByName(walk.har(rows))
    out = walk.predictions(long)
    assert out.where("q10 > q50 or q50 > q90").count() == 0 and out.select("model").distinct().count() == 2


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows, names = walk_rows()
    rows = rows.assign(fold=START, asset="BTC", date=[START + i * DAY for i in range(len(rows))], close=1.0, vol_21d=0.02, **{f"y{h}": 0.01 for h in features.HORIZONS})
    df = spark.createDataFrame(rows).withColumns({"fold": F.col("fold").cast("timestamp_ntz"), "date": F.col("date").cast("timestamp_ntz")})
    fitted = walk.fit_trees(df, names, {"xgb": boosting.Shape(4, 3, 1.0, trees=3)})
    z = calibrate.z_table(walk.tree_sigma(df, fitted, names).where("part = 'cal'"))
    walk.save(str(tmp_path / "m"), fitted, z, names)
    again, z2, columns = walk.load(spark, str(tmp_path / "m"))
    assert columns == names and z2.count() == 7
    assert walk.tree_sigma(df, again, columns).exceptAll(walk.tree_sigma(df, fitted, names)).count() == 0
    with pytest.raises(Exception, match="exists"):
        walk.save(str(tmp_path / "m"), fitted, z, names)


def test_arma_residuals_step_by_step():
    rng = np.random.default_rng(2)
    d = rng.normal(size=40)
    p, t, sp, st = 0.5, -0.3, 0.2, 0.4
    e = []
    at = lambda a, i: a[i] if i >= 0 else 0.0
    for i in range(40):
        e.append(d[i] - p * at(d, i - 1) - sp * (at(d, i - 7) - p * at(d, i - 8)) - t * at(e, i - 1) - st * (at(e, i - 7) + t * at(e, i - 8)))
    assert np.allclose(models.arma_residuals(d[None], np.array([40]), np.array([p]), np.array([t]), np.array([sp]), np.array([st]))[:, 0], e)


def test_arima_finds_its_parameters_and_continues():
    rng = np.random.default_rng(5)
    e, d = rng.normal(size=600), np.zeros(600)
    for i in range(1, 600):
        d[i] = 0.6 * d[i - 1] + e[i] + 0.3 * e[i - 1]
    history = 100 + np.cumsum(d)
    short = history[:200]
    found = models.arima([history, short])
    steps = np.diff(np.concatenate([history[-1:], found[0]]))
    assert np.allclose(steps[2:] / steps[1:-1], 0.6, atol=0.1)
    assert np.allclose(models.arima([short])[0], found[1])
    assert np.allclose(models.arima([np.full(90, 5.0)], seasonal=True), 5.0)


def test_walk_forward_of_one_long_series_in_blocks(spark):
    """Blocks see the same closes as one group would, whatever a block is; assets without origins give no rows."""
    rows = [("L", START + i * DAY, 100.0 + (i * 37 % 101) + i / 50) for i in range(700)] + [("S", START + i * DAY, 5.0) for i in range(20)]
    panel = spark.createDataFrame([(a, t, c, c, c, c, 1.0) for a, t, c in rows], "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    close = np.array([r[2] for r in rows[:700]])
    found = models.walk_forward(panel, lambda h: {"sum": np.full(7, h.sum() + len(h))}, context=90).toPandas()
    at = ((found["origin"] - START).dt.days).to_numpy()
    assert len(set(at)) > 50 and set(found["asset"]) == {"L"} and not found.duplicated(["origin", "h"]).any()
    for i, h, y, yhat, last, mae in zip(at, found["h"], found["y"], found["yhat"], found["last"], found["naive_mae"], strict=True):
        seen = close[max(0, i - 89) : i + 1]
        assert np.isclose(yhat, seen.sum() + len(seen)) and y == close[i + h] and last == close[i]
        assert np.isclose(mae, np.abs(np.diff(close[: i + 1])).mean())
    origins = models.point_baselines(panel).select("origin").distinct().count()
    assert len(set(at)) == origins


def test_gap_bars_and_cursor_are_streams(spark):
    import __spark_entry__ as entry

    for name in ("stream_gap_bars", "stream_cursor", "src9_symbol_fallback"):
        assert name in entry.queries() and name in entry.oracle_sql()
