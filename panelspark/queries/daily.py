"""Daily panels: sources, features, splits, calibration, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, clip_sigma, safe_div, safe_ln
from panelspark.operators import calibrate, ensemble, evidence, features, models, quantiles, report, score, splits, validate
from panelspark.plans import daily
from panelspark.queries import frames as fr
from panelspark.queries.registry import another, query
from panelspark.sources import ingest, layout

D = fr.DAILY
P = fr.PANEL
COLUMNS = ["model", "asset", "origin", "fold", "h", "y", "last", "sigma", "rv", "regime_driver", "q10", "q50", "q90"]


def feature(name: str, cols: str, sql_cols: str | None = None) -> None:
    names = [c.split(":")[0].strip() for c in cols.split(",")]
    query(name, f"asset, date, {cols}", lambda s, d: fr.feats(s, d), f"SELECT asset, date, {sql_cols or ', '.join(names)} FROM feat", D)


def raw_pages(spark, d) -> DataFrame:
    """Pages of an exchange: bars of the panel in milliseconds, the last forty of every asset twice."""
    p = fr.panel(spark, d)
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    rows = p.withColumn("_r", rank)
    once = rows.select(F.lit(0).alias("copy"), "*")
    twice = rows.where("_r <= 40").select(F.lit(1).alias("copy"), "*").withColumn("close", F.col("close") + 1)
    both = once.unionByName(twice)
    return both.select(F.expr("copy * 1000000000L + unix_millis(cast(date as timestamp)) div 86400000").alias("seq"), F.concat("asset", F.lit("/USDT")).alias("symbol"), F.unix_millis(F.col("date").cast("timestamp")).alias("ts_ms"), "open", "high", "low", "close", "volume")


def tickers(spark, d) -> DataFrame:
    return fr.table(spark, d, "part").select(F.col("p_brand").alias("base"), F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(F.col("p_partkey") % 3 > 0, "USDT").otherwise("EUR").alias("quote"), (F.col("p_partkey") % 7 > 0).alias("active"), (F.col("p_partkey") % 5 > 0).alias("spot"), (F.col("p_retailprice") * F.col("p_size")).alias("quote_volume"))


# Sources
query("src1_parquet_scan", "o_orderkey, o_custkey, o_totalprice, o_orderpriority", lambda s, d: fr.table(s, d, "orders"), "SELECT * FROM orders")
query("src2_projected_scan", "o_orderkey, o_totalprice", lambda s, d: fr.table(s, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice > 100000"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
query("src3_bundle_union", "model, n:i", lambda s, d: (lambda p: p[0].unionByName(p[1]))(pair(s, d)).groupBy("model").agg(F.count("*").alias("n")), "SELECT model, count(*) AS n FROM pred WHERE model IN ('vol_5d', 'vol_63d') GROUP BY model", D)
query("src5_ohlcv_ingest", "asset, date, open:4, high:4, low:4, close:4, volume:4", lambda s, d: ingest.ohlcv(raw_pages(s, d), F.lit("2001-06-15 10:30:00").cast("timestamp_ntz"), ingest.PRESETS["1d"], 200), "SELECT * FROM panel WHERE date < TIMESTAMP '2001-06-15' AND asset IN (SELECT asset FROM panel WHERE date < TIMESTAMP '2001-06-15' GROUP BY asset HAVING count(*) >= 200)", P)
query("src7_incomplete_cutoff", "asset, date, close:4", lambda s, d: fr.panel(s, d).where(F.col("date") < ingest.cutoff(F.lit("2000-03-05 17:12:00").cast("timestamp_ntz"), ingest.PRESETS["1d"])), "SELECT * FROM panel WHERE date < TIMESTAMP '2000-03-05'", P)
query("src8_funding_daily", "asset, date, funding_sum:8, funding_n:i", fr.funding, "SELECT * FROM funding", fr.FUNDING)
query("src10_upsert_keep_last", "asset, date, close:4", lambda s, d: ingest.upsert(fr.panel(s, d).where("date < '1999-06-01'").select("asset", "date", "close"), fr.panel(s, d).where("date >= '1999-01-01'").select("asset", "date", (F.col("close") * 2).alias("close")), ["asset", "date"]), "SELECT asset, date, CASE WHEN date >= TIMESTAMP '1999-01-01' THEN close * 2 ELSE close END AS close FROM panel", P)
query("src11_universe_top_n", "symbol, quote_volume:4", lambda s, d: ingest.universe(tickers(s, d), 20, stable=("Brand#11", "Brand#12")), "SELECT p_brand || '-' || p_partkey AS symbol, p_retailprice * p_size AS quote_volume FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND p_brand NOT IN ('Brand#11', 'Brand#12') ORDER BY quote_volume DESC, symbol LIMIT 20")
query("snk3_results_log_melt", "run, tag, meta, model, metric, value:4", lambda s, d: evidence.melted(score.score(fr.preds(s, d)), "r1", "t", {"a": 1, "b": "x"}, ["pinball", "coverage", "width"]), f"SELECT 'r1' AS run, 't' AS tag, 'a=1;b=x' AS meta, model, metric, value FROM (SELECT model, pinball, coverage, width FROM (SELECT model, {fr.METRICS} FROM pred GROUP BY model)) UNPIVOT (value FOR metric IN (pinball, coverage, width))", D)

# Projections and filters
query("prj3_latest_row", "asset, date, close:4", lambda s, d: features.latest(fr.panel(s, d)), "SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) = 1", P)
query("prj4_drop_nulls", "asset, date, vol_21d:8, px_vs_ma63:8", lambda s, d: fr.feats(s, d).na.drop(subset=["vol_21d", "px_vs_ma63"]), "SELECT * FROM feat WHERE vol_21d IS NOT NULL AND px_vs_ma63 IS NOT NULL", D)
query("prj5_incomplete_assets", "asset", lambda s, d: features.incomplete_assets(fr.feats(s, d).withColumn("probe", F.when(F.col("asset") != "3-MEDIUM", F.col("vol_63d"))), ["vol_21d", "probe"]), "SELECT asset FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS r FROM feat) WHERE r = 1 AND (vol_21d IS NULL OR vol_63d IS NULL OR asset = '3-MEDIUM')", D)

# Features
feature("wn1_log_return", "lr:8")
feature("wn2_return_lags", ", ".join(f"ret_lag{k}:8" for k in features.RETURN_LAGS))
feature("wn3_return_sums", ", ".join(f"ret_{n}d:8" for n in features.WINDOWS))
feature("wn4_volatility", ", ".join(f"vol_{n}d:8" for n in features.WINDOWS))
feature("wn5_vol_regime", "vol_regime:8")
feature("wn6_drawdown", "drawdown_63d:8")
feature("wn7_volume_z", "volume_z21:6")
feature("wn8_range", "range:8, range_5d:8")
feature("wn9_volume_ratio", "vol_ratio:8")
feature("wn10_price_to_mean", "px_vs_ma63:8")
feature("wn11_naive_mae", "naive_mae:2")
feature("wn12_har", ", ".join(f"har_{n}d:8" for n in features.HAR))
BLOCK = 256
query(
    "wn35_blocked_features",
    "asset, date, lr:8, ret_63d:8, vol_5d:8, vol_63d:8, vol_regime:8, drawdown_63d:8, volume_z21:6, range_5d:8, vol_ratio:8, px_vs_ma63:8, naive_mae:2, har_22d:8",
    lambda s, d: features.daily_features(fr.panel(s, d), BLOCK),
    "SELECT * FROM feat",
    D,
)
query("wn36_blocked_labels", "asset, date, idx:i, n:i, is_origin, " + ", ".join(f"y{h}:8, rv{h}:8, label_end{h}" for h in features.HORIZONS), lambda s, d: features.origin_mask(features.with_labels(features.daily_features(fr.panel(s, d), BLOCK), BLOCK)), "SELECT * FROM mask", D)
query("wn13_label_ends", "asset, date, " + ", ".join(f"label_end{h}" for h in features.HORIZONS), fr.ready, "SELECT * FROM mask", D)
query("wn14_forward_returns", "asset, date, " + ", ".join(f"y{h}:8" for h in features.HORIZONS), fr.ready, "SELECT * FROM mask", D)
query("wn15_forward_volatility", "asset, date, " + ", ".join(f"rv{h}:8" for h in features.HORIZONS), fr.ready, "SELECT * FROM mask", D)
MARKET = f"market AS (SELECT feat.*, m.lr AS btc_ret FROM feat LEFT JOIN (SELECT date, lr FROM feat WHERE asset = '{fr.MARKET}') AS m USING (date))"
query("wn16_market_return", "asset, date, btc_ret:8, btc_ret_5d:8", lambda s, d: features.with_market(fr.feats(s, d), fr.MARKET), f"SELECT *, {fr.roll('sum', 'btc_ret', 5)} AS btc_ret_5d FROM market", f"{D}, {MARKET}")
FUNDED = "funded AS (SELECT feat.*, funding_sum FROM feat LEFT JOIN funding USING (asset, date))"
query("wn17_funding_means", "asset, date, fund_7d:8, fund_21d:8", lambda s, d: features.with_funding(fr.feats(s, d), fr.funding(s, d)), f"SELECT *, {fr.roll('avg', 'funding_sum', 7)} AS fund_7d, {fr.roll('avg', 'funding_sum', 21)} AS fund_21d FROM funded", f"{D}, {FUNDED}")
query("wn18_funding_z", "asset, date, fund_z:6", lambda s, d: features.with_funding(fr.feats(s, d), fr.funding(s, d)), f"SELECT *, (funding_sum - {fr.roll('avg', 'funding_sum', 63)}) / nullif({fr.roll('stddev_samp', 'funding_sum', 63)}, 0) AS fund_z FROM funded", f"{D}, {FUNDED}")
query("wn19_origin_mask", "asset, date, idx:i, n:i, is_origin", fr.ready, "SELECT * FROM mask", D)
query("wn27_lookback_windows", "asset, date, size:i, r_sum:6, ar_sum:6, rng_sum:6, dv_sum:6", lambda s, d: features.lookback_windows(fr.panel(s, d)).select("asset", "date", F.size("window").alias("size"), *(F.expr(f"aggregate(window, 0D, (t, x) -> t + x.{c})").alias(f"{c}_sum") for c in ("r", "ar", "rng", "dv"))), f"SELECT asset, date, 30 AS size, {', '.join(f'sum({x}) OVER {fr.frame(30)} AS {n}_sum' for n, x in (('r', 'coalesce(lr, 0)'), ('ar', 'coalesce(abs(lr), 0)'), ('rng', 'coalesce(range, 0)'), ('dv', 'coalesce(dv, 0)')))} FROM (SELECT *, lv - lag(lv) OVER ({fr.W}) AS dv FROM base) QUALIFY row_number() OVER ({fr.W}) >= 30 AND count(*) OVER (PARTITION BY asset) > 30", D)
query("wn29_cumulative_return", "asset, date, growth:8", lambda s, d: report.cumulative_returns(fr.panel(s, d)), f"SELECT *, close / first_value(close) OVER ({fr.W}) AS growth FROM panel", P)
query("wn34_year_ticks", "asset, date, new_year", lambda s, d: fr.panel(s, d).withColumn("new_year", F.coalesce(F.year("date") != F.lag(F.year("date")).over(along()), F.lit(True))), f"SELECT *, coalesce(year(date) <> lag(year(date)) OVER ({fr.W}), true) AS new_year FROM panel", P)

# Joins
query("jn1_market_left_join", "asset, date, btc_ret:8", lambda s, d: features.with_market(fr.feats(s, d), fr.MARKET), "SELECT * FROM market", f"{D}, {MARKET}")
query("jn2_funding_left_join", "asset, date, funding_sum:8", lambda s, d: features.with_funding(fr.feats(s, d), fr.funding(s, d)), "SELECT * FROM funded", f"{D}, {FUNDED}")
query("jn3_assets_without_funding", "asset", lambda s, d: features.without_funding(fr.panel(s, d), fr.funding(s, d).where("asset <> '5-LOW'")), "SELECT DISTINCT asset FROM panel WHERE asset NOT IN (SELECT asset FROM funding WHERE asset <> '5-LOW')", D)
query("jn6_window_lookup", "asset, date, found", lambda s, d: fr.panel(s, d).join(features.lookback_windows(fr.panel(s, d)).select("asset", "date", F.lit(True).alias("found")), ["asset", "date"], "left").withColumn("found", F.coalesce("found", F.lit(False))), f"SELECT asset, date, row_number() OVER ({fr.W}) >= 30 AND count(*) OVER (PARTITION BY asset) > 30 AS found FROM panel", P)
query("jn7_blend_alignment", "asset, origin, h, left_sigma:8, right_sigma:8", lambda s, d: ensemble.aligned(*(fr.preds(s, d).where(F.col("model") == m) for m in ("vol_5d", "vol_63d"))), "SELECT a.asset, a.origin, a.h, a.sigma AS left_sigma, b.sigma AS right_sigma FROM pred a JOIN pred b ON a.asset = b.asset AND a.origin = b.origin AND a.h = b.h AND a.model = 'vol_5d' AND b.model = 'vol_63d'", D)
query("jn8_origins_semi", "asset, date, close:4", lambda s, d: fr.panel(s, d).join(fr.ready(s, d).where("is_origin").select("asset", "date"), ["asset", "date"], "left_semi"), "SELECT panel.* FROM panel SEMI JOIN (SELECT asset, date FROM mask WHERE is_origin) USING (asset, date)", D)
query("jn9_origins_anti", "asset, date", lambda s, d: fr.ready(s, d).where("is_origin").select("asset", "date").join(fr.funding(s, d), ["asset", "date"], "left_anti"), "SELECT asset, date FROM mask m WHERE is_origin AND NOT EXISTS (SELECT 1 FROM funding f WHERE f.asset = m.asset AND f.date = m.date)", D)
query("jn13_sigma_by_date", "asset, date, sigma:8", lambda s, d: fr.panel(s, d).join(fr.feats(s, d).where("vol_21d is not null and day(date) > 15").select("asset", "date", F.col("vol_21d").alias("sigma")), ["asset", "date"], "left"), "SELECT asset, date, CASE WHEN day(date) > 15 THEN vol_21d END AS sigma FROM feat", D)
query("jn14_fold_membership", "fold, side, n:i", lambda s, d: (lambda r, f: r.join(F.broadcast(f), F.col("date") < F.col("fold_end")).groupBy("fold", F.when(F.col("date") < F.col("fold"), "train").otherwise("test").alias("side")).agg(F.count("*").alias("n")))(fr.panel(s, d), splits.fold_calendar(fr.panel(s, d), fr.START)), "SELECT fold, CASE WHEN date < fold THEN 'train' ELSE 'test' END AS side, count(*) AS n FROM panel JOIN years ON date < fold_end GROUP BY 1, 2", D)
query("jn16_row_expansion", "asset, date, h, y:8, rv:8", lambda s, d: features.long_labels(fr.ready(s, d)), " UNION ALL ".join(f"SELECT asset, date, CAST({h} AS INTEGER) AS h, y{h} AS y, rv{h} AS rv FROM mask" for h in features.HORIZONS), D)

# Splits
query("bt3_fold_calendar", "fold, fold_end", lambda s, d: splits.fold_calendar(fr.panel(s, d), fr.START), "SELECT * FROM years", D)
query("bt4_purged_train", "fold, rows:i, last_date", lambda s, d: splits.train_rows(fr.ready(s, d), splits.fold_calendar(fr.panel(s, d), fr.START), list(daily.SIGMAS)).groupBy("fold").agg(F.count("*").alias("rows"), F.max("date").alias("last_date")), "SELECT fold, count(*) AS rows, max(date) AS last_date FROM train GROUP BY fold", D)
query("bt5_calibration_split", "fold, part, rows:i, cut:0", lambda s, d: splits.split_calibration(splits.train_rows(fr.ready(s, d), splits.fold_calendar(fr.panel(s, d), fr.START), list(daily.SIGMAS))).groupBy("fold", "part").agg(F.count("*").alias("rows"), F.max("cut").alias("cut")), "SELECT fold, part, count(*) AS rows, max(cut) AS cut FROM split GROUP BY 1, 2", D)
query("bt6_test_origins", "fold, asset, date", lambda s, d: splits.test_rows(fr.ready(s, d), splits.fold_calendar(fr.panel(s, d), fr.START), list(daily.SIGMAS)), "SELECT * FROM tests", D)
query("bt7_min_fit_gate", "fold, asset", lambda s, d: (lambda r, f: splits.with_enough(splits.split_calibration(splits.train_rows(r, f, list(daily.SIGMAS))), splits.test_rows(r, f, list(daily.SIGMAS)), ["fold", "asset"]))(fr.ready(s, d), splits.fold_calendar(fr.panel(s, d), fr.START)), "SELECT fold, asset FROM split WHERE part = 'fit' GROUP BY 1, 2 HAVING count(*) >= 200 AND (fold, asset) IN (SELECT (fold, asset) FROM tests)", D)

# Point baselines
SO_FAR = f"avg(move) OVER ({fr.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
POINTS = "points0 AS (SELECT *, " + ", ".join(f"lead(close, {h}) OVER ({fr.W}) AS t{h}, lag(close, {7 - h}) OVER ({fr.W}) AS s{h}" for h in features.HORIZONS) + f", (close - lag(close, 29) OVER ({fr.W})) / 29 AS slope FROM mask), points AS (" + " UNION ALL ".join(f"SELECT asset, date AS origin, '{m}' AS model, CAST({h} AS INTEGER) AS h, t{h} AS y, {e} AS yhat, close AS last, naive_mae FROM points0 WHERE is_origin" for h in features.HORIZONS for m, e in (("flat", "close"), ("drift", f"close + {h} * slope"), ("seasonal", f"s{h}"))) + ")"
query("bt1_walk_forward", "asset, origin, model, h, y:4, yhat:4, last:4, naive_mae:2", lambda s, d: models.point_baselines(fr.panel(s, d)), "SELECT * FROM points", f"{D}, {POINTS}")
query("bt2_naive_baselines", "asset, origin, flat:4, drift:4, seasonal:4", lambda s, d: models.point_baselines(fr.panel(s, d)).where("h = 7").groupBy("asset", "origin").pivot("model", ["flat", "drift", "seasonal"]).agg(F.max("yhat")), "SELECT asset, origin, max(yhat) FILTER (model = 'flat') AS flat, max(yhat) FILTER (model = 'drift') AS drift, max(yhat) FILTER (model = 'seasonal') AS seasonal FROM points WHERE h = 7 GROUP BY 1, 2", f"{D}, {POINTS}")
query("wn30_drift_slope", "asset, origin, yhat:4", lambda s, d: models.point_baselines(fr.panel(s, d)).where("model = 'drift' and h = 1"), "SELECT * FROM points WHERE model = 'drift' AND h = 1", f"{D}, {POINTS}")
query("wn31_seasonal_lag", "asset, origin, h, yhat:4", lambda s, d: models.point_baselines(fr.panel(s, d)).where("model = 'seasonal'"), "SELECT * FROM points WHERE model = 'seasonal'", f"{D}, {POINTS}")
query("wn32_rolling_trend", "asset, origin, h, yhat:2", lambda s, d: models.trend_forecasts(fr.panel(s, d)), f"SELECT asset, date AS origin, CAST(k AS INTEGER) AS h, a + b * (t + k) AS yhat FROM (SELECT *, regr_slope(close, t) OVER {fr.frame(30)} AS b, regr_intercept(close, t) OVER {fr.frame(30)} AS a FROM (SELECT *, CAST(idx + 1 AS DOUBLE) AS t FROM mask)), unnest([1, 2, 3, 4, 5, 6, 7]) AS u(k) WHERE is_origin", D)
HIT = "CASE WHEN sign({0} - last) = sign(y - last) THEN 100.0 ELSE 0.0 END"
query("ag2_report", "model, MAE:4, MAPE:6, MASE:6, DirAcc:6", lambda s, d: score.report(models.point_baselines(fr.panel(s, d))), f"SELECT model, avg(abs(y - yhat)) AS \"MAE\", 100 * avg(abs(y - yhat) / y) AS \"MAPE\", avg(abs(y - yhat) / naive_mae) AS \"MASE\", avg({HIT.format('yhat')}) FILTER (h = 7) AS \"DirAcc\" FROM points GROUP BY model", f"{D}, {POINTS}")
H7 = ", ".join(f"h{h}:6" for h in features.HORIZONS)
query("ag3_mape_by_horizon", f"model, {H7}", lambda s, d: score.mape_by_horizon(models.point_baselines(fr.panel(s, d)), features.HORIZONS), "SELECT model, " + ", ".join(f"100 * avg(abs(y - yhat) / y) FILTER (h = {h}) AS h{h}" for h in features.HORIZONS) + " FROM points GROUP BY model", f"{D}, {POINTS}")

# Calibration and models
query("md1_clip_sigma", "asset, date, sigma:8", lambda s, d: fr.feats(s, d).withColumn("sigma", clip_sigma(F.col("vol_21d") / 5)), "SELECT *, least(greatest(coalesce(vol_21d / 5, 1e-4), 1e-4), 0.3) AS sigma FROM feat", D)
query("md2_bands", "model, asset, origin, h, q10:3, q50:3, q90:3", fr.preds_once, "SELECT * FROM pred", D)
query("md3_normal_bands", "asset, date, h, q10:3, q50:3, q90:3", lambda s, d: calibrate.normal_bands(fr.feats(s, d).where("vol_63d is not null").select("asset", "date", F.col("close").alias("last"), F.col("vol_63d").alias("sigma"), F.explode(F.array(F.lit(1), F.lit(7))).alias("h"))), "SELECT asset, date, CAST(k AS INTEGER) AS h, close * exp(-1.2815515655446004 * vol_63d * sqrt(k)) AS q10, close AS q50, close * exp(1.2815515655446004 * vol_63d * sqrt(k)) AS q90 FROM feat, unnest([1, 7]) AS u(k) WHERE vol_63d IS NOT NULL", D)
query("md4_vol21_baseline", f"model, {fr.METRIC_SPEC}", lambda s, d: score.score(fr.preds_once(s, d, ("vol_21d",))), f"SELECT model, {fr.METRICS} FROM pred WHERE model = 'vol_21d' GROUP BY model", D)
query("ag15_z_table", "fold, model, h, z10:6, z50:6, z90:6", lambda s, d: calibrate.z_table(daily.calibration_rows(fr.ready(s, d), fr.START)), "SELECT fold, model, h, z[1] AS z10, z[2] AS z50, z[3] AS z90 FROM z", D)
ONE = "one AS (SELECT asset, date, har_5d, ln(rv5) AS target FROM mask WHERE har_5d IS NOT NULL AND rv5 > 0 AND date < TIMESTAMP '1998-01-01')"
query("md5_single_factor_fit", "asset, intercept:6, slope:6", lambda s, d: models.linear_fits(fr.ready(s, d).where("date < '1998-01-01'").withColumn("target", safe_ln("rv5")), ["asset"], ["har_5d"], "target").select("asset", "intercept", F.col("coefficients")[0].alias("slope")), "SELECT asset, regr_intercept(target, har_5d) AS intercept, regr_slope(target, har_5d) AS slope FROM one GROUP BY asset", f"{D}, {ONE}")
query("md10_external_predictions", "asset, date, h, sigma:8", lambda s, d: models.external_sigma(fr.feats(s, d).where("vol_10d is not null").select("asset", "date", F.lit(3).alias("h"), F.col("vol_10d").alias("sigma")), features.long_labels(fr.ready(s, d).where("is_origin"))), "SELECT asset, date, 3 AS h, vol_10d AS sigma FROM mask WHERE is_origin AND vol_10d IS NOT NULL", D)
query("cv6_forecast_now", "asset, origin, h, q10:3, q50:3, q90:3, band_%:6", lambda s, d: daily.forecast_now(fr.panel(s, d), calibrate.z_table(daily.calibration_rows(fr.ready(s, d), fr.START, {"vol_21d": "vol_21d"}).where("fold = '2001-01-01'"), ["h"])), "SELECT *, (q90 - q10) / last * 100 AS \"band_%\" FROM (SELECT asset, origin, h, close AS last, close * exp(z[1] * vol_21d * sqrt(h)) AS q10, close * exp(z[2] * vol_21d * sqrt(h)) AS q50, close * exp(z[3] * vol_21d * sqrt(h)) AS q90 FROM (SELECT asset, date AS origin, close, vol_21d FROM feat QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) = 1), z21)", f"""{D}, train21 AS (SELECT * FROM mask JOIN years ON date < fold WHERE vol_21d IS NOT NULL AND fold = TIMESTAMP '2001-01-01' AND {fr.ENDS_FOLD}),
 cut21 AS (SELECT quantile_cont(CAST(epoch_us(date) AS DOUBLE), 0.8) AS cut FROM train21), cal21 AS ({' UNION ALL '.join(f'SELECT CAST({h} AS INTEGER) AS h, y{h} AS y, vol_21d AS sigma FROM train21, cut21 WHERE epoch_us(date) >= cut' for h in features.HORIZONS)}),
 z21 AS (SELECT h, quantile_cont(y / nullif(sigma * sqrt(h), 0), [0.1, 0.5, 0.9]) AS z FROM cal21 GROUP BY h)""")

# Scores
query("ag1_sum_and_size", "asset, total:6, n:i", lambda s, d: fr.settlements(s, d).groupBy("asset").agg(F.sum("rate").alias("total"), F.count("*").alias("n")), "SELECT asset, sum(funding_sum) AS total, sum(funding_n) AS n FROM funding GROUP BY asset", fr.FUNDING)
query("ag4_pinball", "model, l10:4, l50:4, l90:4", lambda s, d: fr.preds_once(s, d).groupBy("model").agg(*(F.avg(score.pinball("y", f"q{int(q * 100)}", q)).alias(f"l{int(q * 100)}") for q in (0.1, 0.5, 0.9))), f"SELECT model, avg({fr.pin(0.1, 'q10')}) AS l10, avg({fr.pin(0.5, 'q50')}) AS l50, avg({fr.pin(0.9, 'q90')}) AS l90 FROM pred GROUP BY model", D)
query("ag5_score", f"model, {fr.METRIC_SPEC}", lambda s, d: score.score(fr.preds_once(s, d)), f"SELECT model, {fr.METRICS} FROM pred GROUP BY model", D)
query("ag6_coverage_by_horizon", f"model, {H7}", lambda s, d: score.coverage_by_horizon(fr.preds(s, d), features.HORIZONS), "SELECT model, " + ", ".join(f"100 * avg(CASE WHEN q10 <= y AND y <= q90 THEN 1.0 ELSE 0.0 END) FILTER (h = {h}) AS h{h}" for h in features.HORIZONS) + " FROM pred GROUP BY model", D)
RETURNS = "SELECT *, y / last - 1 AS ar, q50 / last - 1 AS pr FROM pred"
query("ag7_point_metrics", "model, MAE:4, RMSE:4, MAPE:6, R2_ret:6, DirAcc:6", lambda s, d: score.point_metrics(fr.preds(s, d)), f"SELECT model, avg(abs(y - q50)) AS \"MAE\", sqrt(avg((y - q50) * (y - q50))) AS \"RMSE\", 100 * avg(abs(y - q50) / y) AS \"MAPE\", 1 - sum((ar - pr) * (ar - pr)) / nullif(var_pop(ar) * count(ar), 0) AS \"R2_ret\", avg({HIT.format('q50')}) FILTER (h = 7) AS \"DirAcc\" FROM ({RETURNS}) GROUP BY model", D)
query("ag8_grouped_score", f"model, asset, fold, {fr.METRIC_SPEC}", lambda s, d: score.score(fr.preds_once(s, d), ["model", "asset", "fold"]), f"SELECT model, asset, fold, {fr.METRICS} FROM pred GROUP BY 1, 2, 3", D)
query("ag9_metric_tables", f"grain, model, h:i, asset, fold, regime, {fr.METRIC_SPEC}", lambda s, d: score.metric_tables(fr.preds(s, d)).na.fill(0, ["h"]), f"SELECT CASE WHEN grouping(h) = 0 THEN 'horizon' WHEN grouping(asset) = 0 THEN 'asset' WHEN grouping(regime) = 0 THEN 'regime' WHEN grouping(fold) = 0 THEN 'fold' ELSE 'overall' END AS grain, model, coalesce(h, 0) AS h, asset, fold, regime, {fr.METRICS} FROM regimes GROUP BY GROUPING SETS ((model), (model, h), (model, asset), (model, fold), (model, fold, regime))", D)
query("ag10_fold_regimes", "fold, regime, n:i", lambda s, d: score.with_regimes(fr.preds(s, d)).groupBy("fold", "regime").agg(F.count("*").alias("n")), "SELECT fold, regime, count(*) AS n FROM regimes GROUP BY 1, 2", D)
query("ag11_fixed_cutpoints", "fold, regime, n:i", lambda s, d: score.apply_regimes(fr.preds(s, d).where("fold >= '2000-01-01'"), score.regime_cutpoints(fr.preds(s, d).where("fold < '2000-01-01'"))).groupBy("fold", "regime").agg(F.count("*").alias("n")), "SELECT fold, CASE WHEN regime_driver <= c[1] THEN 'low' WHEN regime_driver <= c[2] THEN 'medium' ELSE 'high' END AS regime, count(*) AS n FROM pred, (SELECT quantile_cont(regime_driver, [1/3, 2/3]) AS c FROM (SELECT DISTINCT asset, origin, regime_driver FROM pred WHERE fold < TIMESTAMP '2000-01-01')) WHERE fold >= TIMESTAMP '2000-01-01' GROUP BY 1, 2", D)
query("ag16_log_vol_mae", "model, h, log_vol_mae:6", lambda s, d: score.log_vol_mae(fr.preds_once(s, d)), "SELECT model, h, avg(CASE WHEN rv > 0 AND sigma > 0 THEN abs(ln(rv) - ln(sigma)) END) AS log_vol_mae FROM pred GROUP BY 1, 2", D)
query("ag17_distinct_counts", "folds:i, assets:i, models:i, origins:i", lambda s, d: fr.preds(s, d).agg(F.count_distinct("fold").alias("folds"), F.count_distinct("asset").alias("assets"), F.count_distinct("model").alias("models"), F.count_distinct("asset", "origin").alias("origins")), "SELECT count(DISTINCT fold) AS folds, count(DISTINCT asset) AS assets, count(DISTINCT model) AS models, count(DISTINCT (asset, origin)) AS origins FROM pred", D)
query("ag19_return_correlation", "a, b, corr:6, n:i", lambda s, d: report.return_correlations(fr.panel(s, d)), "SELECT x.asset AS a, y.asset AS b, corr(x.lr, y.lr) AS corr, count(*) AS n FROM base x JOIN base y ON x.date = y.date WHERE x.lr IS NOT NULL AND y.lr IS NOT NULL GROUP BY 1, 2", D)
query("ag20_ensemble_mean", "asset, origin, h, q10:3, q50:3, q90:3", lambda s, d: score.ensemble_mean(fr.preds_once(s, d), ["asset", "origin", "h"]), "SELECT asset, origin, h, avg(q10) AS q10, avg(q50) AS q50, avg(q90) AS q90 FROM pred GROUP BY 1, 2, 3", D)
query("ag21_winner_by_asset", "asset, winner, margin:6", lambda s, d: report.winners(score.score(fr.preds(s, d), ["asset", "model"])), f"SELECT asset, max(model) FILTER (r = 1) AS winner, max(pinball) FILTER (r = 2) / max(pinball) FILTER (r = 1) - 1 AS margin FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(pinball, 10), model) AS r FROM (SELECT asset, model, {fr.METRICS} FROM pred GROUP BY 1, 2)) GROUP BY asset", D)
query("ag22_ablation_summary", "candidate, overall:6, coverage:6, worst_fold:6", lambda s, d: score.ablation_summary(fr.preds(s, d)), f"SELECT model AS candidate, sum(\"pinball_%\" * origins) / sum(origins) AS overall, sum(coverage * origins) / sum(origins) AS coverage, max(\"pinball_%\") AS worst_fold FROM (SELECT model, fold, count(DISTINCT (asset, origin)) AS origins, {fr.METRICS} FROM pred GROUP BY 1, 2) GROUP BY model", D)
query("ag23_regime_collapse", "model, regime, pinball_%:6", lambda s, d: report.by_regime(fr.preds(s, d)), f"SELECT model, regime, avg(\"pinball_%\") AS \"pinball_%\" FROM (SELECT model, fold, regime, {fr.METRICS} FROM regimes GROUP BY 1, 2, 3) GROUP BY 1, 2", D)
query("ag24_robust_statistics", "vol_5d_median:8, vol_5d_iqr:8, range_median:8, range_iqr:8", lambda s, d: score.robust_statistics(fr.feats(s, d), ["vol_5d", "range"]), "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr" for c in ("vol_5d", "range")) + " FROM feat", D)
query("ag25_channel_statistics", "r_mean:6, r_std:6, rng_mean:6, rng_std:6", lambda s, d: score.channel_statistics(features.lookback_windows(fr.panel(s, d))), f"SELECT avg(coalesce(lr, 0)) AS r_mean, stddev_pop(coalesce(lr, 0)) + 1e-8 AS r_std, avg(coalesce(range, 0)) AS rng_mean, stddev_pop(coalesce(range, 0)) + 1e-8 AS rng_std FROM (SELECT *, row_number() OVER ({fr.W}) AS i, count(*) OVER (PARTITION BY asset) AS n FROM base) AS b, unnest(range(30)) AS u(k) WHERE i - 1 + k >= 29 AND i + k <= n AND n > 30", D)
query("ag26_caption", "first_origin, last_origin, origins:i, models:i", lambda s, d: report.caption(fr.preds(s, d)), "SELECT min(origin) AS first_origin, max(origin) AS last_origin, count(DISTINCT (asset, origin)) AS origins, count(DISTINCT model) AS models FROM pred", D)

# Blending
BLENDED = "blended AS (SELECT a.asset, a.origin, a.h, a.fold, a.y, a.last, w, w * a.sigma + (1 - w) * b.sigma AS sigma, w * a.q10 + (1 - w) * b.q10 AS q10, w * a.q50 + (1 - w) * b.q50 AS q50, w * a.q90 + (1 - w) * b.q90 AS q90 FROM pred a JOIN pred b ON a.asset = b.asset AND a.origin = b.origin AND a.h = b.h AND a.model = 'vol_5d' AND b.model = 'vol_63d', (SELECT CAST(unnest(range(21)) AS DOUBLE) / 20 AS w))"


def pair(spark, d):
    both = fr.preds(spark, d, ("vol_5d", "vol_63d"))
    return [both.where(F.col("model") == m) for m in ("vol_5d", "vol_63d")]


query("cv1_blend", "model, asset, origin, h, sigma:6, q10:3, q50:3, q90:3", lambda s, d: ensemble.blend(*pair(s, d), 0.25), "SELECT *, 'blend' AS model FROM blended WHERE w = 0.25", f"{D}, {BLENDED}")
query("cv2_weight_losses", "weight:2, loss:6", lambda s, d: ensemble.weight_losses(*pair(s, d)), f"SELECT w AS weight, \"pinball_%\" AS loss FROM (SELECT w, {fr.METRICS} FROM blended GROUP BY w)", f"{D}, {BLENDED}")
query("cv2_select_weight", "weight:2, loss:6", lambda s, d: ensemble.select_weight(*pair(s, d)), f"SELECT w AS weight, \"pinball_%\" AS loss FROM (SELECT w, {fr.METRICS} FROM blended GROUP BY w) ORDER BY round(loss, 10), round(abs(w - 0.5), 10), w LIMIT 1", f"{D}, {BLENDED}")
# Validation
query("val1_ohlcv_violations", "duplicates:i, incomplete:i, not_positive:i, crossed:i", lambda s, d: validate.ohlcv_violations(fr.panel(s, d).unionByName(fr.panel(s, d).where("date >= '2001-01-01'")), F.lit("2001-06-01").cast("timestamp_ntz")), "SELECT (SELECT count(*) FROM panel WHERE date >= TIMESTAMP '2001-01-01') AS duplicates, 2 * (SELECT count(*) FROM panel WHERE date >= TIMESTAMP '2001-06-01') AS incomplete, 0 AS not_positive, 0 AS crossed", P)
query("val3_prediction_violations", "nulls:i, duplicates:i, crossed:i, horizons:i", lambda s, d: validate.prediction_violations(fr.preds(s, d).withColumn("q50", F.when(F.col("h") == 2, F.col("q90") + 1).otherwise(F.col("q50"))).withColumn("h", F.when(F.col("h") == 7, 9).otherwise(F.col("h"))), COLUMNS), "SELECT 0 AS nulls, 0 AS duplicates, count(*) FILTER (h = 2) AS crossed, count(*) FILTER (h = 7) AS horizons FROM pred", D)
query("val4_comparability", "incomplete:i, unmatched:i, different:i", lambda s, d: validate.comparability(fr.preds(s, d).where("not (model = 'vol_5d' and h = 3 and asset = '5-LOW')").withColumn("y", F.when((F.col("model") == "vol_63d") & (F.col("h") == 1), F.col("y") + 1).otherwise(F.col("y")))), "SELECT (SELECT count(*) FROM (SELECT DISTINCT asset, origin FROM pred WHERE asset = '5-LOW')) AS incomplete, (SELECT count(*) FROM (SELECT DISTINCT asset, origin FROM pred WHERE asset = '5-LOW')) AS unmatched, (SELECT count(*) FROM (SELECT DISTINCT asset, origin FROM pred)) AS different", D)
query("val6_required_baseline", "present", lambda s, d: validate.has_model(fr.preds(s, d), "vol_21d"), "SELECT count(*) FILTER (model = 'vol_21d') > 0 AS present FROM pred", D)
query("val7_run_id_safety", "run_id, safe", lambda s, d: fr.table(s, d, "customer").select(F.concat("c_mktsegment", F.element_at(F.array(F.lit(""), F.lit("."), F.lit("/x"), F.lit("-9")), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("run_id")).distinct().withColumn("safe", validate.safe_run_id("run_id")), "SELECT run_id, regexp_full_match(run_id, '[A-Za-z0-9][A-Za-z0-9._-]*') AND NOT ends_with(run_id, '.') AS safe FROM (SELECT DISTINCT c_mktsegment || (['', '.', '/x', '-9'])[c_custkey % 4 + 1] AS run_id FROM customer)")


def audit(spark, d) -> DataFrame:
    p = fr.panel(spark, d)
    until = F.lit("2000-01-01").cast("timestamp_ntz")
    worse = p.withColumn("close", F.when(F.col("date") >= until, F.col("close") * 3).otherwise(F.col("close")))
    cols = features.feature_columns(features.daily_features(p).columns)
    return features.altered(features.daily_features(p), features.daily_features(worse), until, cols).agg(F.count("*").alias("differing"))


query("val8_causality_audit", "differing:i", audit, "SELECT 0 AS differing")


def injected(spark, d) -> DataFrame:
    """The same audit of a frame with a column that looks one row ahead, which it must find."""
    p = fr.panel(spark, d)
    until = F.lit("2000-01-01").cast("timestamp_ntz")
    worse = p.withColumn("close", F.when(F.col("date") >= until, F.col("close") * 3).otherwise(F.col("close")))
    ahead = lambda x: x.withColumn("next_close", F.lead("close").over(along()))
    return features.altered(ahead(p), ahead(worse), until, ["close", "next_close"]).agg(F.count("*").alias("differing"))


query("val8_injected_look_ahead", "differing:i", injected, f"SELECT 2 * count(*) AS differing FROM (SELECT date, lead(date) OVER ({fr.W}) AS later FROM panel) WHERE date < TIMESTAMP '2000-01-01' AND later >= TIMESTAMP '2000-01-01'", P)
query("val10_report_inputs", "not_test:i, lacking:i", lambda s, d: validate.report_inputs(fr.preds(s, d).withColumn("split", F.when(F.col("fold") < "2000-01-01", "calibration").otherwise("test")), ["vol_5d", "persistence_vol"]), "SELECT count(*) FILTER (fold < TIMESTAMP '2000-01-01') AS not_test, 1 AS lacking FROM pred", D)
query("val11_staleness", "last, stale", lambda s, d: validate.staleness(fr.panel(s, d), F.lit("2001-08-20").cast("timestamp_ntz")), "SELECT max(date) AS last, max(date) < TIMESTAMP '2001-08-17' AS stale FROM panel", P)

# Sorts, limits, sets
query("st1_sorted_panel", "asset, date, close:4", lambda s, d: fr.panel(s, d).orderBy("asset", "date"), "SELECT * FROM panel", P)
query("st2_sorted_models", "model, pinball:4", lambda s, d: score.score(fr.preds_once(s, d)).orderBy("pinball"), f"SELECT model, {fr.METRICS} FROM pred GROUP BY model", D)
query("st3_top_n", "symbol, quote_volume:4", lambda s, d: ingest.universe(tickers(s, d), 5, stable=()), "SELECT p_brand || '-' || p_partkey AS symbol, p_retailprice * p_size AS quote_volume FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 7 > 0 AND p_partkey % 5 > 0 ORDER BY quote_volume DESC, symbol LIMIT 5")
query("st6_argmin_ties", "weight:2, loss:6", lambda s, d: ensemble.select_weight(*(fr.preds(s, d).where("model = 'vol_5d'") for _ in range(2)), weights=(0.0, 0.25, 0.75, 1.0)), f"SELECT 0.25 AS weight, \"pinball_%\" AS loss FROM (SELECT {fr.METRICS} FROM pred WHERE model = 'vol_5d')", D)
query("st7_runner_up", "asset, best, loss:4", lambda s, d: score.score(fr.preds(s, d), ["asset", "model"]).groupBy("asset").agg(F.min_by("model", "pinball").alias("best"), F.min("pinball").alias("loss")), f"SELECT asset, arg_min(model, pinball) AS best, min(pinball) AS loss FROM (SELECT asset, model, {fr.METRICS} FROM pred GROUP BY 1, 2) GROUP BY asset", D)
query("so1_union_all", "kind, n:i", lambda s, d: fr.panel(s, d).select(F.lit("bar").alias("kind")).unionByName(fr.funding(s, d).select(F.lit("funding").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n")), "SELECT 'bar' AS kind, count(*) AS n FROM panel UNION ALL SELECT 'funding', count(*) FROM funding", D)
query("so2_distinct", "fold, asset, origin, regime_driver:8", lambda s, d: fr.preds_once(s, d).select("fold", "asset", "origin", "regime_driver").distinct(), "SELECT DISTINCT fold, asset, origin, regime_driver FROM pred", D)
query("so4_except", "asset, date", lambda s, d: fr.panel(s, d).select("asset", "date").exceptAll(fr.funding(s, d).select("asset", "date")), "SELECT asset, date FROM panel EXCEPT SELECT asset, date FROM funding", D)
query("so5_key_set_equality", "differing:i", lambda s, d: ensemble.misaligned(*pair(s, d)).agg(F.count("*").alias("differing")), "SELECT 0 AS differing")
query("so5_key_set_difference", "differing:i", lambda s, d: (lambda p: ensemble.misaligned(p[0], p[1].where("asset <> '5-LOW' and h < 7")).agg(F.count("*").alias("differing")))(pair(s, d)), "SELECT count(*) AS differing FROM pred WHERE model = 'vol_5d' AND (asset = '5-LOW' OR h = 7)", D)
query("so6_pivot", "date, " + ", ".join(f"a{i}:4" for i in range(1, 6)), lambda s, d: fr.panel(s, d).groupBy("date").pivot("asset", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.first("close")).toDF("date", "a1", "a2", "a3", "a4", "a5"), "SELECT date, " + ", ".join(f"max(close) FILTER (asset LIKE '{i}-%') AS a{i}" for i in range(1, 6)) + " FROM panel GROUP BY date", P)
query("so7_unpivot", "asset, date, field, value:4", lambda s, d: fr.panel(s, d).unpivot(["asset", "date"], ["open", "close"], "field", "value"), "SELECT asset, date, 'open' AS field, open AS value FROM panel UNION ALL SELECT asset, date, 'close', close FROM panel", P)

# Charts
query("pl1_forecast_bands", "model, asset, origin, y:3, q10:3, q50:3, q90:3", lambda s, d: report.forecast_bands(fr.preds_once(s, d)), "SELECT * FROM pred WHERE h = 7", D)
query("pl2_coverage_line", "model, h, coverage:6", lambda s, d: score.score(fr.preds_once(s, d), ["model", "h"]), f"SELECT model, h, {fr.METRICS} FROM pred GROUP BY 1, 2", D)
query("pl3_pinball_by_model", "model, pinball:4", lambda s, d: score.score(fr.preds_once(s, d)), f"SELECT model, {fr.METRICS} FROM pred GROUP BY 1", D)
query("pl4_volatility_fit", "model, asset, origin, sigma:8, rv:8", lambda s, d: report.volatility_fit(fr.preds_once(s, d)), "SELECT * FROM pred WHERE h = 7", D)
query("pl5_by_asset", "model, asset, pinball_%:6", lambda s, d: score.score(fr.preds_once(s, d), ["model", "asset"]), f"SELECT model, asset, {fr.METRICS} FROM pred GROUP BY 1, 2", D)
query("pl6_price_grid", "asset, date, close:4, growth:8", lambda s, d: report.cumulative_returns(fr.panel(s, d)), f"SELECT *, close / first_value(close) OVER ({fr.W}) AS growth FROM panel", P)
query("pl7_split_line", "asset, origin, fold, sigma:8, rv:8, new_year", lambda s, d: report.split_line(fr.preds(s, d).where("model = 'vol_21d' and h = 1")), "SELECT *, coalesce(year(origin) <> lag(year(origin)) OVER (PARTITION BY asset ORDER BY origin), true) AS new_year FROM pred WHERE model = 'vol_21d' AND h = 1", D)
query("fn_scalars", "asset, date, a:8, b:8, c:8, e:8, f, g", lambda s, d: fr.feats(s, d).where("vol_5d is not null").select("asset", "date", F.log1p("volume").alias("a"), F.exp(F.least("vol_5d", F.lit(2.0))).alias("b"), F.pow("range", F.lit(2)).alias("c"), safe_div("close", F.col("volume") - 1).alias("e"), F.date_format("date", "yyyyMMdd").alias("f"), F.lower(F.replace("asset", F.lit("-"), F.lit("="))).alias("g")), "SELECT asset, date, ln(1 + volume) AS a, exp(least(vol_5d, 2.0)) AS b, range * range AS c, close / nullif(volume - 1, 0) AS e, strftime(date, '%Y%m%d') AS f, lower(replace(asset, '-', '=')) AS g FROM feat WHERE vol_5d IS NOT NULL", D)

# Exact quantiles of groups that no task holds: ranks are narrowed until LIMIT rows are left.
LIMIT = 100
another("ag15_selected_z_table", "ag15_z_table", "fold, model, h, z10:6, z50:6, z90:6", lambda s, d: calibrate.z_table(daily.calibration_rows(fr.ready(s, d), fr.START), limit=LIMIT))
another("ag24_selected_statistics", "ag24_robust_statistics", "vol_5d_median:8, vol_5d_iqr:8, range_median:8, range_iqr:8", lambda s, d: score.robust_statistics(fr.feats(s, d), ["vol_5d", "range"], LIMIT))
PRICED = "l_returnflag, low:4, middle:4, high:4"
query(
    "ag27_selected_prices",
    PRICED,
    lambda s, d: quantiles.quantiles(fr.table(s, d, "lineitem"), ["l_returnflag"], {"q": (F.col("l_extendedprice"), (0.1, 0.5, 0.9))}, LIMIT).select("l_returnflag", *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "middle", "high")))),
    "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS low, quantile_cont(l_extendedprice, 0.5) AS middle, quantile_cont(l_extendedprice, 0.9) AS high FROM lineitem GROUP BY 1",
)

# The panel and its features as bucketed tables
another("snk1_laid_out_features", "wn4_volatility", "asset, date, " + ", ".join(f"vol_{n}d:8" for n in features.WINDOWS), lambda s, d: features.daily_features(layout.kept_in_buckets(fr.panel(s, d), "panel")))
another("snk1_laid_out_score", "ag5_score", f"model, {fr.METRIC_SPEC}", lambda s, d: score.score(daily.predictions(layout.kept_in_buckets(fr.panel(s, d), "panel"), fr.START, keep=layout.kept_in_buckets)))
