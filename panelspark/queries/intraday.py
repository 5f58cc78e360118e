"""15-minute panels: grids, features, forecasts, conformal intervals, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, safe_div
from panelspark.operators import calibrate, intraday, nhits, report, score, splits, validate
from panelspark.queries import frames as fr
from panelspark.queries.registry import another, query
from panelspark.sources import ingest
from panelspark.spark import kept, scratch
from panelspark.streaming import bars as stream

I = fr.INTRA


def grid(spark, d) -> DataFrame:
    return intraday.complete_grid(fr.bars(spark, d))


def feats(spark, d) -> DataFrame:
    return intraday.intraday_features(grid(spark, d))


def context(spark, d) -> DataFrame:
    return feats(spark, d).na.drop(subset=["rv_672", "momentum_672"]).select("asset", F.col("date").alias("ds"), "open", "close", "missing_bar", "rv_672", "sigma_672", "momentum_96")


def cv_frame(spark, d) -> DataFrame:
    """Rows as a forecaster's cross-validation gives them, in logs: from each 23:45 on, 96 steps of a
    leaning random walk with normal bands."""
    c = context(spark, d)
    cut = c.where("hour(ds) = 23 and minute(ds) = 45").select("asset", F.col("ds").alias("cutoff"), F.col("close").alias("c0"), "sigma_672", "momentum_96", F.explode(F.sequence(F.lit(1), F.lit(96))).alias("k"))
    cut = cut.withColumn("ds", F.col("cutoff") + F.make_dt_interval(mins=F.col("k") * 15))
    mid = F.ln("c0") + F.col("k") / F.lit(960.0) * F.col("momentum_96")
    band = 0.4 * F.col("sigma_672") * F.sqrt(F.col("k").cast("double"))
    joined = cut.join(c.select("asset", "ds", F.ln("close").alias("y")), ["asset", "ds"])
    return joined.select(F.col("asset").alias("unique_id"), "ds", "cutoff", "y", (mid - band).alias("TFT-lo-80.0"), mid.alias("TFT-median"), (mid + band).alias("TFT-hi-80.0"))


def forecasts(spark, d) -> DataFrame:
    return intraday.cross_validation_forecasts(cv_frame(spark, d), context(spark, d), "tft")


def origins(spark, d) -> DataFrame:
    return forecasts(spark, d).select("origin").distinct()


def split(spark, d) -> DataFrame:
    rows = kept(forecasts(spark, d), "forecasts")
    return splits.scheduled_split(rows, rows.select("origin").distinct(), 10, 6, 0)


def calibrated(spark, d) -> DataFrame:
    rows = kept(split(spark, d), "split")
    return calibrate.widen(rows.where("split = 'test'"), calibrate.one_sided_margins(rows.where("split = 'calibration'")), "tft_calibrated")


CV = f"""{I}, cuts AS (SELECT asset, ds AS cutoff, close AS c0, sigma_672, momentum_96, rv_672 FROM context WHERE hour(ds) = 23 AND minute(ds) = 45),
 cv AS (SELECT cuts.*, CAST(k AS INTEGER) AS h, c.ds, c.close AS y, ln(c0) + k / 960.0 * cuts.momentum_96 AS mid, 0.4 * cuts.sigma_672 * sqrt(k) AS band
 FROM cuts, unnest(range(1, 97)) AS u(k) JOIN context c ON c.asset = cuts.asset AND c.ds = cuts.cutoff + k * INTERVAL 15 MINUTE),
 fc AS (SELECT 'tft' AS model, asset, cutoff + INTERVAL 15 MINUTE AS origin, ds + INTERVAL 15 MINUTE AS target_time, h, y, c0 AS last, rv_672 AS regime_driver, sigma_672 AS origin_sigma,
 momentum_96 AS origin_momentum, exp(mid - band) AS q10, exp(mid) AS q50, exp(mid + band) AS q90 FROM cv),
 ranked AS (SELECT origin, row_number() OVER (ORDER BY origin DESC) AS back FROM (SELECT DISTINCT origin FROM fc)),
 parts AS (SELECT fc.*, CASE WHEN back <= 6 THEN 'test' ELSE 'calibration' END AS split FROM fc JOIN ranked USING (origin) WHERE back <= 16),
 sizes AS (SELECT h, count(*) AS n, least(1.0, ceil((count(*) + 1) * 0.9) / count(*)) AS level FROM parts WHERE split = 'calibration' GROUP BY h),
 lows AS (SELECT h, ln(q10) - ln(y) AS x, row_number() OVER (PARTITION BY h ORDER BY ln(q10) - ln(y)) AS r FROM parts WHERE split = 'calibration'),
 highs AS (SELECT h, ln(y) - ln(q90) AS x, row_number() OVER (PARTITION BY h ORDER BY ln(y) - ln(q90)) AS r FROM parts WHERE split = 'calibration'),
 margins AS (SELECT sizes.h, greatest(lows.x, 0) AS lower, greatest(highs.x, 0) AS upper FROM sizes JOIN lows ON lows.h = sizes.h AND lows.r = ceil((n - 1) * level) + 1 JOIN highs ON highs.h = sizes.h AND highs.r = ceil((n - 1) * level) + 1)"""
SPEC = "model, asset, origin, target_time, h, y:4, last:4, regime_driver:6, origin_sigma:6, origin_momentum:6, q10:4, q50:4, q90:4"
HEAD = "return_mae:6, return_r2:6, return_correlation:6, direction_accuracy:6"
HEADLINE = f"""{fr.METRICS}, avg(abs(ar - pr)) AS return_mae, 1 - sum((ar - pr) * (ar - pr)) / nullif(var_pop(ar) * count(ar), 0) AS return_r2, corr(ar, pr) AS return_correlation,
 avg(CASE WHEN sign(pr) = sign(ar) THEN 100.0 ELSE 0.0 END) AS direction_accuracy"""
FINAL = "(SELECT *, y / last - 1 AS ar, q50 / last - 1 AS pr FROM fc WHERE h = 96)"


def feature(name: str, cols: str) -> None:
    query(name, f"asset, date, {cols}", feats, "SELECT * FROM intra", I)


query("src_ticks_to_bars", "asset, date, open:6, high:6, low:6, close:6, volume:1", fr.bars, "SELECT * FROM bars", fr.BARS)
query("src_hourly_bars", "asset, date, close:6, volume:1", lambda s, d: fr.ingest.ticks_to_bars(fr.ticks(s, d), "event_type", "ts", "value", "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, arg_max(value, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value > 0 GROUP BY 1, 2")
query("bt10_grid_completion", "asset, date, open:6, high:6, low:6, close:6, volume:1, missing_bar:i", grid, "SELECT * FROM grid", I)
query("jn10_grid_reindex", "asset, date, close:6", lambda s, d: grid(s, d).select("asset", "date").join(fr.bars(s, d), ["asset", "date"], "left"), "SELECT * FROM wide", I)
query("jn11_carry_forward", "asset, date, close:6", lambda s, d: grid(s, d).where("missing_bar = 1"), "SELECT * FROM grid WHERE missing_bar = 1", I)
query("ag18_gap_statistics", "asset, observed_bars:i, synthetic_bars:i, gap_events:i, max_gap_bars:i", lambda s, d: intraday.gap_statistics(grid(s, d)), "SELECT asset, sum(n) FILTER (missing_bar = 0) AS observed_bars, coalesce(sum(n) FILTER (missing_bar = 1), 0) AS synthetic_bars, count(*) FILTER (missing_bar = 1) AS gap_events, coalesce(max(n) FILTER (missing_bar = 1), 0) AS max_gap_bars FROM (SELECT asset, run, missing_bar, count(*) AS n FROM gaps GROUP BY 1, 2, 3) GROUP BY asset", I)
query("wn33_gap_runs", "asset, date, run:i", lambda s, d: intraday.gap_runs(grid(s, d)), "SELECT * FROM gaps", I)
query("bt9_shared_daily_end", "data_end", lambda s, d: intraday.shared_daily_end(grid(s, d)), "SELECT CASE WHEN x > e THEN x - INTERVAL 1 DAY ELSE x END AS data_end FROM (SELECT e, CAST(date_trunc('day', e) AS TIMESTAMP) + INTERVAL '23 hours 45 minutes' AS x FROM (SELECT min(m) AS e FROM (SELECT max(date) AS m FROM grid GROUP BY asset)))", I)
BLOCK = 1024
query("wn37_blocked_gap_runs", "asset, date, run:i", lambda s, d: intraday.gap_runs(intraday.complete_grid(fr.bars(s, d), block_rows=BLOCK), BLOCK), "SELECT * FROM gaps", I)
query(
    "wn38_blocked_intraday",
    "asset, date, log_return:8, range_pct:8, rv_96:6, rv_672:6, sigma_672:6, momentum_96:8, momentum_672:8, volume_z96:5, log_volume_change:8",
    lambda s, d: intraday.intraday_features(intraday.complete_grid(fr.bars(s, d), block_rows=BLOCK), BLOCK),
    "SELECT * FROM intra",
    I,
)
feature("wn20_bar_returns", "log_return:8, abs_return:8, range_pct:8, log_volume:8, log_volume_change:8")
feature("wn21_realised_volatility", "rv_96:6, rv_672:6")
feature("wn22_sigma_672", "sigma_672:6")
feature("wn23_momentum", "momentum_96:8, momentum_672:8")
feature("wn24_volume_z96", "volume_z96:5")
feature("wn25_calendar", "tod_sin:8, tod_cos:8, dow_sin:8, dow_cos:8")
SHORT = f"""{fr.BARS}, {fr.GRID}, kept AS (SELECT asset, date, close, (high - low) / close AS rng, ln(close) AS y, last_value(CASE WHEN volume > 0 THEN ln(volume) END IGNORE NULLS) OVER ({fr.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM
 (SELECT asset, date, {", ".join(f"last_value({c} IGNORE NULLS) OVER ({fr.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("high", "low", "close", "volume"))} FROM wide))"""
query("wn26_known_log_volume", "unique_id, ds, y:8, lret:8, aret:8, rng:8, lvol:8", lambda s, d: intraday.short_features(fr.bars(s, d)), f"SELECT * FROM (SELECT asset AS unique_id, date AS ds, y, y - lag(y) OVER ({fr.W}) AS lret, abs(y - lag(y) OVER ({fr.W})) AS aret, rng, lv - lag(lv) OVER ({fr.W}) AS lvol FROM kept) WHERE lret IS NOT NULL AND lvol IS NOT NULL", SHORT)


def dense_bars(spark, d) -> DataFrame:
    """Bars of all events, and of those of two users in three."""
    kind = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("some")))
    ticks = fr.table(spark, d, "events").withColumn("event_type", F.explode(kind)).select("event_id", "ts", "event_type", "value")
    return ingest.ticks_to_bars(ticks, "event_type", "ts", "value", "event_id", fr.quarter("ts"))


def dense_context(spark, d) -> DataFrame:
    made = intraday.intraday_features(intraday.complete_grid(dense_bars(spark, d)))
    return made.na.drop(subset=["rv_672", "momentum_672"]).select("asset", F.col("date").alias("ds"), "missing_bar")


DENSE = I.replace("event_type AS asset", "unnest(CASE WHEN user_id % 3 = 0 THEN ['all'] ELSE ['all', 'some'] END) AS asset", 1)
query("bt8_eligible_origins", "origin", lambda s, d: intraday.eligible_origins(dense_context(s, d), 4), "SELECT ds AS origin FROM (SELECT *, count(*) OVER f AS n, sum(missing_bar) OVER f AS gaps, max(ds) OVER f AS e, lag(ds) OVER (PARTITION BY asset ORDER BY ds) AS b FROM context WINDOW f AS (PARTITION BY asset ORDER BY ds ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE hour(ds) = 0 AND minute(ds) = 0 AND n = 4 AND gaps = 0 AND e = ds + INTERVAL 45 MINUTE AND b = ds - INTERVAL 15 MINUTE GROUP BY ds HAVING count(*) = (SELECT count(DISTINCT asset) FROM context)", DENSE)
query("so3_shared_midnights", "ds", lambda s, d: (lambda c: c.where("hour(ds) = 0 and minute(ds) = 0").groupBy("ds").agg(F.count_distinct("asset").alias("n")).join(F.broadcast(c.agg(F.count_distinct("asset").alias("m"))), F.col("n") == F.col("m")))(context(s, d)), "SELECT ds FROM context WHERE hour(ds) = 0 AND minute(ds) = 0 GROUP BY ds HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM context)", I)
DONE = "done AS (SELECT *, (SELECT CASE WHEN x > e THEN x - INTERVAL 1 DAY ELSE x END FROM (SELECT e, CAST(date_trunc('day', e) AS TIMESTAMP) + INTERVAL '23 hours 45 minutes' AS x FROM (SELECT min(m) AS e FROM (SELECT max(date) AS m FROM grid GROUP BY asset)))) AS data_end FROM intra)"
query("bt12_prepared_frames", "asset, n:i, y_sum:3, sigma_sum:3", lambda s, d: (lambda f: f[0].groupBy(F.col("unique_id").alias("asset")).agg(F.count("*").alias("n"), F.sum("y").alias("y_sum"), F.sum("sigma_672").alias("sigma_sum")))(intraday.prepare(fr.bars(s, d))), "SELECT asset, count(*) AS n, sum(ln(close)) AS y_sum, sum(sigma_672) AS sigma_sum FROM done WHERE date <= data_end AND rv_672 IS NOT NULL AND momentum_672 IS NOT NULL GROUP BY asset", f"{I}, {DONE}")
CLOSES = "SELECT 'tft' AS model, asset, cutoff, ds, h, y, c0 AS last, exp(mid - band) AS q10, exp(mid) AS q50, exp(mid + band) AS q90 FROM cv"
query("bt13_cv_scores", "model, asset, cutoff, ds, h, y:4, last:4, q10:4, q50:4, q90:4", lambda s, d: intraday.cross_validation_scores(cv_frame(s, d), context(s, d).select(F.col("asset").alias("unique_id"), "ds", F.ln("close").alias("y")), "tft"), CLOSES, CV)
query("jn4_origin_price", "asset, cutoff, last:4", lambda s, d: intraday.cross_validation_scores(cv_frame(s, d), context(s, d).select(F.col("asset").alias("unique_id"), "ds", F.ln("close").alias("y")), "tft").select("asset", "cutoff", "last").distinct(), "SELECT DISTINCT asset, cutoff, c0 AS last FROM cv", CV)
query("bt14_cv_forecasts", SPEC, forecasts, "SELECT * FROM fc", CV)
query("jn5_origin_context", "asset, origin, origin_sigma:6, origin_momentum:6", lambda s, d: forecasts(s, d).where("h = 1"), "SELECT * FROM fc WHERE h = 1", CV)
query("st4_last_origins", "origin, split", lambda s, d: split(s, d).select("origin", "split").distinct(), "SELECT DISTINCT origin, split FROM parts", CV)
query("bt11_scheduled_split", "split, rows:i, origins:i", lambda s, d: split(s, d).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("origin").alias("origins")), "SELECT split, count(*) AS rows, count(DISTINCT origin) AS origins FROM parts GROUP BY split", CV)
query("st5_last_context_bars", "asset, date, close:6", lambda s, d: report.last_forecast(cv_frame(s, d), fr.bars(s, d), 50)[1], "SELECT bars.* FROM bars WHERE date <= (SELECT max(cutoff) FROM cv) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 50", CV)
query("cv5_volatility_baselines", "model, asset, origin, h, q10:4, q50:4, q90:4", lambda s, d: calibrate.volatility_baselines(forecasts(s, d)), "SELECT m AS model, asset, origin, h, exp(mid - b) AS q10, exp(mid) AS q50, exp(mid + b) AS q90 FROM (SELECT *, ln(last) + CASE WHEN m = 'momentum_vol' THEN h / 96.0 * origin_momentum ELSE 0 END AS mid, 1.2815515655446004 * origin_sigma * sqrt(h) AS b FROM fc, unnest(['persistence_vol', 'momentum_vol']) AS u(m))", CV)
query("cv4_one_sided_margins", "h, lower:6, upper:6", lambda s, d: calibrate.one_sided_margins(split(s, d).where("split = 'calibration'")), "SELECT * FROM margins", CV)
another("cv4_selected_margins", "cv4_one_sided_margins", "h, lower:6, upper:6", lambda s, d: calibrate.one_sided_margins(split(s, d).where("split = 'calibration'"), limit=10))
query("cv4_one_sided_intervals", "model, asset, origin, h, q10:4, q50:4, q90:4", calibrated, "SELECT 'tft_calibrated' AS model, asset, origin, h, q10 * exp(-lower) AS q10, q50, q90 * exp(upper) AS q90 FROM parts JOIN margins USING (h) WHERE split = 'test'", CV)
KH = """cutoffs AS (SELECT cutoff, row_number() OVER (ORDER BY cutoff) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT cutoff FROM cv)),
 halves AS (SELECT cutoff AS split_at FROM cutoffs WHERE i = CAST(floor(m * 0.6) AS BIGINT)), rows8 AS (SELECT *, exp(mid) AS q50, exp(mid + band) AS q90 FROM cv, halves),
 raws AS (SELECT h, quantile_cont(abs(y - q50) / greatest(q90 - q50, 1e-9), 0.8) AS raw FROM rows8 WHERE cutoff < split_at GROUP BY h),
 kh AS (SELECT h, greatest(quantile_cont(raw, 0.5) OVER (ORDER BY h ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 1.0) AS k FROM raws)"""


def scores(spark, d) -> DataFrame:
    return intraday.cross_validation_scores(cv_frame(spark, d), context(spark, d).select(F.col("asset").alias("unique_id"), "ds", F.ln("close").alias("y")), "tft")


def early(spark, d) -> DataFrame:
    c = scores(spark, d)
    at = c.select("cutoff").distinct().select("cutoff", (F.row_number().over(Window.orderBy("cutoff")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("m")).where(F.col("i") == F.floor(F.col("m") * F.lit(0.6))).select(F.col("cutoff").alias("at"))
    return c.join(F.broadcast(at), F.col("cutoff") < F.col("at"))


query("wn28_smoothed_factors", "h, k:5", lambda s, d: calibrate.symmetric_factors(early(s, d)), "SELECT * FROM kh", f"{CV}, {KH}")
query("jn12_factor_lookup", "asset, cutoff, h, k:5", lambda s, d: scores(s, d).join(F.broadcast(calibrate.symmetric_factors(early(s, d))), "h"), "SELECT asset, cutoff, h, k FROM cv JOIN kh USING (h)", f"{CV}, {KH}")
query("cv3_symmetric_conformal", "model, asset, cutoff, h, q10:3, q50:3, q90:3", lambda s, d: calibrate.symmetric_conformal(scores(s, d)), "SELECT 'tft_cal' AS model, asset, cutoff, h, q50 - k * (q90 - q50) AS q10, q50, q50 + k * (q90 - q50) AS q90 FROM rows8 JOIN kh USING (h) WHERE cutoff >= split_at", f"{CV}, {KH}")
query("ag12_headline", f"model, {fr.METRIC_SPEC}, {HEAD}", lambda s, d: score.headline(forecasts(s, d)), f"SELECT model, {HEADLINE} FROM {FINAL} GROUP BY model", CV)
query("ag13_direction_interval", "model, direction_ci_low:6, direction_ci_high:6", lambda s, d: score.direction_interval(forecasts(s, d)))
query("ag13_direction_clusters", "model, origin, hits:i, count:i", lambda s, d: score.direction_clusters(forecasts(s, d)), f"SELECT model, origin, sum(CASE WHEN sign(pr) = sign(ar) THEN 1 ELSE 0 END) AS hits, count(*) AS count FROM {FINAL} GROUP BY 1, 2", CV)
DRAWN = f"""hits AS MATERIALIZED (SELECT model, origin, sum(CASE WHEN sign(pr) = sign(ar) THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM {FINAL} GROUP BY 1, 2),
 drawn AS (SELECT *, CAST('0x' || substr(md5('42:' || epoch_us(origin) || ':' || b), 1, 10) AS BIGINT) AS draw FROM hits, unnest(range(1, 201)) AS u(b)),
 weighed AS (SELECT *, {" + ".join(f"CASE WHEN draw >= {s} THEN 1 ELSE 0 END" for s in score.poisson_steps())} AS weight FROM drawn),
 shares AS (SELECT model, b, 100 * (sum(hits * weight) / nullif(sum(n * weight), 0)) AS share FROM weighed GROUP BY 1, 2)"""
query("ag13_hashed_interval", "model, direction_ci_low:6, direction_ci_high:6", lambda s, d: score.hashed_interval(forecasts(s, d)), "SELECT model, ci[1] AS direction_ci_low, ci[2] AS direction_ci_high FROM (SELECT model, quantile_cont(share, [0.025, 0.975]) AS ci FROM shares GROUP BY model)", f"{CV}, {DRAWN}")
query("ag14_headline_by_asset", f"model, asset, {HEAD}", lambda s, d: score.headline(forecasts(s, d), ["model", "asset"]), f"SELECT model, asset, {HEADLINE} FROM {FINAL} GROUP BY 1, 2", CV)
query("ag14_headline_by_regime", "model, regime, return_mae:6, direction_accuracy:6", lambda s, d: score.headline(score.apply_regimes(forecasts(s, d), score.regime_cutpoints(split(s, d).where("split = 'calibration'"))), ["model", "regime"]), f"SELECT model, regime, {HEADLINE} FROM (SELECT *, CASE WHEN regime_driver <= c[1] THEN 'low' WHEN regime_driver <= c[2] THEN 'medium' ELSE 'high' END AS regime FROM {FINAL}, (SELECT quantile_cont(regime_driver, [1/3, 2/3]) AS c FROM (SELECT DISTINCT asset, origin, regime_driver FROM parts WHERE split = 'calibration'))) GROUP BY 1, 2", CV)
query("jn15_metric_join", "model, pinball:4, clusters:i", lambda s, d: score.headline(forecasts(s, d)).join(score.direction_clusters(forecasts(s, d)).groupBy("model").agg(F.count("*").alias("clusters")), "model"), f"SELECT model, pinball, clusters FROM (SELECT model, {HEADLINE} FROM {FINAL} GROUP BY model) JOIN (SELECT model, count(DISTINCT origin) AS clusters FROM {FINAL} GROUP BY model) USING (model)", CV)
query("md11_external_cv_scores", "asset, h, coverage:6", lambda s, d: score.score(scores(s, d).where("h <= 8"), ["asset", "h"]), "SELECT asset, h, 100 * avg(CASE WHEN exp(mid - band) <= y AND y <= exp(mid + band) THEN 1.0 ELSE 0.0 END) AS coverage FROM cv WHERE h <= 8 GROUP BY 1, 2", CV)


def network_scores(spark, d) -> DataFrame:
    """Scores of the multi-quantile network on its cross-validation; 200 steps, as the bars are few."""
    frame = intraday.short_features(fr.bars(spark, d))
    cv = kept(nhits.cross_validation(frame, windows=20, step=48, shape=nhits.Shape(steps=200)), "cv")
    return score.score(intraday.cross_validation_scores(cv, frame.select("unique_id", "ds", "y"), "nhits"), ["asset", "h"])


query("md11_network_scores", "asset, h, coverage:6, pinball:4", network_scores)
query("md12_external_forecasts", "model, pinball:4, coverage:6", lambda s, d: score.score(forecasts(s, d).unionByName(calibrated(s, d))), f"SELECT model, {fr.METRICS} FROM (SELECT model, y, last, q10, q50, q90 FROM fc UNION ALL SELECT 'tft_calibrated', y, last, q10 * exp(-lower), q50, q90 * exp(upper) FROM parts JOIN margins USING (h) WHERE split = 'test') GROUP BY model", CV)
query("val2_intraday_violations", "unsupported:i, duplicates:i, unaligned:i, missing:i, not_positive:i, high:i, low:i, incomplete:i", lambda s, d: validate.intraday_violations(fr.bars(s, d).withColumn("high", F.when(F.minute("date") == 0, F.col("low") / 2).otherwise(F.col("high"))), ["click", "view"], F.lit("2024-01-20").cast("timestamp_ntz")), "SELECT count(*) FILTER (asset NOT IN ('click', 'view')) AS unsupported, 0 AS duplicates, 0 AS unaligned, 0 AS missing, 0 AS not_positive, count(*) FILTER (minute(date) = 0) AS high, count(*) FILTER (minute(date) = 0) AS low, count(*) FILTER (date + INTERVAL 15 MINUTE > TIMESTAMP '2024-01-20') AS incomplete FROM bars", fr.BARS)
query("val5_forecast_violations", "nulls:i, duplicates:i, horizons:i, not_positive:i, incomplete:i, crossed:i, target:i", lambda s, d: validate.forecast_violations(forecasts(s, d).withColumn("q10", F.when(F.col("h") == 5, F.col("q90") + 1).otherwise(F.col("q10"))), range(1, 97)), "SELECT 0 AS nulls, 0 AS duplicates, 0 AS horizons, 0 AS not_positive, count(*) FILTER (n <> 96) AS incomplete, count(*) FILTER (h = 5) AS crossed, 0 AS target FROM (SELECT *, count(*) OVER (PARTITION BY asset, origin) AS n FROM fc)", CV)


def audit(spark, d) -> DataFrame:
    g = grid(spark, d)
    until = F.lit("2024-01-20").cast("timestamp_ntz")
    late = F.col("date") >= until
    worse = g.withColumns({c: F.when(late, F.col(c) * 1.1).otherwise(F.col(c)) for c in ("open", "high", "low", "close")} | {"volume": F.when(late, F.col("volume") + 1).otherwise(F.col("volume"))})
    from panelspark.operators.features import altered

    return altered(intraday.intraday_features(g), intraday.intraday_features(worse), until, list(intraday.HISTORY)).agg(F.count("*").alias("differing"))


query("val9_causality_audit", "differing:i", audit, "SELECT 0 AS differing")


def injected(spark, d) -> DataFrame:
    """The same audit of a column that looks one bar ahead, which it must find."""
    from panelspark.operators.features import altered

    g = grid(spark, d)
    until = F.lit("2024-01-20").cast("timestamp_ntz")
    worse = g.withColumn("close", F.when(F.col("date") >= until, F.col("close") * 1.1).otherwise(F.col("close")))
    ahead = lambda x: x.withColumn("next_close", F.lead("close").over(along()))
    return altered(ahead(g), ahead(worse), until, ["close", "next_close"]).agg(F.count("*").alias("differing"))


query("val9_injected_look_ahead", "differing:i", injected, f"SELECT 2 * count(*) AS differing FROM (SELECT date, lead(date) OVER ({fr.W}) AS later FROM grid) WHERE date < TIMESTAMP '2024-01-20' AND later >= TIMESTAMP '2024-01-20'", I)
query("pl8_last_forecast", "unique_id, ds, y:6", lambda s, d: report.last_forecast(cv_frame(s, d), fr.bars(s, d), 50)[0], "SELECT asset AS unique_id, ds, ln(y) AS y FROM cv WHERE cutoff = (SELECT max(cutoff) FROM cv)", CV)
query("pl9_report_tables", "model, h, coverage:6, width:6", lambda s, d: score.score(calibrated(s, d), ["model", "h"]), f"SELECT model, h, {fr.METRICS} FROM (SELECT 'tft_calibrated' AS model, h, y, last, q10 * exp(-lower) AS q10, q50, q90 * exp(upper) AS q90 FROM parts JOIN margins USING (h) WHERE split = 'test') GROUP BY 1, 2", CV)


def tested(spark, d) -> tuple[DataFrame, DataFrame]:
    """Calibration rows, and test rows raw and calibrated."""
    rows = kept(split(spark, d), "split")
    calibration, test = (rows.where(F.col("split") == p) for p in ("calibration", "test"))
    return calibration, kept(calibrate.widen(test, calibrate.one_sided_margins(calibration), "tft_calibrated").unionByName(test.withColumn("model", F.lit("tft_raw"))), "tested")


BOTH = f"""{CV}, tested AS (SELECT 'tft_calibrated' AS model, asset, origin, h, y, last, regime_driver, q10 * exp(-lower) AS q10, q50, q90 * exp(upper) AS q90 FROM parts JOIN margins USING (h) WHERE split = 'test'
 UNION ALL SELECT 'tft_raw', asset, origin, h, y, last, regime_driver, q10, q50, q90 FROM parts WHERE split = 'test'),
 ends AS (SELECT *, y / last - 1 AS ar, q50 / last - 1 AS pr FROM tested WHERE h = 96),
 bounds AS (SELECT quantile_cont(regime_driver, [1/3, 2/3]) AS c FROM (SELECT DISTINCT asset, origin, regime_driver FROM parts WHERE split = 'calibration'))"""
query("pl9_forecast_path", "asset, origin, h, y:4, q10:4, q50:4, q90:4", lambda s, d: report.forecast_path(tested(s, d)[1]), "SELECT * FROM tested WHERE model = 'tft_calibrated' AND origin = (SELECT max(origin) FROM tested)", BOTH)
query("pl9_next_day", "model, asset, origin, y:4, q50:4, realised:6, predicted:6", lambda s, d: report.next_day(tested(s, d)[1]), "SELECT *, ar AS realised, pr AS predicted FROM ends", BOTH)
query("pl9_by_asset", "model, asset, pinball_%:6, direction_accuracy:6", lambda s, d: report.performance(tested(s, d)[1], "asset"), f"SELECT model, asset, {HEADLINE} FROM ends GROUP BY 1, 2", BOTH)
query("pl9_by_regime", "model, regime, pinball_%:6, direction_accuracy:6", lambda s, d: report.performance_by_regime(*tested(s, d)), f"SELECT model, regime, {HEADLINE} FROM (SELECT *, CASE WHEN regime_driver <= c[1] THEN 'low' WHEN regime_driver <= c[2] THEN 'medium' ELSE 'high' END AS regime FROM ends, bounds) GROUP BY 1, 2", BOTH)
query("pl9_calibration_comparison", "model, h, coverage:6", lambda s, d: report.calibration_comparison(tested(s, d)[1]), f"SELECT model, h, {fr.METRICS} FROM tested GROUP BY 1, 2", BOTH)


def drained(streaming: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote."""
    spark = streaming.sparkSession
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    run = streaming.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def event_stream(spark, d) -> DataFrame:
    schema = fr.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


query("stream_daily_settlements", "asset, date, funding_sum:4, funding_n:i", lambda s, d: drained(stream.daily_settlements(event_stream(s, d).select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("rate"))), "complete", "daily_settlements"), "SELECT event_type AS asset, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, sum(value) AS funding_sum, count(*) AS funding_n FROM events GROUP BY 1, 2")
query("stream_bars", "asset, date, open:6, high:6, low:6, close:6, volume:1", lambda s, d: drained(stream.closed_bars(event_stream(s, d), "event_type", "ts", "value", "event_id"), "complete", "stream_bars"), "SELECT * FROM bars", fr.BARS)
query("stream_without_repeats", "asset, date", lambda s, d: drained(stream.without_repeats(event_stream(s, d).select(F.col("event_type").alias("asset"), F.date_trunc("day", "ts").alias("date")), "40 days"), "append", "without_repeats").withColumn("date", F.col("date").cast("timestamp_ntz")), "SELECT DISTINCT event_type AS asset, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date FROM events")


def bar_stream(spark, d) -> DataFrame:
    """Bars of the events, written in two files by date and read as a stream of them, the earlier first."""
    bars = kept(fr.bars(spark, d), "bars")
    folder = f"{scratch(spark)}/bar-files-{uuid.uuid4().hex}"
    for late in (False, True):
        bars.where((F.col("date") >= "2024-01-15") == F.lit(late)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(folder)


query("stream_gap_bars", "asset, date, open:6, high:6, low:6, close:6, volume:1, missing_bar:i", lambda s, d: drained(stream.gap_bars(bar_stream(s, d)), "append", "gap_bars"), "SELECT * FROM grid", fr.INTRA)


def shuffled_stream(spark, d) -> DataFrame:
    """Bars of the events in files of five days by their arrival, which is up to two hours after their date."""
    delay = F.make_dt_interval(mins=(F.crc32(F.concat_ws("/", "asset", "date").cast("binary")) % 121).cast("int"))
    bars = kept(fr.bars(spark, d).withColumn("chunk", F.floor(F.unix_date((F.col("date") + delay).cast("date")) / 5)), "bars")
    folder = f"{scratch(spark)}/bar-files-{uuid.uuid4().hex}"
    for r in bars.select("chunk").distinct().orderBy("chunk").collect():
        bars.where(F.col("chunk") == r["chunk"]).drop("chunk").orderBy(F.xxhash64("asset", "date")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(bars.drop("chunk").schema).option("maxFilesPerTrigger", 1).parquet(folder)


HELD = fr.BARS.replace("bars AS (", "bars0 AS (") + ", bars AS (SELECT * FROM bars0 WHERE date <= (SELECT max(date) - INTERVAL 3 HOUR FROM bars0))"
query("stream_late_gap_bars", "asset, date, open:6, high:6, low:6, close:6, volume:1, missing_bar:i", lambda s, d: drained(stream.late_gap_bars(shuffled_stream(s, d)), "append", "late_gap_bars"), "SELECT * FROM grid", f"{HELD}, {fr.GRID}")


def latest_bars(spark, d) -> DataFrame:
    """Bars of the events in a first batch, doubled from 20 January on in a second one; the last arrival stays."""
    bars = kept(fr.bars(spark, d).select("asset", "date", "close"), "bars")
    folder = f"{scratch(spark)}/latest-{uuid.uuid4().hex}"
    for number in (0, 1):
        part = bars.withColumns({"close": F.col("close") * (number + 1), "arrival": F.lit(number)}).where(F.lit(number == 0) | (F.col("date") >= "2024-01-20"))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    table = stream.Latest(f"{folder}/table", ["asset", "date"], "arrival", "date_format(date, 'yyyyMMdd')")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    arriving.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return table.read(spark, schema)


query("stream_keep_latest", "asset, date, close:6, arrival:i", latest_bars, "SELECT asset, date, CASE WHEN date >= '2024-01-20' THEN 2 * close ELSE close END AS close, CASE WHEN date >= '2024-01-20' THEN 1 ELSE 0 END AS arrival FROM bars", fr.BARS)
