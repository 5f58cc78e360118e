"""15-minute bars: the whole grid, gaps, features and daily origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, long_sums, safe_div, safe_ln
from panelspark.operators import blocks

STEP = "15 minutes"
LONGEST = 672
HISTORY = ("log_return", "abs_return", "range_pct", "log_volume", "log_volume_change", "rv_96", "rv_672", "sigma_672", "momentum_96", "momentum_672", "volume_z96")


def complete_grid(bars: DataFrame, step: str = STEP, block_rows: int | None = None) -> DataFrame:
    """Every step from an asset's first to its last bar. A missing bar has the last close as its
    prices, volume 0 and missing_bar 1. The calendar is made an asset at a time by the executors; with
    block_rows the last close is carried over blocks, and rows have pos."""
    ends = bars.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = ends.select("asset", F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("date"))
    joined = grid.join(bars, ["asset", "date"], "left").withColumn("missing_bar", F.col("close").isNull().cast("tinyint"))
    if block_rows:
        joined = blocks.carried(joined, ["close"], block_rows).withColumnRenamed("last_close", "_last")
    else:
        joined = joined.withColumn("_last", F.last("close", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    filled = {c: F.coalesce(c, "_last") for c in ("open", "high", "low", "close")}
    return joined.withColumns(filled | {"volume": F.coalesce("volume", F.lit(0.0))}).drop("_last")


def gap_runs(grid: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Adds run: a number for each stretch of bars that are all missing or all observed."""
    if block_rows:
        turned = (F.col("missing_bar") != F.lag("missing_bar").over(along())).cast("double")
        made = blocks.blocked(grid, lambda df: df.withColumn("_flip", turned), back=1, rows=block_rows, sums=["_flip"])
        return made.withColumn("run", F.col("sum__flip").cast("long") + 1).drop("_flip", "sum__flip", "count__flip")
    flip = F.coalesce((F.col("missing_bar") != F.lag("missing_bar").over(along())).cast("long"), F.lit(1).cast("long"))
    return grid.withColumn("_flip", flip).withColumn("run", F.sum("_flip").over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("_flip")


def gap_statistics(grid: DataFrame) -> DataFrame:
    """observed and synthetic bars, gaps and the longest gap of each asset."""
    by_run = gap_runs(grid).groupBy("asset", "run", "missing_bar").agg(F.count("*").alias("n"))
    gap = F.when(F.col("missing_bar") == 1, F.col("n"))
    return by_run.groupBy("asset").agg(F.sum(F.when(F.col("missing_bar") == 0, F.col("n")).otherwise(0)).alias("observed_bars"), F.coalesce(F.sum(gap), F.lit(0)).alias("synthetic_bars"), F.count(gap).alias("gap_events"), F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_bars"))


def shared_daily_end(grid: DataFrame) -> DataFrame:
    """data_end: the last 23:45 that every asset reaches."""
    ends = grid.groupBy("asset").agg(F.max("date").alias("e")).agg(F.min("e").alias("e"))
    day = F.date_trunc("day", "e").cast("timestamp_ntz") + F.expr("interval 23 hours 45 minutes")
    return ends.select(F.when(day > F.col("e"), day - F.expr("interval 1 day")).otherwise(day).alias("data_end"))


def calendar(date: str = "date") -> dict[str, Column]:
    """Sine and cosine of the time of day and of the day of the week, Monday first."""
    day = (F.hour(date) * 60 + F.minute(date)) / F.lit(1440.0)
    week = F.weekday(date) / F.lit(7.0)
    turn = 6.283185307179586
    return {"tod_sin": F.sin(turn * day), "tod_cos": F.cos(turn * day), "dow_sin": F.sin(turn * week), "dow_cos": F.cos(turn * week)}


def intraday_features(grid: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Returns, range, volume, volatility, momentum and calendar of a whole grid; with block_rows over
    blocks, where volumes are centred on the first of a block instead of the first of all."""
    if block_rows:
        return blocks.blocked(grid, intraday_features, back=LONGEST + 1, rows=block_rows).drop("pos")
    w = along()
    lnc = F.ln("close")
    first = grid.withColumns({"log_return": lnc - F.lag(lnc).over(w), "log_volume": F.log1p("volume"), "range_pct": safe_div(F.col("high") - F.col("low"), "close")})
    volume = F.col("log_volume") - F.first_value("log_volume").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = first.withColumns({"abs_return": F.abs("log_return"), "_sq": F.col("log_return") * F.col("log_return"), "_v": volume})
    first = first.withColumn("_vv", F.col("_v") * F.col("_v"))
    sums = {"_sq96": ("_sq", 96), "_sq672": ("_sq", 672), "_r672": ("log_return", 672), "_v96": ("_v", 96), "_vv96": ("_vv", 96)}
    first = long_sums(first, sums)
    mean, spread = F.col("_v96") / 96, F.col("_vv96") / 96 - (F.col("_v96") / 96) * (F.col("_v96") / 96)
    z = F.when(spread > 1e-12, (F.col("_v") - mean) / F.sqrt(spread))
    made = {
        "log_volume_change": F.col("log_volume") - F.lag("log_volume").over(w),
        "rv_96": F.sqrt(F.greatest("_sq96", F.lit(0.0))),
        "rv_672": F.sqrt(F.greatest("_sq672", F.lit(0.0))),
        "sigma_672": F.sqrt(F.greatest(F.col("_sq672") / 672 - (F.col("_r672") / 672) * (F.col("_r672") / 672), F.lit(0.0))),
        "momentum_96": lnc - F.lag(lnc, 96).over(w),
        "momentum_672": lnc - F.lag(lnc, 672).over(w),
        "volume_z96": F.coalesce(z, F.lit(0.0)),
    }
    for c, n in (("rv_96", "_sq96"), ("rv_672", "_sq672"), ("sigma_672", "_sq672")):
        made[c] = F.when(F.col(n).isNotNull(), made[c])
    return first.withColumns(made).withColumns(calendar()).drop("_sq", "_v", "_vv", *sums)


def short_features(bars: DataFrame) -> DataFrame:
    """The long frame for two-hour forecasts: grid with every value carried forward, y = ln close,
    returns, range, change of the last known log volume, calendar; incomplete rows are dropped."""
    ends = bars.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = ends.select("asset", F.explode(F.sequence("a", "b", F.expr(f"interval {STEP}"))).alias("date"))
    so_far = along().rowsBetween(Window.unboundedPreceding, 0)
    carried = grid.join(bars, ["asset", "date"], "left").withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("open", "high", "low", "close", "volume")})
    carried = carried.withColumns({"y": F.ln("close"), "_lv": F.last(safe_ln("volume"), ignorenulls=True).over(so_far)})
    made = {"lret": F.col("y") - F.lag("y").over(along()), "rng": safe_div(F.col("high") - F.col("low"), "close"), "lvol": F.col("_lv") - F.lag("_lv").over(along())}
    out = carried.withColumns(made).withColumn("aret", F.abs("lret")).withColumns(calendar())
    return out.na.drop(subset=["y", "lret", "rng", "lvol"]).select(F.col("asset").alias("unique_id"), F.col("date").alias("ds"), "y", "lret", "aret", "rng", "lvol", "tod_sin", "tod_cos", "dow_sin", "dow_cos")


def prepare(bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model frame, context frame and gap statistics of bars that were validated before."""
    grid = complete_grid(bars)
    trimmed = grid.join(F.broadcast(shared_daily_end(grid)), F.col("date") <= F.col("data_end")).drop("data_end")
    usable = intraday_features(trimmed).na.drop(subset=list(HISTORY))
    model = usable.select(F.col("asset").alias("unique_id"), F.col("date").alias("ds"), F.ln("close").alias("y"), *HISTORY, "tod_sin", "tod_cos", "dow_sin", "dow_cos")
    context = usable.select("asset", F.col("date").alias("ds"), "open", "close", "missing_bar", "rv_672", "sigma_672", "momentum_96")
    return model, context, gap_statistics(grid)


def eligible_origins(context: DataFrame, horizon: int = 96) -> DataFrame:
    """Midnights that every asset has, with the bar before and `horizon` observed bars from there on."""
    w = Window.partitionBy("asset").orderBy("ds")
    ahead = w.rowsBetween(0, horizon - 1)
    back, span = F.expr(f"interval {STEP}"), F.make_dt_interval(mins=F.lit(15 * (horizon - 1)))
    marked = context.withColumns({"_n": F.count("*").over(ahead), "_gaps": F.sum("missing_bar").over(ahead), "_end": F.max("ds").over(ahead), "_before": F.lag("ds").over(w)})
    good = marked.where((F.hour("ds") == 0) & (F.minute("ds") == 0) & (F.col("_n") == horizon) & (F.col("_gaps") == 0) & (F.col("_end") == F.col("ds") + span) & (F.col("_before") == F.col("ds") - back))
    assets = context.agg(F.count_distinct("asset").alias("assets"))
    return good.groupBy(F.col("ds").alias("origin")).agg(F.count_distinct("asset").alias("n")).join(F.broadcast(assets), F.col("n") == F.col("assets")).select("origin")


def suffixed(columns: list[str], suffix: str) -> str:
    """The one column that ends with a suffix."""
    found = [c for c in columns if c.endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"need one column ending in {suffix}")
    return found[0]


def cross_validation_scores(cv: DataFrame, closes: DataFrame, model: str, minutes: int = 15) -> DataFrame:
    """Rows of (unique_id, ds, cutoff, y, quantiles in logs) to prices, with the price at the cutoff."""
    lo, mid, hi = (f"`{suffixed(cv.columns, s)}`" for s in ("-lo-80.0", "-median", "-hi-80.0"))
    at = closes.select("unique_id", F.col("ds").alias("cutoff"), F.exp("y").alias("last"))
    h = F.round(F.timestamp_diff("MINUTE", F.col("cutoff"), F.col("ds")) / minutes).cast("int")
    joined = cv.join(at, ["unique_id", "cutoff"], "left")
    out = joined.select(F.lit(model).alias("model"), F.col("unique_id").alias("asset"), "cutoff", "ds", h.alias("h"), F.exp("y").alias("y"), "last", F.exp(F.col(lo)).alias("q10"), F.exp(F.col(mid)).alias("q50"), F.exp(F.col(hi)).alias("q90"))
    return out.na.drop()


def cross_validation_forecasts(cv: DataFrame, context: DataFrame, model: str) -> DataFrame:
    """Rows to forecasts from the bar after the cutoff, with the context of the cutoff. The query
    fails where the context has two rows for a key or a distance is no positive number of steps."""
    step = F.expr(f"interval {STEP}")
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("context keys are not unique"))).otherwise(F.first("close"))
    known = context.groupBy("asset", F.col("ds").alias("cutoff")).agg(one.cast("double").alias("last"), F.first("rv_672").alias("regime_driver"), F.first("sigma_672").alias("origin_sigma"), F.first("momentum_96").alias("origin_momentum"))
    minutes = F.timestamp_diff("MINUTE", F.col("cutoff"), F.col("ds"))
    h = F.when((minutes <= 0) | (minutes % 15 != 0), F.raise_error(F.lit("horizons must be positive steps"))).otherwise(minutes / 15).cast("int")
    lo, mid, hi = (f"`{suffixed(cv.columns, s)}`" for s in ("-lo-80.0", "-median", "-hi-80.0"))
    rows = cv.select(F.col("unique_id").alias("asset"), "cutoff", "ds", h.alias("h"), F.exp("y").alias("y"), F.exp(F.col(lo)).alias("q10"), F.exp(F.col(mid)).alias("q50"), F.exp(F.col(hi)).alias("q90")).na.drop()
    joined = rows.join(known, ["asset", "cutoff"], "left")
    return joined.select(F.lit(model).alias("model"), "asset", (F.col("cutoff") + step).alias("origin"), (F.col("ds") + step).alias("target_time"), F.lit("").alias("split"), "h", "y", "last", "regime_driver", "origin_sigma", "origin_momentum", "q10", "q50", "q90")
