"""Scores of interval and point forecasts, grouped any way."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.exprs import QUANTILES, pinball, safe_div, safe_ln
from panelspark.operators.quantiles import quantiles


def interval_metrics() -> list[Column]:
    """pinball, coverage, width, med_MAPE and pinball_% of the rows of a group."""
    losses = [pinball("y", name, q) for name, q in QUANTILES.items()]
    mean = sum((F.avg(x) for x in losses), F.lit(0.0)) / len(losses)
    relative = sum((F.avg(safe_div(x, "last")) for x in losses), F.lit(0.0)) / len(losses)
    inside = F.when((F.col("q10") <= F.col("y")) & (F.col("y") <= F.col("q90")), 1.0).otherwise(0.0)
    return [
        mean.alias("pinball"),
        (F.avg(inside) * 100).alias("coverage"),
        (F.avg(safe_div(F.col("q90") - F.col("q10"), "last")) * 100).alias("width"),
        (F.avg(safe_div(F.abs(F.col("y") - F.col("q50")), "y")) * 100).alias("med_MAPE"),
        (relative * 100).alias("pinball_%"),
    ]


#: Where terciles are cut.
THIRDS = (1 / 3, 2 / 3)


def score(rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*interval_metrics())


def with_regimes(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds regime: terciles of the driver within a fold, each (asset, origin) counted once."""
    once = rows.select("fold", "asset", "origin", "regime_driver").distinct()
    cuts = quantiles(once, ["fold"], {"cut": (F.col("regime_driver"), THIRDS)}, limit)
    return labelled(rows.join(F.broadcast(cuts), "fold"), F.col("cut")[0], F.col("cut")[1]).drop("cut")


def labelled(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    return rows.withColumn("regime", F.when(F.col("regime_driver") <= low, "low").when(F.col("regime_driver") <= high, "medium").otherwise("high"))


def regime_cutpoints(calibration: DataFrame, limit: int | None = None) -> DataFrame:
    """low and high: terciles of the drivers of distinct calibration origins."""
    once = calibration.select("asset", "origin", "regime_driver").distinct()
    cut = quantiles(once, [], {"cut": (F.col("regime_driver"), THIRDS)}, limit)
    return cut.select(F.col("cut")[0].alias("low"), F.col("cut")[1].alias("high"))


def apply_regimes(rows: DataFrame, cutpoints: DataFrame) -> DataFrame:
    return labelled(rows.join(F.broadcast(cutpoints)), F.col("low"), F.col("high")).drop("low", "high")


def metric_tables(rows: DataFrame) -> DataFrame:
    """All five tables at once: by model, and by model with horizon, asset, fold, and fold and regime.
    `grain` names the table that a row belongs to."""
    sets = [["model"], ["model", "h"], ["model", "asset"], ["model", "fold"], ["model", "fold", "regime"]]
    columns = ["model", "h", "asset", "fold", "regime"]
    grouped = with_regimes(rows).groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns))
    named = {0b01111: "overall", 0b00111: "horizon", 0b01011: "asset", 0b01101: "fold", 0b01100: "regime"}
    grain = F.create_map(*(x for k, v in named.items() for x in (F.lit(k), F.lit(v))))
    out = grouped.agg(F.grouping_id(*columns).alias("gid"), *interval_metrics())
    return out.withColumn("grain", grain[F.col("gid").cast("int")]).drop("gid")


def pivot_by_horizon(rows: DataFrame, value: Column, horizons: Sequence[int]) -> DataFrame:
    """model against horizon; the list of horizons saves a job."""
    wide = rows.withColumn("_v", value).groupBy("model").pivot("h", list(horizons)).agg(F.avg("_v"))
    return wide.select("model", *(F.col(str(h)).alias(f"h{h}") for h in horizons))


def coverage_by_horizon(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return pivot_by_horizon(rows, F.when((F.col("q10") <= F.col("y")) & (F.col("y") <= F.col("q90")), 100.0).otherwise(0.0), horizons)


def same_direction(estimate: str) -> Column:
    return F.when(F.signum(F.col(estimate) - F.col("last")) == F.signum(F.col("y") - F.col("last")), 100.0).otherwise(0.0)


def report(points: DataFrame, horizon: int = 7) -> DataFrame:
    """MAE, MAPE, MASE and DirAcc (at the last horizon) of point forecasts by model."""
    error = F.abs(F.col("y") - F.col("yhat"))
    return points.groupBy("model").agg(F.avg(error).alias("MAE"), (F.avg(safe_div(error, "y")) * 100).alias("MAPE"), F.avg(safe_div(error, "naive_mae")).alias("MASE"), F.avg(F.when(F.col("h") == horizon, same_direction("yhat"))).alias("DirAcc"))


def mape_by_horizon(points: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return pivot_by_horizon(points, safe_div(F.abs(F.col("y") - F.col("yhat")), "y") * 100, horizons)


def point_metrics(rows: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE, R2 of returns and DirAcc at each model's last horizon, of the medians."""
    last = rows.groupBy("model").agg(F.max("h").alias("last_h"))
    d = rows.join(F.broadcast(last), "model").withColumns({"e": F.col("y") - F.col("q50"), "ar": safe_div("y", "last") - 1, "pr": safe_div("q50", "last") - 1})
    total = F.var_pop("ar") * F.count("ar")
    gap = F.col("ar") - F.col("pr")
    return d.groupBy("model").agg(F.avg(F.abs("e")).alias("MAE"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("RMSE"), (F.avg(safe_div(F.abs("e"), "y")) * 100).alias("MAPE"), F.when(total > 0, 1 - safe_div(F.sum(gap * gap), total)).alias("R2_ret"), F.avg(F.when(F.col("h") == F.col("last_h"), same_direction("q50"))).alias("DirAcc"))


def log_vol_mae(rows: DataFrame) -> DataFrame:
    """Mean |ln rv - ln sigma| by model and horizon."""
    return rows.groupBy("model", "h").agg(F.avg(F.abs(safe_ln("rv") - safe_ln("sigma"))).alias("log_vol_mae"))


def headline(rows: DataFrame, keys: Sequence[str] = ("model",), horizon: int = 96) -> DataFrame:
    """Interval metrics and return diagnostics at the last horizon."""
    d = rows.where(F.col("h") == horizon).withColumns({"ar": safe_div("y", "last") - 1, "pr": safe_div("q50", "last") - 1})
    gap = F.col("ar") - F.col("pr")
    total = F.var_pop("ar") * F.count("ar")
    hit = F.when(F.signum("pr") == F.signum("ar"), 100.0).otherwise(0.0)
    return d.groupBy(*keys).agg(*interval_metrics(), F.avg(F.abs(gap)).alias("return_mae"), F.when(total > 0, 1 - safe_div(F.sum(gap * gap), total)).alias("return_r2"), F.corr("ar", "pr").alias("return_correlation"), F.avg(hit).alias("direction_accuracy"))


def direction_clusters(rows: DataFrame, keys: Sequence[str] = ("model",), horizon: int = 96) -> DataFrame:
    """hits and count of each origin: the clusters that the bootstrap draws."""
    hit = F.when(F.signum(safe_div("q50", "last") - 1) == F.signum(safe_div("y", "last") - 1), 1).otherwise(0)
    return rows.where(F.col("h") == horizon).groupBy(*keys, "origin").agg(F.sum(hit).alias("hits"), F.count("*").alias("count"))


def direction_interval(rows: DataFrame, keys: Sequence[str] = ("model",), horizon: int = 96, samples: int = 2000, seed: int = 42) -> DataFrame:
    """Cluster bootstrap interval of the direction accuracy: origins are drawn with replacement by a
    seeded generator, in order of time. A group holds one row an origin."""
    keys = list(keys)

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("origin")
        at = np.random.default_rng(seed).choice(len(group), size=(samples, len(group)), replace=True)
        share = group.hits.to_numpy()[at].sum(axis=1) / group["count"].to_numpy()[at].sum(axis=1) * 100
        low, high = np.quantile(share, [0.025, 0.975])
        return group[keys].iloc[:1].assign(direction_ci_low=low, direction_ci_high=high)

    return direction_clusters(rows, keys, horizon).groupBy(*keys).applyInPandas(draw, ", ".join(f"{k} string" for k in keys) + ", direction_ci_low double, direction_ci_high double")


def poisson_steps(bits: int = 40, most: int = 9) -> list[int]:
    """Where a draw of so many bits passes to the next count of a Poisson variable of mean 1."""
    steps, total, term = [], 0.0, float(np.exp(-1.0))
    for k in range(most):
        total += term
        steps.append(round(total * (1 << bits)))
        term /= k + 1
    return steps


def hashed_interval(rows: DataFrame, keys: Sequence[str] = ("model",), horizon: int = 96, samples: int = 200, seed: int = 42) -> DataFrame:
    """The same by a Poisson bootstrap whose weights come from a counter, the md5 of seed, origin in
    microseconds and sample: no group is gathered, any number of origins will do, and any engine that
    has md5 draws the same."""
    counter = F.concat_ws(":", F.lit(seed), F.unix_micros(F.col("origin").cast("timestamp")), "b")
    draw = F.conv(F.substring(F.md5(counter), 1, 10), 16, 10).cast("long")
    weight = sum((F.when(draw >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
    drawn = direction_clusters(rows, keys, horizon).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("weight", weight)
    shares = drawn.groupBy(*keys, "b").agg((safe_div(F.sum(F.col("hits") * F.col("weight")), F.sum(F.col("count") * F.col("weight"))) * 100).alias("share"))
    cut = shares.groupBy(*keys).agg(F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return cut.select(*keys, F.col("ci")[0].alias("direction_ci_low"), F.col("ci")[1].alias("direction_ci_high"))


def ablation_summary(rows: DataFrame) -> DataFrame:
    """candidate, overall and worst fold of pinball_% and coverage, folds weighted by origins."""
    folds = rows.groupBy(F.col("model").alias("candidate"), "fold").agg(*interval_metrics(), F.count_distinct("asset", "origin").alias("origins"))
    weight = F.sum("origins")
    return folds.groupBy("candidate").agg((F.sum(F.col("pinball_%") * F.col("origins")) / weight).alias("overall"), (F.sum(F.col("coverage") * F.col("origins")) / weight).alias("coverage"), F.max("pinball_%").alias("worst_fold"))


def ensemble_mean(rows: DataFrame, keys: Sequence[str], name: str = "ensemble") -> DataFrame:
    """Mean quantiles of all models."""
    return rows.groupBy(*keys).agg(*(F.avg(q).alias(q) for q in QUANTILES)).withColumn("model", F.lit(name))


def robust_statistics(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Exact median and interquartile range of each column."""
    wide = quantiles(df, [], {c: (F.col(c), (0.25, 0.5, 0.75)) for c in columns}, limit)
    return wide.select(*(x for c in columns for x in (F.col(c)[1].alias(f"{c}_median"), (F.col(c)[2] - F.col(c)[0]).alias(f"{c}_iqr"))))


def robust_scale(df: DataFrame, columns: Sequence[str], clip: float = 10.0) -> DataFrame:
    """(x - median) / IQR clipped to +-clip; null becomes 0 first, an IQR of 0 scales by 1."""
    filled = df.na.fill(0.0, subset=list(columns))
    joined = filled.join(F.broadcast(robust_statistics(filled, columns)))
    made = {c: F.least(F.greatest((F.col(c) - F.col(f"{c}_median")) / F.when(F.col(f"{c}_iqr") == 0, 1.0).otherwise(F.col(f"{c}_iqr")), F.lit(-clip)), F.lit(clip)) for c in columns}
    return joined.withColumns(made).select(*df.columns)


def channel_statistics(windows: DataFrame) -> DataFrame:
    """Mean and population deviation (plus 1e-8) of each channel over all steps of all windows."""
    steps = windows.select(F.inline("window"))
    return steps.agg(*(x for c in ("r", "ar", "rng", "dv") for x in (F.avg(c).alias(f"{c}_mean"), (F.stddev_pop(c) + 1e-8).alias(f"{c}_std"))))
