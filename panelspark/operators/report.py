"""The tables behind the charts. Drawing them is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, safe_div, safe_ln
from panelspark.operators import score


def forecast_bands(rows: DataFrame, horizon: int = 7, models: Sequence[str] | None = None) -> DataFrame:
    out = rows.where(F.col("h") == horizon)
    out = out.where(F.col("model").isin(*models)) if models else out
    return out.select("model", "asset", "origin", "y", "q10", "q50", "q90")


def volatility_fit(rows: DataFrame, horizon: int = 7) -> DataFrame:
    return rows.where(F.col("h") == horizon).select("model", "asset", "origin", "sigma", "rv")


def by_regime(rows: DataFrame) -> DataFrame:
    """Mean over folds of the fold's pinball_%, by model and regime."""
    folds = score.with_regimes(rows).groupBy("model", "fold", "regime").agg(*score.interval_metrics())
    return folds.groupBy("model", "regime").agg(F.avg("pinball_%").alias("pinball_%"))


def caption(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"), F.count_distinct("asset", "origin").alias("origins"), F.count_distinct("model").alias("models"))


def cumulative_returns(panel: DataFrame) -> DataFrame:
    first = F.first_value("close").over(along().rowsBetween(Window.unboundedPreceding, 0))
    return panel.select("asset", "date", "close", safe_div("close", first).alias("growth"))


def return_correlations(panel: DataFrame) -> DataFrame:
    """Correlation of daily returns for every pair of assets, over the dates that both have."""
    r = panel.select("asset", "date", (safe_ln("close") - safe_ln(F.lag("close").over(along()))).alias("lr")).na.drop()
    a, b = r.select("date", F.col("asset").alias("a"), F.col("lr").alias("x")), r.select("date", F.col("asset").alias("b"), F.col("lr").alias("z"))
    return a.join(b, "date").groupBy("a", "b").agg(F.corr("x", "z").alias("corr"), F.count("*").alias("n"))


def split_line(rows: DataFrame) -> DataFrame:
    """Rows by time with their fold and whether a new year begins."""
    w = Window.partitionBy("asset").orderBy("origin")
    year = F.year("origin")
    return rows.select("asset", "origin", "fold", "sigma", "rv", F.coalesce(year != F.lag(year).over(w), F.lit(True)).alias("new_year"))


def last_forecast(points: DataFrame, bars: DataFrame, context: int) -> tuple[DataFrame, DataFrame]:
    """The last cutoff's forecast and the `context` bars of each asset before it."""
    last = points.agg(F.max("cutoff").alias("cutoff"))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    past = bars.join(F.broadcast(last), F.col("date") <= F.col("cutoff")).withColumn("_r", rank).where(F.col("_r") <= context).drop("_r", "cutoff")
    return points.join(F.broadcast(last), "cutoff", "left_semi"), past


def forecast_path(test: DataFrame, model: str = "tft_calibrated") -> DataFrame:
    """The last origin's path of each asset: h, y and quantiles."""
    last = test.agg(F.max("origin").alias("origin"))
    return test.where(F.col("model") == model).join(F.broadcast(last), "origin").select("asset", "origin", "h", "y", "q10", "q50", "q90")


def next_day(test: DataFrame, horizon: int = 96) -> DataFrame:
    """What every model expected of the last step, with its predicted and the realised return."""
    rows = test.where(F.col("h") == horizon)
    return rows.select("model", "asset", "origin", "y", "q50", (safe_div("y", "last") - 1).alias("realised"), (safe_div("q50", "last") - 1).alias("predicted"))


def performance(test: DataFrame, key: str, horizon: int = 96) -> DataFrame:
    """pinball_% and direction accuracy at the last step by model and key."""
    return score.headline(test, ["model", key], horizon).select("model", key, "pinball_%", "direction_accuracy")


def performance_by_regime(calibration: DataFrame, test: DataFrame, horizon: int = 96) -> DataFrame:
    """The same by regimes whose bounds the calibration part fixes."""
    return performance(score.apply_regimes(test, score.regime_cutpoints(calibration)), "regime", horizon)


def calibration_comparison(test: DataFrame, models: Sequence[str] = ("tft_raw", "tft_calibrated")) -> DataFrame:
    """Coverage by step, raw and calibrated."""
    return score.score(test.where(F.col("model").isin(*models)), ["model", "h"]).select("model", "h", "coverage")


def winners(scores: DataFrame, metric: str = "pinball") -> DataFrame:
    """asset, the best model and by how much the second is worse."""
    order = Window.partitionBy("asset").orderBy(F.round(metric, 10), "model")
    two = scores.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    return two.groupBy("asset").agg(F.max(F.when(F.col("_r") == 1, F.col("model"))).alias("winner"), (safe_div(F.max(F.when(F.col("_r") == 2, F.col(metric))), F.max(F.when(F.col("_r") == 1, F.col(metric)))) - 1).alias("margin"))
