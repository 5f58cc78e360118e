"""The daily interval backtest: features, folds, calibration, bands and scores as one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import calibrate, features, score, splits

SIGMAS = {"vol_5d": "vol_5d", "vol_21d": "vol_21d", "vol_63d": "vol_63d"}


def prepared(panel: DataFrame) -> DataFrame:
    """Features, labels and the origin mask: everything looks back only, so all folds share it."""
    return features.origin_mask(features.with_labels(features.daily_features(panel)))


def long_sigmas(rows: DataFrame, sigmas: Mapping[str, str], *keep: str) -> DataFrame:
    """One row a horizon and model, with the model's volatility as sigma."""
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).alias("sigma")) for m, c in sigmas.items()))
    wide = features.long_labels(rows.withColumn("_m", models), "close", "vol_21d", "_m", *keep)
    return wide.select("asset", "date", "close", "vol_21d", *keep, "h", "label_end", "y", "rv", F.inline("_m"))


def calibration_rows(ready: DataFrame, start: str, sigmas: Mapping[str, str] = SIGMAS, wanted: Mapping[str, str] | None = None) -> DataFrame:
    """Long rows of the calibration parts, of the wanted models; rows have the volatilities of all sigmas."""
    folds = splits.fold_calendar(ready, start)
    train = splits.train_rows(ready, folds, list(sigmas.values()))
    return long_sigmas(splits.split_calibration(train).where("part = 'cal'"), wanted or sigmas, "fold")


def as_predictions(rows: DataFrame) -> DataFrame:
    """Long test rows in the columns of PREDICTIONS, without quantiles."""
    return rows.select("model", "asset", F.col("date").alias("origin"), "fold", "h", (F.col("close") * F.exp("y")).alias("y"), F.col("close").alias("last"), "sigma", "rv", F.col("vol_21d").alias("regime_driver"))


def predictions(panel: DataFrame, start: str, sigmas: Mapping[str, str] = SIGMAS, keep: Callable[[DataFrame, str], DataFrame] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Predictions of volatility baselines with calibrated intervals, one row a model, asset, origin
    and horizon. `keep` may write the feature frame, which is read three times, to a table. Rows must
    have the volatilities of all `sigmas`; `only` names the models that are wanted of them."""
    ready = keep(prepared(panel), "features") if keep else prepared(panel)
    folds = splits.fold_calendar(ready, start)
    wanted = {m: c for m, c in sigmas.items() if only is None or m in only}
    tests = long_sigmas(splits.test_rows(ready, folds, list(sigmas.values())), wanted, "fold")
    z = calibrate.z_table(calibration_rows(ready, start, sigmas, wanted))
    out = calibrate.bands(as_predictions(tests), z)
    return out.select("model", "asset", "origin", "fold", "h", "y", "last", "sigma", "rv", "regime_driver", "q10", "q50", "q90")


def baseline_score(panel: DataFrame, start: str) -> DataFrame:
    """The flagship: scores of the 21-day volatility baseline."""
    return score.score(predictions(panel, start, {"vol_21d": "vol_21d"}))


def forecast_now(panel: DataFrame, z: DataFrame, sigma: str = "vol_21d") -> DataFrame:
    """Bands from the latest row of each asset, narrowest first."""
    last = features.latest(features.daily_features(panel)).where(F.col(sigma).isNotNull())
    rows = last.select("asset", F.col("date").alias("origin"), F.col("close").alias("last"), F.col(sigma).alias("sigma")).join(F.broadcast(z.select("h").distinct()))
    out = calibrate.bands(rows, z, ["h"])
    return out.withColumn("band_%", (F.col("q90") - F.col("q10")) / F.col("last") * 100).orderBy("band_%", "asset", "h")
