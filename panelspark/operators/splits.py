"""Walk-forward splitting: folds, purging, the calibration part, origins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.features import HORIZONS
from panelspark.operators.quantiles import quantiles


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def fold_calendar(df: DataFrame, start: str) -> DataFrame:
    """fold (start of a test year) and fold_end, yearly from `start` to the last date of df."""
    last = df.agg(F.max("date").alias("last")).where("last is not null")
    begin = F.lit(start).cast("timestamp_ntz")
    starts = last.where(F.col("last") >= begin).select(F.explode(F.sequence(begin, F.col("last"), F.expr("interval 1 year"))).alias("fold"))
    return starts.withColumn("fold_end", F.col("fold") + F.expr("interval 1 year"))


def purged(label_ends: Sequence[str], boundary: Column) -> Column:
    """All label ends are known and none lies after the boundary; one that equals it stays."""
    ok = F.lit(True)
    for c in label_ends:
        ok = ok & F.coalesce(F.col(c) <= boundary, F.lit(False))
    return ok


def train_rows(labelled: DataFrame, folds: DataFrame, needed: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows before each fold whose labels end by its start and whose needed columns are known. The
    calendar has one row a year and is broadcast."""
    ends = [f"label_end{h}" for h in horizons]
    joined = labelled.na.drop(subset=list(needed)).join(F.broadcast(folds), F.col("date") < F.col("fold"))
    return joined.where(purged(ends, F.col("fold")))


def test_rows(masked: DataFrame, folds: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Origins inside each fold's year; a fold without any yields nothing."""
    return masked.where("is_origin").na.drop(subset=list(needed)).join(F.broadcast(folds), (F.col("date") >= F.col("fold")) & (F.col("date") < F.col("fold_end")))


def calibration_cut(train: DataFrame, keys: Sequence[str] = ("fold",), part: float = 0.2, limit: int | None = None) -> DataFrame:
    """keys and cut: the linear quantile of the dates, in microseconds, from which rows calibrate."""
    return quantiles(train, keys, {"cuts": (micros("date"), [1 - part])}, limit).select(*keys, F.col("cuts")[0].alias("cut"))


def split_calibration(train: DataFrame, keys: Sequence[str] = ("fold",), part: float = 0.2, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Training rows with part `cal` (from the cut on) or `fit` (before it, purged at the cut); rows
    whose labels reach over the cut are in neither."""
    joined = train.join(F.broadcast(calibration_cut(train, keys, part)), list(keys))
    ends = F.lit(True)
    for h in horizons:
        ends = ends & (micros(f"label_end{h}") <= F.col("cut"))
    before = micros("date") < F.col("cut")
    return joined.withColumn("part", F.when(~before, F.lit("cal")).when(ends, F.lit("fit"))).where("part is not null")


def with_enough(split: DataFrame, tests: DataFrame, keys: Sequence[str], least: int = 200) -> DataFrame:
    """The keys whose fit part has `least` rows and that have test rows."""
    fit = split.where("part = 'fit'").groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    return fit.join(tests.select(*keys).distinct(), list(keys), "left_semi")


def scheduled_split(frame: DataFrame, eligible: DataFrame, n_calibration: int = 219, n_test: int = 146, least_test: int = 100) -> DataFrame:
    """Adds split to the rows of the last n_calibration + n_test origins. The query fails where
    origins are too few or one of them is not eligible; too few test origins raise at once."""
    if n_test < least_test:
        raise ValueError(f"fewer than {least_test} test origins")
    wanted = n_calibration + n_test
    last = frame.select("origin").distinct().orderBy(F.desc("origin")).limit(wanted)
    known = last.join(eligible.select("origin", F.lit(True).alias("eligible")).distinct(), "origin", "left")
    everything = Window.partitionBy()
    ranked = known.withColumns({"back": F.row_number().over(Window.orderBy(F.desc("origin"))), "found": F.count("*").over(everything), "good": F.count("eligible").over(everything)})
    name = F.when(F.col("back") <= n_test, F.lit("test")).otherwise(F.lit("calibration"))
    short = F.raise_error(F.lit(f"need {wanted} scheduled origins"))
    bad = F.raise_error(F.lit("scheduled origins are not eligible"))
    named = ranked.select("origin", F.when(F.col("found") < wanted, short).when(F.col("good") < wanted, bad).otherwise(name).cast("string").alias("split"))
    return frame.drop("split").join(F.broadcast(named), "origin")
