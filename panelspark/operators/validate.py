"""Validation: one aggregation counts the violations of every rule; the first one in order raises."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["model", "asset", "origin", "h"]
SHARED = ["fold", "y", "last", "rv", "regime_driver"]
RUN_ID = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def count_if(rule: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0)), F.lit(0)).cast("long")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the violations of each rule."""
    return df.agg(*(count_if(r).alias(n) for n, r in rules.items()))


def raise_first(counts: DataFrame, messages: dict[str, str]) -> None:
    """Raises for the first rule, in the order of messages, that is violated."""
    row = counts.first()
    for name, message in messages.items():
        if row[name]:
            raise ValueError(f"{message} ({row[name]} rows)")


def with_duplicates(rows: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """The violations of rules, and as `duplicates` the rows beyond the first of each key. Keys are counted
    before they move; two single rows are joined."""
    more = rows.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("duplicates"))
    return violations(rows, rules).crossJoin(more)


def ohlcv_violations(panel: DataFrame, cutoff: Column) -> DataFrame:
    """Rules of a daily panel: no duplicate, nothing from the cutoff on, prices positive, high >= low."""
    prices = F.least("open", "high", "low", "close")
    return with_duplicates(panel, ["asset", "date"], {"incomplete": F.col("date") >= cutoff, "not_positive": (prices <= 0) | prices.isNull(), "crossed": F.col("high") < F.col("low")})


def check_ohlcv(panel: DataFrame, cutoff: Column) -> None:
    raise_first(ohlcv_violations(panel, cutoff), {"duplicates": "duplicate bars of an asset", "incomplete": "incomplete bar", "not_positive": "prices must be positive", "crossed": "high below low"})


# In the order in which they are reported.
INTRADAY_RULES = {"unsupported": "unsupported assets", "duplicates": "duplicate bars of an asset", "unaligned": "dates must lie on 15 minutes", "unsorted": "rows of an asset must be in order", "missing": "values must be finite numbers", "not_positive": "prices must be positive", "negative_volume": "volume must not be negative", "high": "high below another price", "low": "low above another price", "incomplete": "last bar is not complete"}


def intraday_violations(bars: DataFrame, assets: Sequence[str], as_of: Column, sequence: str | None = None) -> DataFrame:
    """Rules of 15-minute bars. sequence: a column with the order of arrival, if order is to be checked."""
    numbers = ["open", "high", "low", "close", "volume"]
    marked, back = bars, F.lit(False)
    if sequence:
        marked = bars.withColumn("_last", F.lag("date").over(Window.partitionBy("asset").orderBy(sequence)))
        back = F.col("date") < F.col("_last")
    lacking = F.lit(False)
    for c in numbers:
        lacking = lacking | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return with_duplicates(marked, ["asset", "date"], {
        "unsupported": ~F.col("asset").isin(*assets),
        "unaligned": F.pmod(F.unix_micros(F.col("date").cast("timestamp")), F.lit(900_000_000)) != 0,
        "unsorted": back,
        "missing": lacking,
        "not_positive": F.least("open", "high", "low", "close") <= 0,
        "negative_volume": F.col("volume") < 0,
        "high": F.col("high") < F.greatest("open", "low", "close"),
        "low": F.col("low") > F.least("open", "high", "close"),
        "incomplete": F.col("date") + F.expr("interval 15 minutes") > as_of,
    })


def check_intraday(bars: DataFrame, assets: Sequence[str], as_of: Column, sequence: str | None = None) -> None:
    lost = [c for c in ("asset", "date", "open", "high", "low", "close", "volume") if c not in bars.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    counts = intraday_violations(bars, assets, as_of, sequence)
    raise_first(counts, {"unsupported": INTRADAY_RULES["unsupported"]})
    few = {r["asset"]: r["count"] for r in bars.groupBy("asset").count().collect()}
    absent = sorted(set(assets) - set(few))
    if absent:
        raise ValueError(f"missing assets: {absent}")
    raise_first(counts, {k: v for k, v in INTRADAY_RULES.items() if k not in ("unsupported", "incomplete")})
    if min(few.values()) < 2:
        raise ValueError("an asset needs two bars")
    raise_first(counts, {"incomplete": INTRADAY_RULES["incomplete"]})


def prediction_violations(rows: DataFrame, columns: Sequence[str], horizon: int = 7) -> DataFrame:
    """Rules of interval predictions: nothing null, keys unique, quantiles in order, horizons allowed."""
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | F.col(c).isNull()
    return with_duplicates(rows, KEY, {"nulls": nulls, "crossed": (F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90")), "horizons": ~F.col("h").between(1, horizon)})


def check_predictions(rows: DataFrame, columns: Sequence[str], horizon: int = 7) -> None:
    lost = sorted(set(columns) - set(rows.columns))
    if lost:
        raise ValueError(f"missing prediction columns: {lost}")
    if dict(rows.dtypes).get("regime_driver") == "string":
        raise ValueError("regime_driver is not numeric")
    raise_first(prediction_violations(rows, columns, horizon), {"nulls": "null predictions", "duplicates": "duplicate forecast keys", "crossed": "crossed quantiles", "horizons": "horizons out of range"})


def comparability(rows: DataFrame, horizon: int = 7) -> DataFrame:
    """One row: (model, asset, origin) with incomplete horizons, keys that some model lacks, and keys
    whose shared columns differ between models. Counts distinct values by grouping twice."""
    models = rows.agg(F.count_distinct("model").alias("models"))
    whole = rows.groupBy("model", "asset", "origin").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    wanted = F.array(*(F.lit(h) for h in range(1, horizon + 1)))
    short = whole.agg(count_if(F.col("hs") != wanted).alias("incomplete"))
    shared = rows.groupBy("asset", "origin", "h").agg(F.count_distinct("model").alias("n"), F.size(F.collect_set(F.struct(*SHARED))).alias("variants"))
    keys = shared.crossJoin(F.broadcast(models)).agg(count_if(F.col("n") != F.col("models")).alias("unmatched"), count_if(F.col("variants") > 1).alias("different"))
    return short.crossJoin(keys)


def check_comparable(bundles: Sequence[DataFrame], horizons: Sequence[int]) -> None:
    """Each bundle has whole horizons; no model is in two bundles; all models have the same keys and
    shared values."""
    seen: set[str] = set()
    for b, h in zip(bundles, horizons, strict=True):
        models = {r["model"] for r in b.select("model").distinct().collect()}
        if not models:
            raise ValueError("a bundle has no models")
        if models & seen:
            raise ValueError(f"models in several bundles: {sorted(models & seen)}")
        seen |= models
        raise_first(comparability(b, h), {"incomplete": "incomplete horizons", "unmatched": "models differ in keys", "different": "models differ in shared values"})
    whole = bundles[0]
    for b in bundles[1:]:
        whole = whole.unionByName(b)
    raise_first(comparability(whole, max(horizons)), {"unmatched": "bundles differ in keys", "different": "bundles differ in shared values"})


def forecast_violations(rows: DataFrame, horizons: Sequence[int], step: str = "15 minutes") -> DataFrame:
    """Rules of intraday forecasts, the time of the target among them."""
    nulls = F.lit(False)
    for c in ("y", "last", "q10", "q50", "q90", "origin", "target_time"):
        nulls = nulls | F.col(c).isNull()
    marked = rows.withColumn("_n", F.count("*").over(Window.partitionBy("model", "asset", "origin")))
    minutes = int(re.match(r"\d+", step)[0])
    due = F.col("origin") + F.make_dt_interval(mins=F.col("h") * minutes)
    return with_duplicates(marked, KEY, {"nulls": nulls, "horizons": ~F.col("h").isin(*horizons), "not_positive": F.least("y", "last", "q10", "q50", "q90") <= 0, "incomplete": F.col("_n") != len(horizons), "crossed": (F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90")), "target": F.col("target_time") != due})


def has_model(rows: DataFrame, model: str) -> DataFrame:
    """present: whether a required baseline is among the models."""
    return rows.agg((count_if(F.col("model") == model) > 0).alias("present"))


def report_inputs(rows: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Rows that are not of the test part, needed models that lack, and whether calibration ends first."""
    lacking = F.lit(len(needed)) - F.size(F.array_intersect(F.collect_set("model"), F.array(*(F.lit(m) for m in needed))))
    return rows.agg(count_if(F.col("split") != "test").alias("not_test"), lacking.cast("long").alias("lacking"))


def safe_run_id(value: str | Column) -> Column:
    """Whether a run id can name a folder: no separator, no dot at either end."""
    c = F.col(value) if isinstance(value, str) else value
    return c.rlike(f"^{RUN_ID}$") & ~c.endswith(".")


def staleness(df: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """last date and whether it is more than `days` old."""
    return df.agg(F.max("date").alias("last")).select("last", (F.col("last") < now - F.make_dt_interval(days=F.lit(days))).alias("stale"))
