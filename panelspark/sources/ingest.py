"""Ingestion of bars, settlements and open interest into panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preset:
    """A bar size: how to cut the bar that still forms, and the least history of an asset."""

    timeframe: str
    cutoff_unit: str
    min_bars: int


# Bar sizes, the unit that an as-of time is cut to, least bars.
PRESETS = {"1d": Preset("1d", "day", 365), "1h": Preset("1h", "hour", 24 * 180), "15m": Preset("15m", "hour", 96 * 180)}


def cutoff(as_of: Column, preset: Preset) -> Column:
    """The time from which bars count as incomplete."""
    return F.date_trunc(preset.cutoff_unit, as_of).cast("timestamp_ntz")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ohlcv(pages: DataFrame, as_of: Column, preset: Preset, min_bars: int | None = None) -> DataFrame:
    """Bars from pages of (seq, symbol, ts_ms, open, high, low, close, volume): the asset is what
    precedes the slash, the forming bar is dropped, the first copy of a bar stays, and assets with
    fewer than min_bars bars are left out."""
    bars = pages.select("seq", F.split_part("symbol", F.lit("/"), F.lit(1)).alias("asset"), F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close", "volume")
    bars = first_by(bars.where(F.col("date") < cutoff(as_of, preset)), ["asset", "date"], [F.col("seq")]).drop("seq")
    enough = bars.groupBy("asset").count().where(F.col("count") >= (preset.min_bars if min_bars is None else min_bars)).select("asset")
    return bars.join(enough, "asset", "left_semi")


def funding(settlements: DataFrame, before: Column | None = None) -> DataFrame:
    """Settlements (asset, ts, rate) to sums and counts by day, up to a day that is still open."""
    days = settlements.select("asset", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), "rate")
    if before is not None:
        days = days.where(F.col("date") < before)
    return days.groupBy("asset", "date").agg(F.sum("rate").alias("funding_sum"), F.count("*").alias("funding_n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """Rows of both; where keys meet, the new row stays, and of several new rows the one that arrived
    last: by the column `arrival`, or else by their order in the table."""
    order = F.col(arrival).cast("long") if arrival else F.monotonically_increasing_id()
    both = old.withColumns({"_batch": F.lit(0), "_order": order}).unionByName(new.withColumns({"_batch": F.lit(1), "_order": order}))
    return first_by(both, keys, [F.col("_batch").desc(), F.col("_order").desc()]).drop("_batch", "_order")


def universe(tickers: DataFrame, n: int, quote: str = "USDT", stable: tuple[str, ...] = ("USDC", "FDUSD", "TUSD", "DAI", "BUSD", "USDP", "EUR")) -> DataFrame:
    """The n active spot pairs against `quote` with the largest volume, bases that are no stable coins."""
    spot = tickers.where(F.col("active") & F.col("spot") & (F.col("quote") == quote) & ~F.col("base").isin(*stable))
    return spot.orderBy(F.desc("quote_volume"), "symbol").limit(n)


def symbol_candidates(asset: str, quote: str = "USDT") -> list[str]:
    """Perpetual symbols to try for an asset: itself, then per thousand."""
    return [f"{asset}/{quote}:{quote}", f"1000{asset}/{quote}:{quote}"]


def perpetual_symbols(chosen: DataFrame, quote: str = "USDT") -> str:
    """The option `symbols` of the paged source for the bases of a universe, which has n rows."""
    return ",".join("|".join(symbol_candidates(r["base"], quote)) for r in chosen.select("base").collect())


def ticks_to_bars(ticks: DataFrame, asset: str, ts: str, price: str, order: str, unit: Column) -> DataFrame:
    """Bars of positive prices; opening and closing prices by (ts, order)."""
    when = F.struct(F.col(ts), F.col(order))
    return ticks.where(F.col(price) > 0).groupBy(F.col(asset).alias("asset"), unit.alias("date")).agg(F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"), F.count("*").cast("double").alias("volume"))
