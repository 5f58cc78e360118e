"""Structured Streaming forms of ingestion. Event times must be TIMESTAMP for watermarks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.sources.ingest import first_by, upsert


def event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def closed_bars(ticks: DataFrame, asset: str, ts: str, price: str, order: str, step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Bars that the watermark has passed; in append mode a bar is emitted once, when it closes."""
    when = F.struct(F.col(ts), F.col(order))
    marked = event_time(ticks, ts).where(F.col(price) > 0).withWatermark(ts, late)
    bars = marked.groupBy(F.window(ts, step), F.col(asset).alias("asset")).agg(F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("asset", F.col("window.start").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close", "volume")


def daily_settlements(settlements: DataFrame, late: str = "1 day") -> DataFrame:
    """Sums and counts by day of a stream of (asset, ts, rate)."""
    marked = event_time(settlements, "ts").withWatermark("ts", late)
    days = marked.groupBy(F.window("ts", "1 day"), "asset").agg(F.sum("rate").alias("funding_sum"), F.count("*").alias("funding_n"))
    return days.select("asset", F.col("window.start").cast("timestamp_ntz").alias("date"), "funding_sum", "funding_n")


def without_repeats(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """The first copy of each (asset, date) within the watermark."""
    return event_time(bars, "date").withWatermark("date", late).dropDuplicatesWithinWatermark(["asset", "date"])


GAP_BARS = "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double, missing_bar int"


def gap_bars(bars: DataFrame, step_minutes: int = 15) -> DataFrame:
    """A stream of bars with one bar for every missing step of an asset: the last close, no volume,
    missing_bar 1. Bars of an asset must come in order of date over the batches; one that is not later
    than the last is left out. The state of an asset is its last date and close."""
    step = step_minutes * 60_000_000

    def fill(key, frames, state):
        held = state.get if state.exists else None
        group = pd.concat(list(frames)).sort_values("date")
        at = group["date"].astype("datetime64[us]").astype("int64").to_numpy()
        out = []
        for when, row in zip(at.tolist(), group.itertuples(index=False), strict=True):
            if held is not None:
                if when <= held[0]:
                    continue
                out += [(key[0], t, *[held[1]] * 4, 0.0, 1) for t in range(held[0] + step, when, step)]
            out.append((key[0], when, row.open, row.high, row.low, row.close, row.volume, 0))
            held = (when, float(row.close))
        if held is not None:
            state.update(held)
        made = pd.DataFrame(out, columns=[c.split()[0] for c in GAP_BARS.split(", ")])
        made["date"] = pd.to_datetime(made["date"], unit="us")
        yield made.astype({"missing_bar": "int32"})

    return bars.groupBy("asset").applyInPandasWithState(fill, GAP_BARS, "at long, close double", "append", "NoTimeout")


def late_gap_bars(bars: DataFrame, late: str = "3 hours", step_minutes: int = 15) -> DataFrame:
    """gap_bars for bars that come in any order. A bar is held until the watermark, `late` behind the
    newest bar of all assets, has reached it; then it is emitted after the bars that miss before it. An
    event-time timer does so for assets without new bars. Of bars of one date the last to arrive while
    it is held stays. Bars behind the watermark are dropped and counted (`dropped_late`). The state of
    an asset is its last emitted date and close and the bars of the last `late`."""
    step = step_minutes * 60_000_000
    prices = ("open", "high", "low", "close", "volume")

    def fill(key, frames, state):
        last, close, held = None, None, {}
        if state.exists:
            last, close, dates, *values = state.get
            held = dict(zip(dates, zip(*values, strict=True), strict=True))
        for group in frames:
            held.update(zip(group["at"].tolist(), group[list(prices)].astype(float).itertuples(index=False, name=None), strict=True))
        mark, out = state.getCurrentWatermarkMs(), []
        for when in sorted(t for t in held if t <= mark * 1000):
            bar = held.pop(when)
            if last is not None:
                out += [(key[0], t, *[close] * 4, 0.0, 1) for t in range(last + step, when, step)]
            out.append((key[0], when, *bar, 0))
            last, close = when, bar[3]
        dates = sorted(held)
        state.update((last, close, dates, *([held[t][i] for t in dates] for i in range(len(prices)))))
        if dates:
            state.setTimeoutTimestamp(max(dates[0] // 1000 - 1, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["asset", "at", *prices, "missing_bar"]).astype({"at": "int64", "missing_bar": "int32", **dict.fromkeys(prices, "float64")})

    marked = event_time(bars, "date").withWatermark("date", late).select("asset", "date", F.unix_micros("date").alias("at"), *prices)
    made = "asset string, at long, " + ", ".join(f"{c} double" for c in prices) + ", missing_bar int"
    kept = "last long, close double, dates array<long>, " + ", ".join(f"{c}s array<double>" for c in prices)
    filled = marked.groupBy("asset").applyInPandasWithState(fill, made, kept, "append", "EventTimeTimeout")
    return filled.select("asset", F.timestamp_micros("at").cast("timestamp_ntz").alias("date"), *prices, "missing_bar")


def dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark in the batches whose progress the query still holds
    (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def keep_latest(path: str, keys: list[str], arrival: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is a new version of the table, and the last two stay, so that
    a batch that is run again reads what it read before. Of rows of one key the last to arrive stays: by
    the column `arrival`, or else by their order in the batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        known = spark.read.parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        table = upsert(known, batch, keys, arrival)
        table.write.mode("overwrite").parquet(f"{path}/v{number}")
        for old in before[:-1]:
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)

    return write


def versions(spark, path: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root)) if fs.exists(root) else []


def _fs(spark, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


class Latest:
    """A table of the last row of each key that a stream keeps up to date, in slots (an expression of
    the row, such as its day). A batch rewrites the slots that it has rows of and nothing else.

    `<path>/data/v<n>/_slot=<s>` holds a slot as batch n left it; `<path>/log/v<n>` is the table after
    batch n, one row a slot with the batch that wrote it last. A log is written aside and then renamed, so
    readers see a batch whole or not at all, and a batch that is run again starts from the log before it.
    The last two logs and what they name stay."""

    def __init__(self, path: str, keys: list[str], arrival: str, slot: str):
        self.path, self.keys, self.arrival, self.slot = path.rstrip("/"), keys, arrival, slot

    def write(self, batch: DataFrame, number: int) -> None:
        """The sink of foreachBatch. Of rows of one key the largest `arrival` stays, of equal ones that of
        the later batch."""
        spark = batch.sparkSession
        before = [v for v in versions(spark, f"{self.path}/log") if v < number]
        log = spark.read.parquet(f"{self.path}/log/v{before[-1]}") if before else spark.createDataFrame([], LOG)
        new = batch.withColumn("_slot", F.expr(self.slot).cast("string")).persist()
        try:
            touched = new.select("_slot").distinct()
            old = [f"{self.path}/data/v{r['version']}/_slot={r['_slot']}" for r in log.join(touched, "_slot").collect()]
            known = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
            both = known.select(*batch.columns).withColumn("_new", F.lit(0)).unionByName(new.select(*batch.columns).withColumn("_new", F.lit(1)))
            merged = first_by(both, self.keys, [F.col(self.arrival).desc(), F.col("_new").desc()]).drop("_new")
            merged.withColumn("_slot", F.expr(self.slot).cast("string")).repartition("_slot").write.mode("overwrite").partitionBy("_slot").parquet(f"{self.path}/data/v{number}")
            after = log.join(touched, "_slot", "left_anti").unionByName(touched.withColumn("version", F.lit(number).cast("long")))
            after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/new/v{number}")
        finally:
            new.unpersist()
        fs, target = _fs(spark, f"{self.path}/log/v{number}")
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(_fs(spark, f"{self.path}/new/v{number}")[1], target):
            raise OSError(f"version {number} could not be put in place")
        self.clean(spark, before[:-1])

    def clean(self, spark, old: list[int]) -> None:
        """Drops old logs, and the slots that no log names."""
        for v in old:
            fs, root = _fs(spark, f"{self.path}/log/v{v}")
            fs.delete(root, True)
        logs = [f"{self.path}/log/v{v}" for v in versions(spark, f"{self.path}/log")]
        named = {(r["version"], r["_slot"]) for r in spark.read.parquet(*logs).distinct().collect()}
        for v in versions(spark, f"{self.path}/data"):
            fs, root = _fs(spark, f"{self.path}/data/v{v}")
            slots = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("_slot=")]
            kept = [s for s in slots if (v, s.getName()[len("_slot=") :]) in named]
            if not kept:
                fs.delete(root, True)
            for s in slots if kept else []:
                if (v, s.getName()[len("_slot=") :]) not in named:
                    fs.delete(s, True)

    def read(self, spark, schema) -> DataFrame:
        """The table after the last batch."""
        found = versions(spark, f"{self.path}/log")
        rows = spark.read.parquet(f"{self.path}/log/v{found[-1]}").collect() if found else []
        paths = [f"{self.path}/data/v{r['version']}/_slot={r['_slot']}" for r in rows]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


LOG = "_slot string, version long"
