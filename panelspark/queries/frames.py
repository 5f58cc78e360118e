"""Panels made of the test tables, in Spark and in SQL.

Daily bars: orders by priority and day. Settlements: discounts less taxes of their lines by day of
shipping. 15-minute bars: values of events by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import features
from panelspark.plans import daily
from panelspark.sources import ingest
from panelspark.spark import kept

START = "1998-01-01"
MARKET = "1-URGENT"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return orders.groupBy(F.col("o_orderpriority").alias("asset"), day.alias("date")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))


def settlements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_discount") - F.col("l_tax")).alias("rate"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("asset"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("asset", F.col("l_shipdate").alias("ts"), "rate")


def funding(spark: SparkSession, d: str) -> DataFrame:
    return ingest.funding(settlements(spark, d))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "event_type", "value")


def quarter(ts: str) -> F.Column:
    return F.expr(f"timestampadd(MINUTE, cast(floor(minute({ts}) / 15) * 15 as int), cast(date_trunc('hour', {ts}) as timestamp_ntz))")


def bars(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ticks_to_bars(ticks(spark, d), "event_type", "ts", "value", "event_id", quarter("ts"))


def feats(spark: SparkSession, d: str) -> DataFrame:
    return features.daily_features(panel(spark, d))


def ready(spark: SparkSession, d: str) -> DataFrame:
    return daily.prepared(panel(spark, d))


def preds(spark: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Predictions of the baselines, or of some of them, written once: most readers use them more than
    once. Building the frame writes it."""
    return kept(preds_once(spark, d, only), "predictions")


def preds_once(spark: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """The same for readers that pass over them once; the features are written."""
    return daily.predictions(panel(spark, d), START, keep=kept, only=only)


W = "PARTITION BY asset ORDER BY date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END"


def floor_sql(x: str, least: str = "1e-6") -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {least}) END"


PANEL = """panel AS MATERIALIZED (SELECT o_orderpriority AS asset, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS date, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
FUNDING = """funding AS (SELECT o_orderpriority AS asset, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS date, sum(l_discount - l_tax) AS funding_sum, count(*) AS funding_n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
BASE = f"""base AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close) - ln(lag(close) OVER ({W})) END AS lr,
 CASE WHEN volume > 0 THEN ln(volume) END AS lv, abs(close - lag(close) OVER ({W})) AS move, (high - low) / nullif(close, 0) AS range FROM panel)"""
FEAT = (
    "feat0 AS (SELECT *, lr * lr AS sq, "
    + ", ".join(f"lag(lr, {k - 1}) OVER ({W}) AS ret_lag{k}" for k in features.RETURN_LAGS)
    + ", "
    + ", ".join(f"{roll('sum', 'lr', n)} AS ret_{n}d, {roll('stddev_samp', 'lr', n)} AS vol_{n}d" for n in features.WINDOWS)
    + f", close / nullif({roll('max', 'close', 63)}, 0) - 1 AS drawdown_63d"
    + f", (lv - {roll('avg', 'lv', 21)}) / nullif({roll('stddev_samp', 'lv', 21)}, 0) AS volume_z21, {roll('avg', 'range', 5)} AS range_5d"
    + f", volume / nullif({roll('avg', 'volume', 21)}, 0) AS vol_ratio, ln(close / nullif({roll('avg', 'close', 63)}, 0)) AS px_vs_ma63"
    + f", avg(move) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS naive_mae FROM base), "
    + "feat AS (SELECT *, "
    + ", ".join(f"ln({floor_sql('sqrt(' + roll('avg', 'sq', n) + ')')}) AS har_{n}d" for n in features.HAR)
    + f", vol_21d / {floor_sql('vol_63d')} AS vol_regime FROM feat0)"
)


def label_columns(h: int) -> str:
    ahead = f"({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    rv = f"CASE WHEN count(lr) OVER {ahead} = {h} THEN sqrt(sum(sq) OVER {ahead} / {h}) END"
    return f"lead(date, {h}) OVER ({W}) AS label_end{h}, ln(lead(close, {h}) OVER ({W}) / close) AS y{h}, {floor_sql(rv)} AS rv{h}"


MASK = (
    "mask0 AS (SELECT *, "
    + ", ".join(label_columns(h) for h in features.HORIZONS)
    + f", row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY asset) AS n FROM feat), "
    + "mask AS MATERIALIZED (SELECT *, idx >= 60 AND idx < n - 7 AND (idx - 60) % 7 = 0 AS is_origin FROM mask0)"
)
FOLDS = f"""folds AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{START}', (SELECT max(date) FROM panel), INTERVAL 1 YEAR)) AS TIMESTAMP) AS fold),
 years AS (SELECT fold, fold + INTERVAL 1 YEAR AS fold_end FROM folds)"""
ENDS_FOLD = " AND ".join(f"label_end{h} <= fold" for h in features.HORIZONS)
ENDS_CUT = " AND ".join(f"epoch_us(label_end{h}) <= cut" for h in features.HORIZONS)
KNOWN = "vol_5d IS NOT NULL AND vol_21d IS NOT NULL AND vol_63d IS NOT NULL"
SPLIT = f"""train AS MATERIALIZED (SELECT * FROM mask JOIN years ON date < fold WHERE {KNOWN} AND {ENDS_FOLD}),
 cuts AS (SELECT fold, quantile_cont(CAST(epoch_us(date) AS DOUBLE), 0.8) AS cut FROM train GROUP BY fold),
 split AS MATERIALIZED (SELECT * FROM (SELECT train.*, cut, CASE WHEN epoch_us(date) >= cut THEN 'cal' WHEN {ENDS_CUT} THEN 'fit' END AS part FROM train JOIN cuts USING (fold)) WHERE part IS NOT NULL),
 tests AS MATERIALIZED (SELECT * FROM mask JOIN years ON date >= fold AND date < fold_end WHERE is_origin AND {KNOWN})"""


def long_sql(source: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT asset, date, close, {keep}, CAST({h} AS INTEGER) AS h, y{h} AS y, rv{h} AS rv, '{m}' AS model, {m} AS sigma, vol_21d AS driver FROM {source}" for h in features.HORIZONS for m in daily.SIGMAS)


PRED = f"""cal AS ({long_sql("(SELECT * FROM split WHERE part = 'cal')", "fold")}),
 z AS (SELECT fold, model, h, quantile_cont(y / nullif(sigma * sqrt(h), 0), [0.1, 0.5, 0.9]) AS z FROM cal GROUP BY ALL),
 test_long AS ({long_sql("tests", "fold")}),
 pred AS MATERIALIZED (SELECT model, asset, date AS origin, fold, h, close * exp(y) AS y, close AS last, sigma, rv, driver AS regime_driver, close * exp(z[1] * sigma * sqrt(h)) AS q10,
 close * exp(z[2] * sigma * sqrt(h)) AS q50, close * exp(z[3] * sigma * sqrt(h)) AS q90 FROM test_long JOIN z USING (fold, model, h)),
 cuts3 AS (SELECT fold, quantile_cont(regime_driver, [1/3, 2/3]) AS c FROM (SELECT DISTINCT fold, asset, origin, regime_driver FROM pred) GROUP BY fold),
 regimes AS (SELECT pred.*, CASE WHEN regime_driver <= c[1] THEN 'low' WHEN regime_driver <= c[2] THEN 'medium' ELSE 'high' END AS regime FROM pred JOIN cuts3 USING (fold))"""
DAILY = ", ".join((PANEL, FUNDING, BASE, FEAT, MASK, FOLDS, SPLIT, PRED))


def pin(q: float, name: str, y: str = "y") -> str:
    return f"greatest({q} * ({y} - {name}), {round(q - 1, 1)} * ({y} - {name}))"


METRICS = f"""(avg({pin(0.1, "q10")}) + avg({pin(0.5, "q50")}) + avg({pin(0.9, "q90")})) / 3 AS pinball, 100 * avg(CASE WHEN q10 <= y AND y <= q90 THEN 1.0 ELSE 0.0 END) AS coverage,
 100 * avg((q90 - q10) / last) AS width, 100 * avg(abs(y - q50) / y) AS "med_MAPE", 100 * (avg({pin(0.1, "q10")} / last) + avg({pin(0.5, "q50")} / last) + avg({pin(0.9, "q90")} / last)) / 3 AS "pinball_%\""""
METRIC_SPEC = "pinball:4, coverage:6, width:6, med_MAPE:6, pinball_%:6"

BARS = """ticks AS (SELECT event_type AS asset, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS date, value, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id AS k FROM events WHERE value > 0),
 bars AS (SELECT asset, date, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""
GRID = f"""cells AS (SELECT asset, CAST(unnest(generate_series(min(date), max(date), INTERVAL 15 MINUTE)) AS TIMESTAMP) AS date FROM bars GROUP BY asset),
 wide AS (SELECT cells.asset, cells.date, open, high, low, close, volume, CASE WHEN close IS NULL THEN 1 ELSE 0 END AS missing_bar,
 last_value(close IGNORE NULLS) OVER (PARTITION BY cells.asset ORDER BY cells.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM cells LEFT JOIN bars ON cells.asset = bars.asset AND cells.date = bars.date),
 grid AS MATERIALIZED (SELECT asset, date, coalesce(open, kept) AS open, coalesce(high, kept) AS high, coalesce(low, kept) AS low, coalesce(close, kept) AS close, coalesce(volume, 0) AS volume, missing_bar FROM wide),
 flips AS (SELECT *, CASE WHEN missing_bar = lag(missing_bar) OVER ({W}) THEN 0 ELSE 1 END AS flip FROM grid),
 gaps AS (SELECT *, sum(flip) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM flips)"""
TURN = "6.283185307179586"
INTRA_FEAT = f"""intra0 AS (SELECT *, ln(close) - lag(ln(close)) OVER ({W}) AS log_return, ln(1 + volume) AS log_volume, (high - low) / nullif(close, 0) AS range_pct FROM grid),
 intra1 AS (SELECT *, abs(log_return) AS abs_return, log_return * log_return AS sq, log_volume - lag(log_volume) OVER ({W}) AS log_volume_change FROM intra0),
 intra AS (SELECT *, sqrt({roll("sum", "sq", 96)}) AS rv_96, sqrt({roll("sum", "sq", 672)}) AS rv_672, {roll("stddev_pop", "log_return", 672)} AS sigma_672,
 ln(close) - lag(ln(close), 96) OVER ({W}) AS momentum_96, ln(close) - lag(ln(close), 672) OVER ({W}) AS momentum_672,
 coalesce((log_volume - {roll("avg", "log_volume", 96)}) / nullif({roll("stddev_pop", "log_volume", 96)}, 0), 0) AS volume_z96,
 sin({TURN} * (hour(date) * 60 + minute(date)) / 1440.0) AS tod_sin, cos({TURN} * (hour(date) * 60 + minute(date)) / 1440.0) AS tod_cos,
 sin({TURN} * (isodow(date) - 1) / 7.0) AS dow_sin, cos({TURN} * (isodow(date) - 1) / 7.0) AS dow_cos FROM intra1),
 context AS (SELECT asset, date AS ds, open, close, missing_bar, rv_672, sigma_672, momentum_96 FROM intra WHERE rv_672 IS NOT NULL AND momentum_672 IS NOT NULL)"""
INTRA = ", ".join((BARS, GRID, INTRA_FEAT))
