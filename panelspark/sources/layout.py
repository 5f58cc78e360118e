"""Panel tables laid out for their readers: bucketed by asset and sorted by asset and date.

A bucket is one file, so windows by asset and groupings by asset read it as it lies: no exchange, and
with ORDERED in the session no sort. Joins on the asset of two tables with as many buckets need none
either. Only whole writes keep one file a bucket; `appended` rows lie in files of their own, after which
readers sort again but still exchange nothing.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.spark import dropped, scratch

#: With this setting a scan of one file a bucket states its order.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BUCKET_ROWS = 4_000_000


def buckets(df: DataFrame, key: str = "asset", rows: int = BUCKET_ROWS) -> int:
    """As many buckets as hold `rows` rows each, but no more than there are keys."""
    found = df.agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("keys")).first()
    return max(1, min(-(-found["n"] // rows), found["keys"]))


def laid_out(df: DataFrame, table: str, path: str, count: int | None = None, key: str = "asset", order: Sequence[str] = ("asset", "date")) -> DataFrame:
    """Writes df as the table in `path`, whole, and returns it read back. `count` is the number of
    buckets, else as many as the rows ask for."""
    count = count or buckets(df, key)
    placed = df.repartition(count, key)
    placed.write.format("parquet").mode("overwrite").option("path", path).bucketBy(count, key).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def appended(df: DataFrame, table: str, count: int, key: str = "asset", order: Sequence[str] = ("asset", "date")) -> DataFrame:
    """Adds rows to a table laid out in `count` buckets."""
    df.repartition(count, key).write.format("parquet").mode("append").bucketBy(count, key).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def kept_in_buckets(df: DataFrame, name: str, count: int | None = None) -> DataFrame:
    """df laid out in a table of its own in the shared folder; dropped when the driver ends."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{own}"
    out = laid_out(df, own, path, count)
    atexit.register(forgotten, spark, own, path)
    return out


def forgotten(spark: SparkSession, table: str, path: str) -> None:
    """Drops a table and its files; a stopped session is left alone."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        dropped(spark, path)
