"""Session with the settings that the operators assume, and tables that cut a plan in two."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "panelspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys may use __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, written now, and its path; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, computed now, once; deleted when the driver ends."""
    return written(df, name)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop, so any store works; a stopped session is left alone."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
