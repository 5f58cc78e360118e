"""Shared scratch tables: lineage is cut by tables in the folder the cluster names."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.spark import scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in a local session that names none."""
    return scratch(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, through Hadoop, so any store works; a stopped session is left alone."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table in the shared folder; returns the table read back and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    """How many owner partitions an exchange gets: the session's setting, which is sized to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Tasks that list blocks, at most, and the bits that number the blocks of one of them.
LISTERS, BLOCK_BITS = 256, 23


class Blocks:
    """A table in row groups: the folder, one row a block (`block`, the name of its file and its row
    group; `block_no`, its number), how many there are and how many bytes they hold."""

    def __init__(self, folder: str, rows: DataFrame, count: int, size: int):
        self.folder, self.rows, self.count, self.size = folder, rows, count, size


def block_table(df: DataFrame, name: str, block_bytes: int = 16 << 20) -> Blocks:
    """Writes df to the shared folder, without a shuffle, in row groups of about block_bytes.
    A block's rows and their order are fixed from then on, whichever executor reads it. Blocks are
    listed and numbered by tasks; the driver sees their count and size alone."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", block_bytes).parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))
    listed, _ = materialise(files.repartition(min(LISTERS, partitions(spark))).mapInArrow(_groups(path), "block string, block_no long, size long"), "blocks")
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return Blocks(path, listed.select("block", "block_no").repartition(max(1, min(count, 20_000))), count, size)


def _groups(folder: str):
    def stage(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << BLOCK_BITS
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with _file(folder, name) as f:
                    groups = [(i, g.total_byte_size) for i in range(f.num_row_groups) if (g := f.metadata.row_group(i)).num_rows]
                yield pa.RecordBatch.from_pydict({"block": pa.array([f"{name}#{i}" for i, _ in groups], pa.string()), "block_no": pa.array(range(number, number + len(groups)), pa.int64()), "size": pa.array([n for _, n in groups], pa.int64())})
                number += len(groups)

    return stage


def opened(folder: str):
    """The file system and the path of a folder, given as a URI or a local path."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder)


def _file(folder: str, name: str) -> pq.ParquetFile:
    fs, root = opened(folder)
    return pq.ParquetFile(fs.open_input_file(f"{root}/{name}"))


def read_block(folder: str, block: str) -> pa.Table:
    """The rows of a block, in their fixed order."""
    name, _, group = block.rpartition("#")
    with _file(folder, name) as f:
        return f.read_row_group(int(group), use_threads=False)


def small_batches(spark: SparkSession) -> None:
    """Has the session hand Python batches of whole texts that stay small: 1000 rows, where the
    session leaves the default of 10,000. Both sides of the pipe hold a batch or two at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def give_back() -> None:
    """Returns freed memory to the system: idle workers are kept, and what they hold adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(stage):
    """A map stage that gives memory back when its task ends."""

    @functools.wraps(stage)
    def run(batches):
        try:
            yield from stage(batches)
        finally:
            give_back()

    return run


def lean_group(stage):
    """A group stage that gives memory back after a group."""

    @functools.wraps(stage)
    def run(table):
        try:
            return stage(table)
        finally:
            give_back()

    return run


def lean_cogroup(stage):
    """A stage over two groups that gives memory back after them."""

    @functools.wraps(stage)
    def run(left, right):
        try:
            return stage(left, right)
        finally:
            give_back()

    return run
