"""Positions of rows within groups, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df with `place`, the position from 0 on of each row in its group, in ascending order of `order`,
    nulls first. Rows are range-sorted and written once, so that each file holds a stretch of a group;
    what a group has in the files before is a sum over files, and no group is a window of its own."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    cut = df.repartitionByRange(store.partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    table, _ = store.materialise(cut.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    heads = table.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_head"), F.count("*").alias("_n"))
    files = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(files), F.lit(0))).drop("_n")
    joined = table.join(heads, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return joined.withColumn("place", F.col("_at") - F.col("_head") + F.col("_before")).select(*df.columns, "place")
