"""Windows over series of any length, in blocks of rows.

A window by asset is one task an asset. Here rows get their position in their asset from a range sort,
blocks of `rows` positions are groups of their own, and each block also gets the last `back` rows before
it and the first `ahead` rows after it, which are as many as the longest frame needs. What runs from the
first row on (sums, counts, the last known value, the number of a run) is taken within a block and
completed by what the blocks before give, one row a block.

`asset` is a struct of asset and block while the columns are made, so that the same window expressions
serve both forms. An asset and date is one row; a null asset is a series of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, safe_div
from panelspark.spark import kept

#: Rows of a block: some 100 MB of features.
ROWS = 1 << 20


def longest(df: DataFrame) -> int:
    """How many rows the longest series has."""
    return df.groupBy("asset").count().agg(F.max("count")).first()[0] or 0


def block_rows(df: DataFrame, rows: int = ROWS) -> int | None:
    """rows, where some series is longer than two blocks; else None, which means windows by asset."""
    return rows if longest(df) > 2 * rows else None


def positions(df: DataFrame) -> DataFrame:
    """df with pos, the position from 0 on of each row in its asset, in order of date. Range-sorted rows
    are written once; a file holds a stretch of an asset, and what comes before it is a sum over files."""
    if "pos" in df.columns:
        return df
    spark = df.sparkSession
    keys = ("asset", "date")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = kept(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    heads = table.groupBy(F.col("asset").alias("_asset"), part.alias("_part")).agg(F.min("_at").alias("_head"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_asset").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = table.join(heads.withColumn("_before", before), F.col("asset").eqNullSafe(F.col("_asset")) & (part == F.col("_part")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_head") + F.col("_before")).alias("pos"))


def blocked(df: DataFrame, build: Callable[[DataFrame], DataFrame], *, back: int, ahead: int = 0, rows: int = ROWS, sums: Sequence[str] = ()) -> DataFrame:
    """build(df) with windows over blocks, and pos. build adds columns from frames that reach at most
    `back` rows back and `ahead` rows ahead, windows being by asset and in order of date. For each column
    c of `sums`, sum_c and count_c run from the asset's first row on, nulls left out."""
    if rows < max(back, ahead, 1):
        raise ValueError("a block must hold the rows that frames reach")
    block, offset = F.expr(f"pos div {rows}"), F.col("pos") % rows
    homes = F.array_compact(F.array(block, F.when(offset >= rows - back, block + 1), F.when((offset < ahead) & (block > 0), block - 1)))
    dealt = positions(df).withColumns({"_home": block, "_block": F.explode(homes)}).withColumn("asset", F.struct(F.col("asset").alias("name"), F.col("_block").alias("block")))
    made = build(dealt)
    own, so_far = F.col("_block") == F.col("_home"), along().rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({f"sum_{c}": F.coalesce(F.sum(F.when(own, F.col(c))).over(so_far), F.lit(0.0)) for c in sums} | {f"count_{c}": F.count(F.when(own, F.col(c))).over(so_far) for c in sums})
    made = made.where(own).withColumn("asset", F.col("asset.name"))
    if sums:
        made = _with_blocks_before(made, {f"{k}_{c}": F.max_by(f"{k}_{c}", "pos") for k in ("sum", "count") for c in sums}, lambda c: F.sum(c))
        made = made.withColumns({f"{k}_{c}": F.col(f"{k}_{c}") + F.coalesce(f"_before_{k}_{c}", F.lit(0)) for k in ("sum", "count") for c in sums}).drop(*(f"_before_{k}_{c}" for k in ("sum", "count") for c in sums))
    return made.drop("_home", "_block")


def _with_blocks_before(df: DataFrame, ends: dict, over: Callable) -> DataFrame:
    """df, with rows of (asset, _block), and _before_<name>: over(ends of the blocks before), one row a
    block. The frame holds the ends as columns of their own, so nothing is computed twice a row."""
    table = kept(df, "blocks")
    last = table.groupBy(F.col("asset").alias("_a"), F.col("_block").alias("_b")).agg(*(e.alias(n) for n, e in ends.items()))
    w = Window.partitionBy("_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_a", "_b", *(over(F.col(n)).over(w).alias(f"_before_{n}") for n in ends))
    return table.join(last, F.col("asset").eqNullSafe(F.col("_a")) & (F.col("_block") == F.col("_b"))).drop("_a", "_b")


def running_mean(df: DataFrame, c: str, name: str) -> DataFrame:
    """The mean of a column from the asset's first row on, from the sums that blocked() made."""
    made = F.when(F.col(f"count_{c}") > 0, safe_div(f"sum_{c}", F.col(f"count_{c}").cast("double")))
    return df.withColumn(name, made).drop(f"sum_{c}", f"count_{c}")


def carried(df: DataFrame, columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with pos and last_<c>: the last value of each column that is not null, up to the row."""
    found = positions(df).withColumn("_block", F.expr(f"pos div {rows}"))
    inside = Window.partitionBy("asset", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    found = _with_blocks_before(found, {f"last_{c}": F.max_by(f"last_{c}", "pos") for c in columns}, lambda c: F.last(c, ignorenulls=True))
    return found.withColumns({f"last_{c}": F.coalesce(f"last_{c}", f"_before_last_{c}") for c in columns}).drop("_block", *(f"_before_last_{c}" for c in columns))
