"""Exact quantiles of groups of any size.

`percentile` keeps the distinct values of a group in one buffer. Here every rank that a quantile needs has
a range of values that holds it. A round takes a mergeable summary of what lies in the range and narrows it
to a few hundredths, or to one value; counts, which are exact, say in which part the rank is, so a poor
summary costs rounds and nothing else. Once a range holds at most `limit` rows they are sorted and the row is
taken. Every step is an aggregation with partial sums, or a sort of at most `limit` rows a rank; the driver
sees whether ranges are left. Values are those of `percentile`, with linear interpolation; nulls are left out.

Rows meet the ranges where they lie: ranges are broadcast, as they are few beside the rows. With more than
RANKS of them this holds for groups of more than GROUP rows only, and the rows of the other groups are
shuffled by group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.spark import dropped, written

LIMIT = 1 << 20
GRID = 128
ACCURACY = 2000
#: Ranks that are broadcast together.
RANKS = 10_000
#: Rows of a group that one task may be given.
GROUP = 1 << 20


def quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[Column, Sequence[float]]], limit: int | None = None) -> DataFrame:
    """keys and, for each name of values, an array of the quantiles of a column. Without a limit a group
    is a buffer; with one, groups of more rows are narrowed first."""
    if limit is None:
        return df.groupBy(*keys).agg(*(F.percentile(c, F.array(*(F.lit(float(q)) for q in qs))).alias(name) for name, (c, qs) in values.items()))
    group = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    out = df.select(group.alias("_k")).distinct() if keys else df.sparkSession.range(1).select(F.struct(F.lit(0).alias("k0")).alias("_k"))
    for name, (c, qs) in values.items():
        found = select(df.select(group.alias("_k"), c.cast("double").alias("_v")), qs, limit).withColumnRenamed("_k", "_g").withColumnRenamed("q", name)
        out = out.join(found, F.col("_k").eqNullSafe(F.col("_g")), "left").drop("_g")
    return out.select(*(F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)), *values)


def select(rows: DataFrame, qs: Sequence[float], limit: int, ranks: DataFrame | None = None) -> DataFrame:
    """_k and q, the array of quantiles, of rows (_k, _v). Given ranks (_k, rank from 0 on, within the
    group's rows that are not null), instead _k, rank and _v, the value of each."""
    spark = rows.sparkSession
    rows, held = written(rows.where("_v is not null"), "values")
    begun, sizes = written(rows.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside")), "groups")
    places = [F.lit(float(q)) * (F.col("inside") - 1) for q in qs]
    needed = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in places)))) if qs else F.array()
    asked = begun.withColumn("rank", F.explode(needed)) if ranks is None else begun.join(ranks.select(F.col("_k").alias("_g"), "rank"), same_group()).drop("_g")
    state, begin = written(asked.select("_k", F.col("rank").cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"), "ranks")
    if state.limit(RANKS + 1).count() <= RANKS:
        found, *paths = ranked(rows, state, limit, where_they_lie)
    else:
        large = F.broadcast(begun.where(F.col("inside") > GROUP).select(F.col("_k").alias("_g")))
        of = lambda df, kind: df.join(large, same_group(), kind)
        first, path = ranked(of(rows, "left_semi"), of(state, "left_semi"), limit, where_they_lie)
        second, other = ranked(of(rows, "left_anti"), of(state, "left_anti"), limit, by_group)
        found, paths = first.unionByName(second), [path, other]
    if ranks is None:
        by_rank = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("v")).join(begun.select(F.col("_k").alias("_g"), "inside"), same_group())
        at = lambda p: F.element_at("v", p)
        made = [at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p)) for p in places]
        found = by_rank.select("_k", F.array(*made).alias("q"))
    result, _ = written(found, "quantiles")
    for path in (begin, *paths, sizes, held):
        dropped(spark, path)
    return result


def same_group() -> Column:
    return F.col("_k").eqNullSafe(F.col("_g"))


def within() -> Column:
    return same_group() & F.col("_v").between(F.col("lo"), F.col("hi"))


def where_they_lie(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the ranges (_g, lo, hi) that hold them, by a broadcast of the ranges."""
    return rows.join(F.broadcast(ranges), within())


def by_group(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same by a shuffle, for groups that a task may be given."""
    return rows.hint("merge").join(ranges, within())


def ranked(rows: DataFrame, state: DataFrame, limit: int, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """_k, rank and _v of the ranks of state, and the path of a table that it reads."""
    state, path = written(state, "ranks")
    while state.where(unsettled(limit)).limit(1).count():
        new, later = written(narrowed(rows, state.where(unsettled(limit)), meet).unionByName(state.where(~unsettled(limit))), "ranks")
        dropped(rows.sparkSession, path)
        state, path = new, later
    few = state.where("lo < hi").select(F.col("_k").alias("_g"), "rank", "lo", "hi", "below")
    inside = meet(rows, few).select("_k", "rank", "below", "_v")
    order = F.row_number().over(Window.partitionBy("_k", "rank").orderBy("_v"))
    found = inside.withColumn("at", order).where(F.col("at") == F.col("rank") - F.col("below") + 1).select("_k", "rank", "_v")
    return found.unionByName(state.where("lo = hi").select("_k", "rank", F.col("lo").alias("_v"))), path


def unsettled(limit: int) -> Column:
    return (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))


def narrowed(rows: DataFrame, state: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame] = where_they_lie) -> DataFrame:
    """The ranks of state, each with a smaller range that holds it."""
    ranges = state.select(F.col("_k").alias("_g"), "lo", "hi").distinct()
    grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    grids = meet(rows, ranges).groupBy("_g", "lo", "hi").agg(grid.alias("grid")).withColumnsRenamed({"_g": "_r", "lo": "_lo", "hi": "_hi"})
    place = F.floor((F.col("rank") - F.col("below")) * F.lit(GRID) / F.greatest(F.col("inside") - 1, F.lit(1))).cast("int")
    cell = lambda d: F.element_at("grid", F.greatest(F.least(place + d, F.lit(GRID)), F.lit(0)) + 1)
    joined = state.join(grids, F.col("_k").eqNullSafe(F.col("_r")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))).withColumns({"a": cell(-1), "b": cell(2)})
    stuck = (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi"))
    probed = joined.select(F.col("_k").alias("_g"), "rank", "lo", "hi", "below", "inside", F.when(stuck, cell(0)).otherwise(F.col("a")).alias("a"), F.when(stuck, cell(0)).otherwise(F.col("b")).alias("b"))
    v = F.col("_v")
    counts = {"n_low": F.count_if(v < F.col("a")), "n_mid": F.count_if((v >= F.col("a")) & (v <= F.col("b"))), "low": F.max(F.when(v < F.col("a"), v)), "high": F.min(F.when(v > F.col("b"), v)), "first": F.min(F.when(v >= F.col("a"), v)), "last": F.max(F.when(v <= F.col("b"), v))}
    known = meet(rows, probed).groupBy("_g", "rank", "lo", "hi", "below", "inside").agg(*(c.alias(n) for n, c in counts.items()))
    at = F.col("rank") - F.col("below")
    down, up = at < F.col("n_low"), at >= F.col("n_low") + F.col("n_mid")
    pick = lambda x, y, z: F.when(down, x).when(up, y).otherwise(z)
    return known.select(
        F.col("_g").alias("_k"),
        "rank",
        pick(F.col("lo"), F.col("high"), F.col("first")).alias("lo"),
        pick(F.col("low"), F.col("hi"), F.col("last")).alias("hi"),
        (F.col("below") + pick(F.lit(0), F.col("n_low") + F.col("n_mid"), F.col("n_low"))).alias("below"),
        pick(F.col("n_low"), F.col("inside") - F.col("n_low") - F.col("n_mid"), F.col("n_mid")).alias("inside"),
    )
