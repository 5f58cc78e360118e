"""Blending two models and choosing the weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import QUANTILES, pinball, safe_div

KEY = ["asset", "origin", "fold", "h"]
SHARED = ["y", "last", "rv", "regime_driver"]
BLEND = ["sigma", "q10", "q50", "q90"]
WEIGHTS = tuple(i / 20 for i in range(21))


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys that one side lacks, and keys whose shared columns differ."""
    l, r = (x.select(*KEY, F.struct(*SHARED).alias(n)) for x, n in ((left, "a"), (right, "b")))
    return l.join(r, KEY, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both by key: the shared columns once, the others as left_ and right_. The query fails where
    a key repeats, lacks on one side, or has other shared values there."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        row = F.when(F.count("*") > 1, F.raise_error(F.lit("forecast keys repeat"))).otherwise(F.first(F.struct(*SHARED, *BLEND)))
        return rows.groupBy(*KEY).agg(row.alias(name))

    both = side(left, "a").join(side(right, "b"), KEY, "full_outer")
    same = F.col("a").isNotNull() & F.col("b").isNotNull()
    for c in SHARED:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    row = F.when(same, F.col("a")).otherwise(F.raise_error(F.lit("forecasts do not align")))
    held = both.withColumn("a", row)
    return held.select(*KEY, *(F.col(f"a.{c}").alias(c) for c in SHARED), *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "left"), ("b", "right")) for c in BLEND))


def mixed(weight: Column) -> dict[str, Column]:
    return {c: weight * F.col(f"left_{c}") + (1 - weight) * F.col(f"right_{c}") for c in BLEND}


def blend(left: DataFrame, right: DataFrame, weight: float, model: str = "blend") -> DataFrame:
    """weight left + (1 - weight) right of sigma and quantiles. Keys and shared columns must agree."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie between 0 and 1")
    if not misaligned(left, right).isEmpty():
        raise ValueError("forecasts do not align")
    return aligned(left, right).withColumns(mixed(F.lit(float(weight)))).select(F.lit(model).alias("model"), *KEY, *SHARED, *BLEND)


def blend_by(left: DataFrame, right: DataFrame, weights: DataFrame, model: str = "blend") -> DataFrame:
    """The same with a weight for each fold and horizon (fold, h, weight)."""
    rows = aligned(left, right).join(F.broadcast(weights), ["fold", "h"])
    names = ["model", "asset", "origin", "fold", "h", "y", "last", "sigma", "rv", "regime_driver", "q10", "q50", "q90"]
    return rows.withColumns(mixed(F.col("weight"))).withColumn("model", F.lit(model)).select(*names)


def weight_losses(left: DataFrame, right: DataFrame, weights: Sequence[float] = WEIGHTS, keys: Sequence[str] = ()) -> DataFrame:
    """weight and loss (pinball_%) of every weight in one pass, for each of keys."""
    rows = aligned(left, right).withColumn("weight", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
    rows = rows.withColumns(mixed(F.col("weight")))
    loss = sum((F.avg(safe_div(pinball("y", n, q), "last")) for n, q in QUANTILES.items()), F.lit(0.0)) / len(QUANTILES) * 100
    return rows.groupBy(*keys, "weight").agg(loss.alias("loss"))


def select_weight(left: DataFrame, right: DataFrame, weights: Sequence[float] = WEIGHTS, keys: Sequence[str] = ()) -> DataFrame:
    """The weight of least loss, to ten digits; among equals the nearest to a half, then the least."""
    if not weights:
        raise ValueError("no weights")
    order = Window.partitionBy(*keys).orderBy(F.round("loss", 10), F.round(F.abs(F.col("weight") - 0.5), 10), "weight")
    return weight_losses(left, right, weights, keys).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
