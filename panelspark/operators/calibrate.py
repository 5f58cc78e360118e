"""Quantile intervals: z-tables, bands and conformal widening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import NORMAL_90, QUANTILES, safe_div, safe_ln
from panelspark.operators.quantiles import quantiles, select


def root_sigma() -> Column:
    return F.col("sigma") * F.sqrt(F.col("h").cast("double"))


def z_table(calibration: DataFrame, keys: Sequence[str] = ("fold", "model", "h"), limit: int | None = None) -> DataFrame:
    """Quantiles of y / (sigma sqrt(h)) for each key; rows with sigma 0 have no z. With a limit, groups of
    more rows are narrowed before a task sorts them (quantiles.py)."""
    cut = quantiles(calibration, keys, {"z": (safe_div("y", root_sigma()), list(QUANTILES.values()))}, limit)
    return cut.select(*keys, *(F.col("z")[i].alias(f"z{int(q * 100)}") for i, q in enumerate(QUANTILES.values())))


def crossed(z: DataFrame) -> DataFrame:
    """Rows of a z-table whose quantiles cross; there are none."""
    return z.where("z10 > z50 or z50 > z90")


def bands(rows: DataFrame, z: DataFrame, keys: Sequence[str] = ("fold", "model", "h")) -> DataFrame:
    """Adds q10, q50 and q90 = last exp(z sigma sqrt(h)). A z-table has one row a fold, model and
    horizon, and is broadcast."""
    joined = rows.join(F.broadcast(z), list(keys))
    return joined.withColumns({f"q{q}": F.col("last") * F.exp(F.col(f"z{q}") * root_sigma()) for q in (10, 50, 90)}).drop("z10", "z50", "z90")


def normal_bands(rows: DataFrame) -> DataFrame:
    """The same with normal quantiles."""
    return rows.withColumns({name: F.col("last") * F.exp(F.lit(z) * root_sigma()) for name, z in (("q10", -NORMAL_90), ("q50", 0.0), ("q90", NORMAL_90))})


def one_sided_margins(calibration: DataFrame, alpha: float = 0.20, limit: int | None = None) -> DataFrame:
    """h, lower and upper: how far logs of q10 and q90 must move apart, each on its own, never in. A
    horizon is one sort; with a limit its ranks are selected instead."""
    scores = calibration.select("h", (safe_ln("q10") - safe_ln("y")).alias("below"), (safe_ln("y") - safe_ln("q90")).alias("above"))
    sizes = scores.groupBy("h").agg(F.count("*").alias("n"), F.count("below").alias("n_below"), F.count("above").alias("n_above"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(1 - alpha / 2)) / F.col("n"))
    if limit is not None:
        found = sizes.select("h")
        for c, name in (("below", "lower"), ("above", "upper")):
            wanted = sizes.select(F.struct("h").alias("_k"), F.ceil((F.col(f"n_{c}") - 1) * level).alias("rank"))
            one = select(scores.select(F.struct("h").alias("_k"), F.col(c).alias("_v")), [], limit, wanted)
            found = found.join(one.select("_k.h", F.greatest("_v", F.lit(0.0)).alias(name)), "h", "left")
        return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lower", "upper")})
    rank = lambda c: F.row_number().over(Window.partitionBy("h").orderBy(F.col(c).asc_nulls_last()))
    ranked = scores.withColumns({"at_below": rank("below"), "at_above": rank("above")}).join(F.broadcast(sizes), "h")
    at = {c: F.max(F.when(F.col(f"at_{c}") == F.ceil((F.col(f"n_{c}") - 1) * level) + 1, F.col(c))) for c in ("below", "above")}
    return ranked.groupBy("h").agg(F.greatest(at["below"], F.lit(0.0)).alias("lower"), F.greatest(at["above"], F.lit(0.0)).alias("upper"))


def widen(test: DataFrame, margins: DataFrame, model: str = "calibrated") -> DataFrame:
    """Test rows with q10 and q90 moved out by the margins of their horizon."""
    joined = test.join(F.broadcast(margins), "h")
    return joined.withColumns({"q10": F.col("q10") * F.exp(-F.col("lower")), "q90": F.col("q90") * F.exp(F.col("upper")), "model": F.lit(model)}).drop("lower", "upper")


def symmetric_factors(calibration: DataFrame, level: float = 0.80, limit: int | None = None) -> DataFrame:
    """h and k: by horizon the quantile of |y - q50| over the upper half band, smoothed by a centred
    median of five horizons, at least 1."""
    ratio = F.abs(F.col("y") - F.col("q50")) / F.greatest(F.col("q90") - F.col("q50"), F.lit(1e-9))
    raw = quantiles(calibration, ["h"], {"cut": (ratio, [level])}, limit).select("h", F.col("cut")[0].alias("raw"))
    near = Window.orderBy("h").rowsBetween(-2, 2)
    return raw.select("h", F.greatest(F.percentile("raw", F.lit(0.5)).over(near), F.lit(1.0)).alias("k"))


def symmetric_conformal(rows: DataFrame, part: float = 0.6) -> DataFrame:
    """Splits by cutoff at `part` of the distinct cutoffs; widens the later ones on both sides of q50
    by the upper half band times the factor of the horizon."""
    cutoffs = rows.select("cutoff").distinct()
    ranked = cutoffs.select("cutoff", (F.row_number().over(Window.orderBy("cutoff")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    split = ranked.where(F.col("at") == F.floor(F.col("n") * F.lit(part))).select(F.col("cutoff").alias("split_at"))
    marked = rows.join(F.broadcast(split))
    k = symmetric_factors(marked.where("cutoff < split_at"))
    half = F.col("k") * (F.col("q90") - F.col("q50"))
    test = marked.where("cutoff >= split_at").join(F.broadcast(k), "h")
    return test.withColumns({"q10": F.col("q50") - half, "q90": F.col("q50") + half, "model": F.concat("model", F.lit("_cal"))}).drop("k", "split_at")


def volatility_baselines(reference: DataFrame, horizon: int = 96) -> DataFrame:
    """Persistence and momentum forecasts with normal bands from the volatility at the origin."""
    band = F.lit(NORMAL_90) * F.col("origin_sigma") * F.sqrt(F.col("h").cast("double"))
    start = safe_ln("last")
    middles = {"persistence_vol": start, "momentum_vol": start + F.col("h") / F.lit(horizon) * F.col("origin_momentum")}
    made = F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.exp(mid - band).alias("q10"), F.exp(mid).alias("q50"), F.exp(mid + band).alias("q90")) for m, mid in middles.items())))
    return reference.drop("model", "q10", "q50", "q90").select("*", made)
