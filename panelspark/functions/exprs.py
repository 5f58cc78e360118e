"""Expressions that own the null, zero and window rules of the panel operators.

Missing values are NULL, never NaN. A logarithm of what is not positive and a quotient by zero are
NULL. A rolling value needs a full frame of values that are not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Fixed value: the 90 % point of the standard normal distribution.
NORMAL_90 = 1.2815515655446004
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ln(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def floor_at(x: str | Column, least: float) -> Column:
    """x, but no less than `least`; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(col(x), F.lit(least)))


def clip_sigma(x: str | Column, least: float = 1e-4, most: float = 0.30) -> Column:
    """Null and NaN become `least`; the rest is clipped."""
    return F.least(F.greatest(F.coalesce(F.nanvl(col(x), F.lit(None)), F.lit(least)), F.lit(least)), F.lit(most))


def along(asset: str = "asset", date: str = "date") -> WindowSpec:
    return Window.partitionBy(asset).orderBy(date)


def last_rows(n: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or along()).rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, over: WindowSpec | None = None) -> Column:
    """agg over the last n rows, if none of them is null."""
    frame = last_rows(n, over)
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


def running(x: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum from the first row on, nulls as 0."""
    return F.sum(F.coalesce(col(x), F.lit(0.0))).over((over or along()).rowsBetween(Window.unboundedPreceding, 0))


def long_sums(df: DataFrame, names: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds rolling sums, name: (column, rows), that need a full frame. Each is the difference of two
    running sums, so a row costs the same for any frame; a sliding frame would be summed anew for
    every row."""
    columns = sorted({c for c, _ in names.values()})
    w = along()
    df = df.withColumns({f"_sum_{c}": running(c) for c in columns} | {f"_n_{c}": F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    made = {}
    for name, (c, n) in names.items():
        whole = F.col(f"_n_{c}") - F.coalesce(F.lag(f"_n_{c}", n).over(w), F.lit(0)) == n
        made[name] = F.when(whole, F.col(f"_sum_{c}") - F.coalesce(F.lag(f"_sum_{c}", n).over(w), F.lit(0.0)))
    return df.withColumns(made).drop(*(f"_{k}_{c}" for k in ("sum", "n") for c in columns))


def pinball(y: str | Column, estimate: str | Column, q: float) -> Column:
    d = col(y) - col(estimate)
    return F.greatest(F.lit(q) * d, F.lit(q - 1) * d)


def rounded(x: str | Column, digits: int) -> Column:
    """Rounded after a tiny shift, which settles exact ties, with no negative zero."""
    return F.round(col(x) + F.lit(3.7 * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)
