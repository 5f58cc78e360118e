"""Registers a query with its SQL; both sides select and round the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.exprs import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def columns(spec: str) -> list[tuple[str, str]]:
    return [(p.strip().partition(":")[0], p.strip().partition(":")[2]) for p in spec.split(",")]


def select_spark(df: DataFrame, spec: str) -> DataFrame:
    """Columns of a spec: `x` as it is, `x:8` rounded to 8 digits, `x:i` as bigint."""
    return df.select(*(F.col(f"`{n}`") if not k else (F.col(f"`{n}`").cast("long") if k == "i" else rounded(F.col(f"`{n}`"), int(k))).alias(n) for n, k in columns(spec)))


def select_sql(spec: str) -> str:
    return ", ".join(f'"{n}"' if not k else (f'CAST("{n}" AS BIGINT)' if k == "i" else f'round(CAST("{n}" AS DOUBLE) + {3.7 * 10.0 ** -(int(k) + 3)!r}, {k}) + 0.0') + f' AS "{n}"' for n, k in columns(spec))


def query(name: str, spec: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """Adds a query. sql gives rows with the columns of spec; ctes are put before it."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: select_spark(run(spark, sf_dir), spec)
    if sql is not None:
        SQL[name] = (f"WITH {ctes} " if ctes else "") + f"SELECT {select_sql(spec)} FROM ({sql}) AS result"


def another(name: str, of: str, spec: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a query that gives the rows of another one, with the same spec, by another way."""
    query(name, spec, run)
    SQL[name] = SQL[of]
