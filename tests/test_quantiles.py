"""Selected quantiles are those of `percentile`, for groups larger than the limit, skewed and tied."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import calibrate, quantiles

QS = (0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0)


def check(spark, rows, limit):
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(4)
    one, two = (sorted(((r["a"] or "", r["b"], r["x"]) for r in quantiles.quantiles(df, ["a", "b"], {"x": (F.col("v"), QS)}, n).collect()), key=str) for n in (None, limit))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    for x, y in zip(one, two, strict=True):
        assert (x[2] is None) == (y[2] is None) and (x[2] is None or np.allclose(x[2], y[2], rtol=1e-12, atol=0))


def test_skewed_groups_and_ties(spark):
    """One group with nine tenths of all rows, one of two values, one of powers, nulls, one row, none."""
    rng = np.random.default_rng(1)
    rows = [("hot", 1, float(x)) for x in rng.lognormal(0, 5, 4000)]
    rows += [("two", 1, float(i % 3 == 0)) for i in range(300)] + [("same", 2, 7.5)] * 90
    rows += [(None, 1, float(2.0 ** (i % 200) * (-1) ** i)) for i in range(400)] + [("one", 1, 3.0), ("none", 1, None), ("hot", 1, None)]
    rows += [("wide", 1, v) for v in (1e300, -1e300, 5e-324, -5e-324, 0.0, 1.0, 1e-9)]
    check(spark, rows, 5)


def test_poor_summaries_cost_a_round(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 30)
    monkeypatch.setattr(quantiles, "GRID", 8)
    rng = np.random.default_rng(2)
    check(spark, [("g", i % 2, float(x)) for i, x in enumerate(rng.normal(size=1500))], 20)


def test_no_task_sorts_more_than_the_limit(spark):
    df = spark.range(20_000).select(F.struct(F.lit(1).alias("k0")).alias("_k"), F.hash("id").cast("double").alias("_v"))
    state = df.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside")).withColumns({"rank": F.lit(9_000).cast("long"), "below": F.lit(0).cast("long")})
    sizes = []
    while not sizes or sizes[-1] > 500:
        state = spark.createDataFrame(quantiles.narrowed(df, state.select("_k", "rank", "lo", "hi", "below", "inside")).collect(), "_k struct<k0: int>, rank long, lo double, hi double, below long, inside long")
        row = state.first()
        held = df.where(F.col("_v").between(row["lo"], row["hi"])).count()
        assert held == row["inside"] and df.where(F.col("_v") < row["lo"]).count() == row["below"] <= 9_000 < row["below"] + held
        sizes.append(held)
    assert len(sizes) <= 3


def test_users_of_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("f", "m", int(h), float(rng.normal(0, 0.02)), 0.02, 100.0, 90.0 + float(h), 100.0, 108.0 - float(h)) for h in rng.integers(1, 4, 700)]
    df = spark.createDataFrame(rows, "fold string, model string, h int, y double, sigma double, last double, q10 double, q50 double, q90 double").withColumn("y", F.col("last") * F.exp("y"))
    same = lambda f: [sorted(map(tuple, f(n).collect())) for n in (None, 30)]
    for made in (lambda n: calibrate.one_sided_margins(df.withColumn("q10", F.col("q10") + 8).withColumn("q90", F.col("q90") - 6), limit=n), lambda n: calibrate.symmetric_factors(df, limit=n)):
        a, b = same(made)
        assert len(a) == len(b) > 0 and all(np.allclose([float(v) for v in x if not isinstance(v, str)], [float(v) for v in y if not isinstance(v, str)], rtol=1e-12) for x, y in zip(a, b, strict=True))


def test_rows_of_a_group_stay_where_they_lie(spark):
    """Rows meet ranges by a broadcast of the ranges, whatever sizes are guessed: no group is shuffled to a task."""
    rows = spark.range(3000).select(F.struct((F.col("id") % 3).alias("k0")).alias("_k"), F.col("id").cast("double").alias("_v"))
    begun = rows.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside"))
    state = begun.withColumns({"rank": F.lit(9).cast("long"), "below": F.lit(0).cast("long")}).localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for guess in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", guess)
        plan = quantiles.narrowed(rows, state)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        met = [line for line in plan.splitlines() if "Join" in line and "_v" in line]
        assert len(met) == 2 and all("BroadcastHashJoin" in line and "BuildRight" in line for line in met), plan


def test_many_ranks(spark, monkeypatch):
    """With more ranks than are broadcast, large groups meet them where they lie and the others by a shuffle."""
    monkeypatch.setattr(quantiles, "RANKS", 20)
    monkeypatch.setattr(quantiles, "GROUP", 600)
    used = []
    for name in ("where_they_lie", "by_group"):
        monkeypatch.setattr(quantiles, name, lambda rows, ranges, f=getattr(quantiles, name), name=name: used.append(name) or f(rows, ranges))
    rng = np.random.default_rng(5)
    rows = [("hot", 1, float(x)) for x in rng.lognormal(0, 5, 3000)] + [(None, i % 9, float(x)) for i, x in enumerate(rng.normal(size=1800))] + [("tied", 3, float(i % 4)) for i in range(900)] + [("none", 1, None)]
    check(spark, rows, 50)
    assert set(used) == {"where_they_lie", "by_group"}
