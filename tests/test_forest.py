"""Trees fitted by the cluster are those of one task, and those of a plain booster."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, features, forest, walk

FOLDS = (dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))


def frame(spark, n=900, seed=8):
    """Rows of two folds with missing values, one hot asset, a constant column and zero volatilities."""
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame(rng.normal(size=(n, 4)), columns=[f"x{i}" for i in range(4)])
    rows.iloc[::9, 1] = np.nan
    rows["x3"] = 7.0
    for h in features.HORIZONS:
        rows[f"rv{h}"] = np.exp(-3 + 0.5 * np.sign(rows["x0"]) + 0.2 * rows["x2"] * (rows["x1"].fillna(2) > 0) + 0.01 * h + rng.normal(0, 0.1, n))
        rows[f"y{h}"] = 0.01
    rows.loc[5, "rv3"] = 0.0
    rows["fold"] = [FOLDS[i % 3 == 0] for i in range(n)]
    rows["asset"] = np.where(rng.random(n) < 0.6, "HOT", rng.choice(list("abc"), n))
    rows["date"] = pd.date_range("2020-01-01", periods=n)
    rows["part"], rows["close"], rows["vol_21d"] = np.where(np.arange(n) % 10 < 8, "fit", "cal"), 1.0, 0.02
    df = spark.createDataFrame(rows)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("fold", "date")}).repartition(5), rows, ["x0", "x1", "x2", "x3"]


SHAPES = {"deep": boosting.Shape(leaves=7, depth=64, ridge=0.0, trees=5, rate=0.3, least=20, rows=0.8, columns=0.7), "flat": boosting.Shape(leaves=8, depth=3, ridge=1.0, trees=4, rate=0.3, least=20)}


@pytest.mark.parametrize("keep", [2, 10])
def test_forest_is_what_a_task_fits(spark, monkeypatch, keep):
    monkeypatch.setattr(forest, "KEEP", keep)
    monkeypatch.setattr(forest, "TASK_ROWS", 150)
    df, _, columns = frame(spark)
    one, many, mixed = ({(r["fold"], r["model"], r["h"]): (r["n_fit"], bytes(r["body"])) for r in walk.fit_trees(df, columns, SHAPES, n).collect()} for n in (10**6, 0, 300))
    assert len(one) == 2 * 2 * len(features.HORIZONS) and set(one) == set(many) == set(mixed)
    for key in one:
        a, b, c = (boosting.from_bytes(x[key][1]) for x in (one, many, mixed))
        assert a.start == b.start == c.start
        for s, t, u in zip(a.trees, b.trees, c.trees, strict=True):
            assert vars(s) == vars(t) == vars(u)


def plain_fit(x, y, keys, cuts, shape, seed):
    """Predictions for x of trees that try every column and bin of every leaf, on the rows and columns
    that the draws give."""
    ok = np.isfinite(y)
    bins = np.stack([np.where(np.isnan(c), 63, np.searchsorted(k, c, "right")) for c, k in zip(x.T, cuts, strict=True)], 1)
    out, n = np.full(len(y), y[ok].mean()), ok.sum()
    for number in range(shape.trees):
        use, left = ok & boosting.drawn(keys, number, shape, seed, n), y - out
        columns = boosting.drawn_columns(number, shape, seed, x.shape[1])
        leaves, step = [(np.ones(len(y), bool), 0)], np.zeros(len(y))
        for _ in range(shape.leaves - 1):
            best = (1e-9, None)
            for i, (rows, depth) in enumerate(leaves):
                r = rows & use
                score = lambda m: left[m].sum() ** 2 / (m.sum() + shape.ridge)
                for missing in (False, True):
                    for c in columns:
                        for b in np.unique(bins[r, c]):
                            low = np.where(bins[:, c] == 63, missing, bins[:, c] <= b)
                            if depth < shape.depth and min((r & low).sum(), (r & ~low).sum()) >= shape.least:
                                gain = score(r & low) + score(r & ~low) - score(r)
                                if gain > best[0] + 1e-7:
                                    best = (gain, (i, low))
            if best[1] is None:
                break
            i, low = best[1]
            rows, depth = leaves.pop(i)
            leaves += [(rows & low, depth + 1), (rows & ~low, depth + 1)]
        for rows, _ in leaves:
            r = rows & use
            step[rows] = shape.rate * left[r].sum() / (r.sum() + shape.ridge)
        out = out + step
    return out


def test_forest_against_every_split(spark):
    df, _, columns = frame(spark, 400)
    fit = df.where("part = 'fit'")
    cuts = forest.fold_cuts(fit, columns)
    shape = {"deep": boosting.Shape(leaves=5, depth=4, ridge=1.0, trees=3, rate=0.5, least=15, rows=0.8, columns=0.8)}
    wide = fit.select("fold", walk.row_key(), *columns, F.ln("rv3").alias("t3"))
    found = forest.fit(wide, columns, ["t3"], shape, cuts)
    rows = wide.toPandas()
    for fold in FOLDS:
        own = rows[rows["fold"] == fold]
        x, y = own[columns].to_numpy(float), own["t3"].to_numpy(float)
        booster, n = found[fold, "deep", 0]
        assert n == np.isfinite(y).sum()
        assert np.allclose(booster.predict(x), plain_fit(x, y, own["key"].to_numpy().view(np.uint64), cuts[fold], shape["deep"], 42), atol=1e-5)


def test_growth_is_the_same_for_any_width():
    rng = np.random.default_rng(1)
    at = rng.integers(0, 12, (600, 3))
    y = boosting.whole(np.sin(at[:, 0]) + (at[:, 1] > 5) * at[:, 2] / 9 + rng.normal(0, 0.1, 600))
    shape, flat = boosting.Shape(9, 64, 0.0, least=10), at + np.arange(3) * boosting.BINS
    made = []
    for width in (1, 3, 16):
        tree = boosting.Growth(shape, np.arange(3))
        tree.give(0, *boosting.histogram(flat, y, np.arange(600), boosting.BINS))
        while parts := tree.divide(width):
            node = tree.place(at, boosting.BINS)
            for child in (c for p in parts for c in p[1:]):
                tree.give(child, *boosting.histogram(flat, y, np.flatnonzero(node == child), boosting.BINS))
        made.append(vars(tree.tree()))
    assert made[0] == made[1] == made[2] == vars(boosting.grow(at, flat, y, np.arange(600), np.arange(3), shape, boosting.BINS))


def test_sets_of_columns_are_fitted_together(spark, monkeypatch):
    """Trees of several sets of columns, each on rows of its own: one stage fits them all, and they are those
    that a fit of each set alone gives, as are the trees of folds beyond a task."""
    df, _, columns = frame(spark, 600)
    shape, sets = SHAPES["flat"], {"all": columns, "two": ["x2", "x0"], "less": ["x1", "x3", "x2"]}
    own = {name: df if name == "all" else df.where("x0 > -0.5") for name in sets}
    rows = None
    for name, cols in sets.items():
        one = own[name].select(*(c for c in df.columns if c in cols or c not in columns)).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rows = rows.localCheckpoint()
    plain = sorted(tuple(r) for name, cols in sets.items() for r in walk.trees(own[name], cols, {name: shape}).select("model", "fold", "asset", "date", "h", "sigma").collect())
    fits, fit_each = [], walk.fit_each
    monkeypatch.setattr(walk, "fit_each", lambda *args: fits.append(1) or fit_each(*args))
    for task_rows in (10**6, 100):
        found = walk.set_trees(rows, sets, shape, task_rows).select("model", "fold", "asset", "date", "h", "sigma").collect()
        assert plain == sorted(map(tuple, found))
        assert len(fits) == 1
    assert {r[0] for r in plain} == set(sets)


def test_nodes_that_cannot_be_divided_get_no_histogram(monkeypatch):
    """The last level of a tree of depth 3, and nodes of less than twice the least rows."""
    rng = np.random.default_rng(3)
    at, y = rng.integers(0, 60, (800, 3)), boosting.whole(rng.normal(size=800))
    shape, flat = boosting.Shape(8, 3, 1.0, least=10), at + np.arange(3) * boosting.BINS
    sizes, histogram = [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda *args: sizes.append(len(args[2])) or histogram(*args))
    tree = boosting.grow(at, flat, y, np.arange(800), np.arange(3), shape, boosting.BINS)
    assert len(tree.value) == 15 and len(sizes) == 1 + 1 + 2
