"""Walk-forward volatility models: every family over all folds and horizons in one plan.

A family turns rows with fold and part (fit, cal or test) into long rows (LONG) of the calibration and
test parts, with its volatility as sigma; nothing of the test part reaches a fit. Calibration, bands
and scores are the same for all families.

Per-series families (HAR, ridge, GARCH) have one group a fold and asset, whose size is the history of
one asset. Trees are pooled over assets and fitted on all rows of a fold: in one task for each fold, kind
and horizon up to TASK_ROWS rows, beyond that by histograms summed over the cluster (forest.py); both
give the same trees. Fitted models are a table, and all rows are predicted where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.exprs import clip_sigma, safe_ln
from panelspark.operators import boosting, calibrate, ensemble, features, forest, models, recurrent, splits
from panelspark.spark import kept

HARS = ("har_1d", "har_5d", "har_22d")
LONG = "model string, fold timestamp_ntz, part string, asset string, date timestamp_ntz, h int, y double, rv double, close double, vol_21d double, sigma double"
NAMES = [c.split()[0] for c in LONG.split(", ")]
#: Rows of a fold that one task fits trees on; larger folds are fitted by the cluster.
TASK_ROWS = 500_000
#: Tasks that fits are dealt to; a task has few of them, most one or none.
FIT_TASKS = 192
LEAST_FIT = 200
LEAST_SIGMA, MOST_SIGMA = 1e-4, 0.30


def feature_frame(panel: DataFrame, market: str | None = None, funding: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Features of the asset, the market and funding, labels and the origin mask; with block_rows, in
    blocks of so many rows (see blocks.block_rows)."""
    out = features.daily_features(panel, block_rows)
    out = features.with_market(out, market, block_rows) if market is not None else out
    out = features.with_funding(out, funding, block_rows) if funding is not None else out
    return features.origin_mask(features.with_labels(out, block_rows))


def parts(ready: DataFrame, folds: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fold",), also: Sequence[str] = ()) -> DataFrame:
    """Rows of every fold with part: fit and cal (purged, all labels known), and test (origins)."""
    labels = [f"{c}{h}" for h in features.HORIZONS for c in ("y", "rv")]
    known = [*columns, *also]
    train = splits.train_rows(ready, folds, known).na.drop(subset=[c for c in labels if c.startswith("rv")])
    rows = splits.split_calibration(train, keys).unionByName(splits.test_rows(ready, folds, columns).withColumn("part", F.lit("test")), allowMissingColumns=True)
    own = dict.fromkeys(["fold", "part", "asset", "date", "close", "vol_21d", *known, *labels])
    return rows.select(*own)


def long_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row a horizon."""
    each = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"y{h}").alias("y"), F.col(f"rv{h}").alias("rv")) for h in features.HORIZONS))
    return rows.select("fold", "part", "asset", "date", "close", "vol_21d", *keep, F.inline(each))


def named(rows: DataFrame, model: str) -> DataFrame:
    return rows.where("part <> 'fit'").withColumn("model", F.lit(model)).select(*NAMES)


def baseline(rows: DataFrame, model: str = "vol_21d") -> DataFrame:
    """The 21-day volatility as it is."""
    return named(long_rows(rows).withColumn("sigma", F.col("vol_21d")), model)


def enough(rows: DataFrame, least: int = LEAST_FIT) -> DataFrame:
    """Rows of the folds and assets whose fit part has `least` rows."""
    keys = rows.where("part = 'fit'").groupBy("fold", "asset").count().where(F.col("count") >= least).select("fold", "asset")
    return rows.join(keys, ["fold", "asset"], "left_semi")


def har(rows: DataFrame, model: str = "har_rv") -> DataFrame:
    """Least squares of log volatility on its own averages, for each fold, asset and horizon."""
    wide = long_rows(rows, *HARS).withColumn("target", safe_ln("rv"))
    keys = ["fold", "asset", "h"]
    fits = models.linear_fits(wide.where("part = 'fit'"), keys, HARS, "target")
    out = models.linear_sigma(wide.where("part <> 'fit'"), fits, keys, HARS)
    return named(out.withColumn("sigma", clip_sigma("sigma", LEAST_SIGMA, MOST_SIGMA)), model)


def long_frame(rows: pd.DataFrame, sigma: np.ndarray, model: str) -> pd.DataFrame:
    """LONG rows from wide ones and a volatility for each row and horizon."""
    n, k = sigma.shape
    each = {c: np.repeat(rows[c].to_numpy(), k) for c in ("fold", "part", "asset", "date", "close", "vol_21d")}
    each |= {c: rows[[f"{c}{h}" for h in features.HORIZONS]].to_numpy(float).ravel() for c in ("y", "rv")}
    out = pd.DataFrame(each | {"h": np.tile(np.array(features.HORIZONS, np.int32), n), "sigma": clipped(sigma).ravel(), "model": model})
    return out[NAMES]


def clipped(sigma: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(sigma, nan=LEAST_SIGMA), LEAST_SIGMA, MOST_SIGMA)


def ridge_sigma(group: pd.DataFrame, columns: Sequence[str], alpha: float = 1.0, clip: float = 10.0) -> np.ndarray:
    """Volatility of all rows of one series: columns scaled by median and interquartile range of the
    fit part, clipped, and a ridge with a free intercept for each horizon. Missing values are 0."""
    fit = (group["part"] == "fit").to_numpy()
    x = np.nan_to_num(group[list(columns)].to_numpy(float), nan=0.0)
    low, middle, high = np.quantile(x[fit], [0.25, 0.5, 0.75], axis=0)
    x = np.clip((x - middle) / np.where(high == low, 1.0, high - low), -clip, clip)
    y = np.log(group.loc[fit, [f"rv{h}" for h in features.HORIZONS]].to_numpy(float))
    mean, level = x[fit].mean(axis=0), y.mean(axis=0)
    centred = x[fit] - mean
    beta = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - level))
    with np.errstate(over="ignore"):
        return np.exp(level + (x - mean) @ beta)


def ridge(rows: DataFrame, columns: Sequence[str], model: str = "ridge") -> DataFrame:
    """A scaled ridge for each fold, asset and horizon. A group is one asset's history."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date").reset_index(drop=True)
        later = (group["part"] != "fit").to_numpy()
        return long_frame(group[later], ridge_sigma(group, columns)[later], model)

    return enough(rows).groupBy("fold", "asset").applyInPandas(run, LONG)


def garch(rows: DataFrame, panel: DataFrame, model: str = "garch") -> DataFrame:
    """GARCH(1,1) of each fold and asset: parameters from the returns before the last fit date, then the
    whole series filtered with them; sigma is the root of the mean variance over h steps."""
    ends = rows.where("part = 'fit'").groupBy("fold", "asset").agg(F.max("date").alias("fit_end"), F.count("*").alias("n_fit")).where(F.col("n_fit") >= LEAST_FIT)
    returns = features.with_return(panel).select("asset", "date", "lr").na.drop().join(ends.select("fold", "asset", "fit_end"), "asset")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        r = group["lr"].to_numpy() * 100
        before = r[(group["date"] < group["fit_end"]).to_numpy()]
        if len(before) < 30 or not before.var():
            return pd.DataFrame(columns=["fold", "asset", "date", "h", "sigma"], dtype=object)
        omega, a, b = models.garch_fit(before)
        level, p, nxt = omega / (1 - a - b), a + b, models.garch_filter(r, omega, a, b)
        made = [np.sqrt(level + (nxt - level) * np.mean(p ** np.arange(h))) / 100 for h in features.HORIZONS]
        return pd.concat([group[["fold", "asset", "date"]].assign(h=np.int32(h), sigma=clipped(s)) for h, s in zip(features.HORIZONS, made, strict=True)])

    sigma = returns.repartition(FIT_TASKS, "fold", "asset").groupBy("fold", "asset").applyInPandas(run, "fold timestamp_ntz, asset string, date timestamp_ntz, h int, sigma double")
    return named(long_rows(rows).join(sigma, ["fold", "asset", "date", "h"]), model)


MODELS = "fold timestamp_ntz, model string, h int, n_fit long, body binary"


def row_key():
    """Hash of a row, by which the rows of a tree are drawn."""
    return F.xxhash64("asset", "date").alias("key")


def fit_each(rows: DataFrame, columns: Sequence[str], names: Sequence[str], make: Callable[[str, pd.DataFrame, int], bytes]) -> DataFrame:
    """A table of models (MODELS), one a fold, name and horizon: make(name, rows, h) gives a model as bytes
    from all rows of the fit part, which one task holds. Its rows have the columns, fold, asset, date, key
    (their hash) and rv, the volatility over h steps. Rows that have a model are those of that name alone."""
    fit = rows.where("part = 'fit'")
    if "model" not in rows.columns:
        fit = fit.withColumn("model", F.explode(F.array(*(F.lit(k) for k in names))))
    each = long_rows(fit, "model", *(c for c in columns if c != "vol_21d")).select("fold", "model", "asset", "date", "h", "rv", row_key(), *columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["asset", "date"], ignore_index=True)
        first = group.iloc[0]
        body = make(first["model"], group, int(first["h"]))
        return pd.DataFrame({"fold": [first["fold"]], "model": [first["model"]], "h": [first["h"]], "n_fit": [len(group)], "body": [body]})

    return each.repartition(FIT_TASKS, "fold", "model", "h").groupBy("fold", "model", "h").applyInPandas(run, MODELS)


def sigma_each(rows: DataFrame, fitted: DataFrame, columns: Sequence[str] | Mapping[str, Sequence[str]], load: Callable[[bytes], object]) -> DataFrame:
    """Rows of the parts after the fit, with the volatility exp(predict(columns)) of each model of their
    fold; given columns for each name, rows have a model and get that one's. The models, one a fold, name and
    horizon and some 100 kB each, go to all workers, which read those they need."""
    sets = {k: list(c) for k, c in columns.items()} if isinstance(columns, Mapping) else None
    held: dict = {}
    for r in fitted.select("fold", "model", "h", "body").collect():
        held.setdefault(pd.Timestamp(r["fold"]), {}).setdefault(r["model"], {})[r["h"]] = bytes(r["body"])
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        loaded: dict = {}
        for batch in batches:
            for fold, group in batch.groupby("fold"):
                for model, hs in shared.value.get(fold, {}).items():
                    own = group[group["model"] == model] if sets else group
                    if not len(own):
                        continue
                    if (fold, model) not in loaded:
                        loaded[fold, model] = {h: load(raw) for h, raw in hs.items()}
                    x = own[sets[model] if sets else list(columns)].astype(float)
                    with np.errstate(over="ignore"):
                        sigma = np.stack([np.exp(np.asarray(loaded[fold, model][h].predict(x), float)) for h in features.HORIZONS], 1)
                    yield long_frame(own, sigma, model)

    return rows.where("part <> 'fit'").mapInPandas(run, LONG)


def fit_trees(rows: DataFrame, columns: Sequence[str], kinds: Mapping[str, boosting.Shape] = boosting.KINDS, task_rows: int = TASK_ROWS, seed: int = 42) -> DataFrame:
    """Boosted trees of each kind on the log volatility, from all rows of the fit part. Folds of up to
    task_rows rows are a task for each kind and horizon; the others are fitted together by the cluster."""
    shapes, columns = dict(kinds), list(columns)
    fit = rows.where("part = 'fit'")
    cuts = forest.fold_cuts(fit, columns)
    sizes = {r["fold"]: r["count"] for r in fit.groupBy("fold").count().collect()}
    large = [f for f, n in sizes.items() if n > task_rows]

    def make(name: str, group: pd.DataFrame, h: int) -> bytes:
        own = cuts[group["fold"].iloc[0].to_pydatetime()]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.log(group["rv"].to_numpy(float))
        return boosting.to_bytes(boosting.fit(group[columns].to_numpy(float), y, shapes[name], seed, cuts=own, keys=group["key"].to_numpy().view(np.uint64)))

    if not large:
        return fit_each(rows, columns, list(shapes), make)
    targets = [f"t{h}" for h in features.HORIZONS]
    wide = fit.where(F.col("fold").isin(large)).select("fold", row_key(), *columns, *(F.ln(F.col(f"rv{h}")).alias(t) for h, t in zip(features.HORIZONS, targets, strict=True)))
    found = forest.fit(wide, columns, targets, shapes, cuts, seed)
    made = [(fold, model, features.HORIZONS[t], n, bytearray(boosting.to_bytes(b))) for (fold, model, t), (b, n) in found.items()]
    grown = rows.sparkSession.createDataFrame(made, MODELS)
    return grown.unionByName(fit_each(rows.where(~F.col("fold").isin(large)), columns, list(shapes), make)) if len(large) < len(sizes) else grown


def set_trees(rows: DataFrame, sets: Mapping[str, Sequence[str]], shape: boosting.Shape, task_rows: int = TASK_ROWS, seed: int = 42) -> DataFrame:
    """LONG rows of trees of one shape on several sets of columns. rows: those of each set, its name as model
    and columns of other sets as they come. All fits are tasks of one stage, unless a fold has more than
    task_rows rows: then each set is fitted as fit_trees does."""
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    fit = rows.where("part = 'fit'").withColumn("fold", F.struct("model", "fold"))
    if max((r["count"] for r in fit.groupBy("fold").count().collect()), default=0) > task_rows:
        out = None
        for name, own in sets.items():
            one = rows.where(F.col("model") == name).drop("model")
            long = tree_sigma(one, fit_trees(one, own, {name: shape}, task_rows, seed), own)
            out = long if out is None else out.unionByName(long)
        return out
    cuts = {tuple(k): dict(zip(columns, c, strict=True)) for k, c in forest.fold_cuts(fit, columns).items()}

    def make(name: str, group: pd.DataFrame, h: int) -> bytes:
        own = cuts[name, group["fold"].iloc[0].to_pydatetime()]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.log(group["rv"].to_numpy(float))
        x = group[list(sets[name])].to_numpy(float)
        return boosting.to_bytes(boosting.fit(x, y, shape, seed, cuts=[own[c] for c in sets[name]], keys=group["key"].to_numpy().view(np.uint64)))

    fitted = fit_each(rows, columns, list(sets), make)
    return sigma_each(rows.where("part <> 'fit'").repartition(FIT_TASKS, "fold", "model"), fitted, sets, boosting.from_bytes)


def tree_sigma(rows: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return sigma_each(rows, fitted, columns, boosting.from_bytes)


def fit_all(rows: DataFrame, columns: Sequence[str], fitters: Mapping[str, Callable[[pd.DataFrame, list[str], int], object]]) -> DataFrame:
    """LONG rows of any fitters: each takes (rows of the fit part, columns, h) and gives an object whose
    predict(columns) is a log volatility. A fit is a task that holds the fold's rows; fitted objects travel
    pickled."""
    from pyspark import cloudpickle

    own = dict(fitters)
    fitted = fit_each(rows, columns, list(own), lambda name, group, h: cloudpickle.dumps(own[name](group, list(columns), h)))
    return sigma_each(rows, fitted, columns, cloudpickle.loads)


def trees(rows: DataFrame, columns: Sequence[str], kinds: Mapping[str, boosting.Shape] = boosting.KINDS) -> DataFrame:
    return tree_sigma(rows, fit_trees(rows, columns, kinds), columns)


def decomposition(rows: DataFrame, windows: DataFrame, model: str = "dlinear") -> DataFrame:
    """The linear model on trend and remainder of the last bars, fitted for each fold in closed form."""
    joined = rows.join(windows, ["asset", "date"])
    targets = [f"t{h}" for h in features.HORIZONS]
    fit = joined.where("part = 'fit'").select("fold", "window", *(safe_ln(f"rv{h}").alias(f"t{h}") for h in features.HORIZONS))
    weights = models.decomposition_linear(fit, targets)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for fold, group in batch.groupby("fold"):
                if fold in shared.value:
                    x = np.hstack([np.ones((len(group), 1)), models.window_matrix(group["window"])])
                    with np.errstate(over="ignore"):
                        yield long_frame(group, np.exp(x @ shared.value[fold]), model)

    return joined.where("part <> 'fit'").mapInPandas(run, LONG)


def lstm(rows: DataFrame, windows: DataFrame, model: str = "lstm", plan: recurrent.Plan | None = None, task_rows: int = recurrent.TASK_ROWS, tasks: int = 4) -> DataFrame:
    """A recurrent network on the last bars, trained on the fit part of each fold and stopped by its
    calibration part; rows whose volatility is not known, or that have no window, are left out of both."""
    joined = rows.join(windows, ["asset", "date"])
    targets = [f"t{h}" for h in features.HORIZONS]
    seen = joined.where("part <> 'test'").select("fold", "part", "asset", "date", "window", *(safe_ln(f"rv{h}").alias(t) for h, t in zip(features.HORIZONS, targets, strict=True))).na.drop(subset=targets)
    plan = plan or recurrent.Plan()
    shared = rows.sparkSession.sparkContext.broadcast(recurrent.networks(seen, targets, plan, task_rows, tasks))

    def run(batches):
        for batch in batches:
            for fold, group in batch.groupby("fold"):
                net = shared.value.get(fold.to_pydatetime())
                if net:
                    x = recurrent.scaled(group, net[0], net[1])
                    with np.errstate(over="ignore"):
                        yield long_frame(group, np.exp(recurrent.predict(net[2], x, plan, len(targets))), model)

    return joined.where("part <> 'fit'").mapInPandas(run, LONG)


def predictions(long: DataFrame, keys: Sequence[str] = ("fold", "model", "h"), part: str = "test") -> DataFrame:
    """Rows of a part with the intervals that the calibration part gives, in the columns of PREDICTIONS."""
    z = calibrate.z_table(long.where("part = 'cal'"), keys)
    rows = long.where(F.col("part") == part).select("model", "asset", F.col("date").alias("origin"), "fold", "h", (F.col("close") * F.exp("y")).alias("y"), F.col("close").alias("last"), "sigma", "rv", F.col("vol_21d").alias("regime_driver"))
    joined = rows.join(z, list(keys))
    made = {f"q{q}": F.col("last") * F.exp(F.col(f"z{q}") * calibrate.root_sigma()) for q in (10, 50, 90)}
    return joined.withColumns(made).select("model", "asset", "origin", "fold", "h", "y", "last", "sigma", "rv", "regime_driver", "q10", "q50", "q90")


def tree_blend(long: DataFrame, left: str = "xgb", right: str = "lgbm", model: str = "tree_blend") -> DataFrame:
    """Test predictions of two models, blended with the weight that does best on the calibration part of
    each fold and horizon."""
    both = long.where(F.col("model").isin(left, right))
    cal, test = predictions(both, part="cal"), predictions(both)
    side = lambda rows, name: rows.where(F.col("model") == name)
    weights = ensemble.select_weight(side(cal, left), side(cal, right), keys=["fold", "h"]).select("fold", "h", "weight")
    return ensemble.blend_by(side(test, left), side(test, right), weights, model)


def daily_backtest(rows: DataFrame, columns: Sequence[str], materialise=None) -> DataFrame:
    """Test predictions of both kinds of trees, their blend and the baseline. `materialise` may write the
    long rows, which are read several times, to a table."""
    keep = materialise or (lambda df: df)
    long = keep(trees(rows, columns).unionByName(baseline(rows)))
    return predictions(long).unionByName(tree_blend(long))


def ablation_candidates(columns: Sequence[str]) -> dict[str, list[str]]:
    """All columns, those without candidates, and all but each group."""
    columns = list(columns)
    out = {"all": columns, "legacy": [c for c in columns if c not in features.CANDIDATES]}
    return out | {f"without_{g}": [c for c in columns if c not in members] for g, members in features.feature_groups(columns).items()}


def ablation(ready: DataFrame, folds: DataFrame, columns: Sequence[str], kind: str = "xgb", candidates: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """candidate, fold, pinball_%, coverage and origin_count: trees without each group of features, on the
    folds. A sample for choosing features, not a test."""
    from panelspark.operators import score

    sets = dict(candidates or ablation_candidates(columns))
    rows = None
    for name, own in sets.items():
        one = parts(ready, folds, own).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    long = kept(set_trees(kept(rows, "parts"), sets, boosting.KINDS[kind]), "long")
    rows = predictions(long)
    scored = score.score(rows, ["model", "fold"]).select(F.col("model").alias("candidate"), "fold", "pinball_%", "coverage")
    counts = rows.groupBy(F.col("model").alias("candidate"), "fold").agg(F.count_distinct("asset", "origin").alias("origin_count"))
    return scored.join(counts, ["candidate", "fold"])


def save(folder: str, fitted: DataFrame, z: DataFrame, columns: Sequence[str]) -> None:
    """Writes models, their z-table and the columns they read. Fails where something is there already."""
    fitted.write.mode("errorifexists").parquet(f"{folder}/models")
    z.write.mode("errorifexists").parquet(f"{folder}/z")
    spark = fitted.sparkSession
    spark.createDataFrame(list(enumerate(columns)), "place int, name string").write.mode("errorifexists").parquet(f"{folder}/columns")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Models, z-table and columns as they were saved."""
    names = [r["name"] for r in spark.read.parquet(f"{folder}/columns").orderBy("place").collect()]
    return spark.read.parquet(f"{folder}/models"), spark.read.parquet(f"{folder}/z"), names
