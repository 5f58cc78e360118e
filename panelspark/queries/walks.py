"""Walk-forward models over all folds and horizons, and the SQL of those that normal equations give."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import boosting, features, models, recurrent, score, splits, walk
from panelspark.queries import frames as fr
from panelspark.queries.registry import query
from panelspark.spark import kept

# The features of the daily models, without and with candidates.
COLUMNS = (
    "ret_lag1", "ret_lag2", "ret_lag3", "ret_lag5", "ret_lag8", "ret_lag13", "ret_5d", "vol_5d", "ret_10d", "vol_10d", "ret_21d", "vol_21d",
    "ret_63d", "vol_63d", "range", "range_5d", "vol_ratio", "px_vs_ma63", "btc_ret", "btc_ret_5d", "funding_sum", "fund_7d", "fund_21d", "fund_z",
)
CANDIDATES = ("vol_regime", "drawdown_63d", "volume_z21")
GROUPS = {
    "returns": ("ret_lag1", "ret_lag2", "ret_lag3", "ret_lag5", "ret_lag8", "ret_lag13", "ret_5d", "ret_10d", "ret_21d", "ret_63d", "px_vs_ma63", "drawdown_63d"),
    "volatility": ("vol_5d", "vol_10d", "vol_21d", "vol_63d", "range", "range_5d", "vol_ratio", "vol_regime"),
    "volume": ("volume_z21",),
    "market": ("btc_ret", "btc_ret_5d"),
    "funding": ("funding_sum", "fund_7d", "fund_21d", "fund_z"),
}


PRICES = ("open", "high", "low", "close")


def panel(spark, d) -> DataFrame:
    """The test panel with its moves scaled down to those of a market, so that no volatility is clipped."""
    return fr.panel(spark, d).withColumns({c: 100 * F.pow(F.col(c) / 100_000, F.lit(0.04)) for c in PRICES})


def ready(spark, d) -> tuple[DataFrame, DataFrame]:
    """The feature frame, written once, and the folds."""
    frame = kept(walk.feature_frame(panel(spark, d), fr.MARKET, fr.funding(spark, d)), "features")
    return frame, splits.fold_calendar(frame, fr.START)


def pooled(spark, d) -> DataFrame:
    return kept(walk.parts(*ready(spark, d), COLUMNS), "parts")


def series(spark, d) -> DataFrame:
    """Parts cut for each asset, of assets with enough rows."""
    return kept(walk.enough(walk.parts(*ready(spark, d), COLUMNS, ("fold", "asset"), walk.HARS)), "parts")


# SQL
H = features.HORIZONS
HARS = walk.HARS
WHOLE = f"""whole0 AS (SELECT feat.*, m.lr AS btc_ret, funding_sum FROM feat LEFT JOIN (SELECT date, lr FROM feat WHERE asset = '{fr.MARKET}') AS m USING (date) LEFT JOIN funding USING (asset, date)),
 whole AS MATERIALIZED (SELECT *, {fr.roll("sum", "btc_ret", 5)} AS btc_ret_5d, {fr.roll("avg", "funding_sum", 7)} AS fund_7d, {fr.roll("avg", "funding_sum", 21)} AS fund_21d,
 (funding_sum - {fr.roll("avg", "funding_sum", 63)}) / nullif({fr.roll("stddev_samp", "funding_sum", 63)}, 0) AS fund_z FROM whole0)"""
KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)
KNOWN_FIT = " AND ".join(f"{c} IS NOT NULL" for c in (*HARS, *(f"rv{h}" for h in H)))
PARTS = f"""wtrain AS MATERIALIZED (SELECT * FROM mask JOIN years ON date < fold WHERE {KNOWN} AND {KNOWN_FIT} AND {fr.ENDS_FOLD}),
 wcuts AS (SELECT fold, asset, quantile_cont(CAST(epoch_us(date) AS DOUBLE), 0.8) AS cut FROM wtrain GROUP BY ALL),
 wsplit AS (SELECT * FROM (SELECT wtrain.*, CASE WHEN epoch_us(date) >= cut THEN 'cal' WHEN {fr.ENDS_CUT} THEN 'fit' END AS part FROM wtrain JOIN wcuts USING (fold, asset)) WHERE part IS NOT NULL),
 wtests AS (SELECT *, 'test' AS part FROM mask JOIN years ON date >= fold AND date < fold_end WHERE is_origin AND {KNOWN}),
 wall AS MATERIALIZED (SELECT * FROM (SELECT * FROM wsplit UNION ALL SELECT * FROM wtests) WHERE (fold, asset) IN (SELECT (fold, asset) FROM wsplit WHERE part = 'fit' GROUP BY fold, asset HAVING count(*) >= 200))"""
CALM = "panel AS MATERIALIZED (SELECT asset, date, " + ", ".join(f"100 * pow({c} / 100000, 0.04) AS {c}" for c in PRICES) + ", volume FROM bars0)"
WALK = ", ".join((fr.PANEL.replace("panel AS", "bars0 AS", 1), CALM, fr.FUNDING, fr.BASE, fr.FEAT, WHOLE, fr.MASK.replace("FROM feat", "FROM whole"), fr.FOLDS, PARTS))
CLIPPED = "least(greatest(exp({}), 1e-4), 0.3)"

# Least squares on three columns by Cramer's rule.
LONG = " UNION ALL ".join(f"SELECT fold, part, asset, date, close, vol_21d, CAST({h} AS INTEGER) AS h, y{h} AS y, rv{h} AS rv, har_1d AS x1, har_5d AS x2, har_22d AS x3 FROM wall" for h in H)
MOMENTS = ", ".join([*(f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i in (1, 2, 3) for j in range(i, 4)), *(f"covar_pop(x{i}, ln(rv)) AS t{i}, avg(x{i}) AS a{i}" for i in (1, 2, 3)), "avg(ln(rv)) AS a0"])
DET = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
BETA = f"""(t1 * (s22 * s33 - s23 * s23) - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3)) / {DET} AS b1,
 (s11 * (t2 * s33 - s23 * t3) - t1 * (s12 * s33 - s23 * s13) + s13 * (s12 * t3 - t2 * s13)) / {DET} AS b2,
 (s11 * (s22 * t3 - t2 * s23) - s12 * (s12 * t3 - t2 * s13) + t1 * (s12 * s23 - s22 * s13)) / {DET} AS b3"""
HAR = f"""wlong AS ({LONG}), wmom AS (SELECT fold, asset, h, {MOMENTS} FROM wlong WHERE part = 'fit' GROUP BY ALL), wbeta AS (SELECT *, {BETA} FROM wmom),
 har_long AS (SELECT 'har_rv' AS model, fold, part, asset, date, h, y, rv, close, vol_21d, {CLIPPED.format("a0 + b1 * (x1 - a1) + b2 * (x2 - a2) + b3 * (x3 - a3)")} AS sigma FROM wlong JOIN wbeta USING (fold, asset, h) WHERE part <> 'fit')"""

# A ridge on scaled columns by elimination in a recursion, one step a column; seven right sides at once.
N = len(COLUMNS)
SCALED = ", ".join(f"least(greatest((coalesce({c}, 0) - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, -10), 10)" for c in COLUMNS)
STATS = ", ".join(f"quantile_cont(coalesce({c}, 0), [0.25, 0.5, 0.75]) AS q_{c}" for c in COLUMNS)
MEANS = "[" + ", ".join(f"avg(x[{i}])" for i in range(1, N + 1)) + "]"
LEVELS = "[" + ", ".join(f"avg(ln(rv{h}))" for h in H) + "]"
MATRIX = "[" + ", ".join("[" + ", ".join([*(f"sum(z[{i}] * z[{j}]){' + 1.0' if i == j else ''}" for j in range(1, N + 1)), *(f"sum(z[{i}] * (ln(rv{h}) - level[{h}]))" for h in H)]) + "]" for i in range(1, N + 1)) + "]"
RIDGE = f"""rstat AS (SELECT fold, asset, {STATS} FROM wall WHERE part = 'fit' GROUP BY ALL),
 rx AS MATERIALIZED (SELECT wall.*, [{SCALED}] AS x FROM wall JOIN rstat USING (fold, asset)),
 rmean AS (SELECT fold, asset, {MEANS} AS mu, {LEVELS} AS level FROM rx WHERE part = 'fit' GROUP BY ALL),
 rz AS MATERIALIZED (SELECT rx.*, mu, level, list_transform(range(1, {N + 1}), lambda i: x[i] - mu[i]) AS z FROM rx JOIN rmean USING (fold, asset)),
 raug AS (SELECT fold, asset, {MATRIX} AS m FROM rz WHERE part = 'fit' GROUP BY ALL),
 rsteps AS (SELECT fold, asset, CAST(1 AS BIGINT) AS k, m FROM raug UNION ALL
  SELECT fold, asset, k + 1, list_transform(range(1, {N + 1}), lambda i: list_transform(range(1, {N + 8}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM rsteps WHERE k <= {N}),
 rbeta AS MATERIALIZED (SELECT fold, asset, m FROM rsteps WHERE k = {N + 1}),
 ridge_long AS ({" UNION ALL ".join(f"SELECT 'ridge' AS model, fold, part, asset, date, CAST({h} AS INTEGER) AS h, y{h} AS y, rv{h} AS rv, close, vol_21d, {CLIPPED.format(f'level[{h}] + list_sum(list_transform(range(1, {N + 1}), lambda i: z[i] * m[i][{N + h}]))')} AS sigma FROM rz JOIN rbeta USING (fold, asset) WHERE part <> 'fit'" for h in H)})"""
SCORES = f"""lin AS (SELECT * FROM har_long UNION ALL SELECT * FROM ridge_long UNION ALL SELECT 'vol_21d' AS model, fold, part, asset, date, h, y, rv, close, vol_21d, vol_21d AS sigma FROM wlong WHERE part <> 'fit'),
 linz AS (SELECT fold, asset, model, h, quantile_cont(y / nullif(sigma * sqrt(h), 0), [0.1, 0.5, 0.9]) AS z FROM lin WHERE part = 'cal' GROUP BY ALL),
 linpred AS (SELECT model, asset, date AS origin, fold, h, close * exp(y) AS y, close AS last, close * exp(z[1] * sigma * sqrt(h)) AS q10, close * exp(z[2] * sigma * sqrt(h)) AS q50, close * exp(z[3] * sigma * sqrt(h)) AS q90 FROM lin JOIN linz USING (fold, asset, model, h) WHERE part = 'test')"""
RECURSIVE = "RECURSIVE " + WALK

TEST = "fold, asset, date, h, sigma:6"
query("md5_har_sigma", TEST, lambda s, d: walk.har(series(s, d)).where("part = 'test'"), "SELECT * FROM har_long WHERE part = 'test'", f"{WALK}, {HAR}")
query("md6_ridge_sigma", TEST, lambda s, d: walk.ridge(series(s, d), COLUMNS).where("part = 'test'"), "SELECT * FROM ridge_long WHERE part = 'test'", f"{RECURSIVE}, {RIDGE}")
query("md7_garch_sigma", TEST, lambda s, d: walk.garch(series(s, d), panel(s, d)).where("part = 'test'"))
query("md8_boosted_sigma", f"model, {TEST}", lambda s, d: walk.trees(pooled(s, d), COLUMNS).where("part = 'test'"))
query("md9_decomposition_linear", TEST, lambda s, d: walk.decomposition(pooled(s, d), features.lookback_windows(panel(s, d))).where("part = 'test'"))
#: At most 15 epochs in the query, in whole batches, as its folds are trained by one core each.
SHORT = recurrent.Plan(epochs=15, patience=4, piece=256)
query("md10_lstm_sigma", TEST, lambda s, d: walk.lstm(pooled(s, d), features.lookback_windows(panel(s, d)), plan=SHORT).where("part = 'test'"))
query("md13_classical_prices", "asset, origin, model, h, yhat:4", lambda s, d: models.walk_forward(panel(s, d), models.classical, batch=True))


def linear_family(spark, d) -> DataFrame:
    rows = series(spark, d)
    long = kept(walk.har(rows).unionByName(walk.ridge(rows, COLUMNS)).unionByName(walk.baseline(rows)), "long")
    return walk.predictions(long, ("fold", "asset", "model", "h"))


query("md14_linear_family", f"model, {fr.METRIC_SPEC}", lambda s, d: score.score(linear_family(s, d)), f"SELECT model, {fr.METRICS} FROM linpred GROUP BY model", f"{RECURSIVE}, {HAR}, {RIDGE}, {SCORES}")
query("md14_fit_all", f"model, {fr.METRIC_SPEC}", lambda s, d: score.score(walk.daily_backtest(pooled(s, d), COLUMNS, lambda df: kept(df, "long"))))


class Mean:
    """A fitter's result that predicts one number."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, x):
        return [self.value] * len(x)


POOLED = f"""ptrain AS (SELECT * FROM mask JOIN years ON date < fold WHERE {KNOWN} AND {" AND ".join(f"rv{h} IS NOT NULL" for h in H)} AND {fr.ENDS_FOLD}),
 pcuts AS (SELECT fold, quantile_cont(CAST(epoch_us(date) AS DOUBLE), 0.8) AS cut FROM ptrain GROUP BY fold),
 pmean AS (SELECT fold, {", ".join(f"avg(ln(rv{h})) AS m{h}" for h in H)} FROM ptrain JOIN pcuts USING (fold) WHERE epoch_us(date) < cut AND {fr.ENDS_CUT} GROUP BY fold)"""
query(
    "md14_fit_registry",
    f"model, {TEST}",
    lambda s, d: walk.fit_all(pooled(s, d), COLUMNS, {"mean": lambda fit, cols, h: Mean(float(np.log(fit["rv"]).mean())), "half": lambda fit, cols, h: Mean(float(np.log(fit["rv"] / 2).mean()))}).where("part = 'test'"),
    " UNION ALL ".join(f"SELECT '{m}' AS model, fold, asset, date, CAST({h} AS INTEGER) AS h, {CLIPPED.format(f'm{h} - ln({k})')} AS sigma FROM wtests JOIN pmean USING (fold)" for h in H for m, k in (("mean", 1), ("half", 2))),
    f"{WALK}, {POOLED}",
)


def ablation(spark, d) -> DataFrame:
    return walk.ablation(*ready(spark, d), (*COLUMNS, *CANDIDATES))


query("cv7_ablation", "candidate, fold, pinball_%:6, coverage:6, origin_count:i", ablation)
LISTED = {"all": (*COLUMNS, *CANDIDATES), "legacy": COLUMNS} | {f"without_{g}": tuple(c for c in (*COLUMNS, *CANDIDATES) if c not in m) for g, m in GROUPS.items()}


def candidates(spark, d) -> DataFrame:
    frame = walk.feature_frame(fr.panel(spark, d), fr.MARKET, fr.funding(spark, d))
    found = walk.ablation_candidates(features.feature_columns(frame.columns, use_candidates=True))
    return spark.createDataFrame([(k, ",".join(sorted(v)), len(v)) for k, v in found.items()], "candidate string, columns string, n long")


query("cv7_ablation_candidates", "candidate, columns, n:i", candidates, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{','.join(sorted(v))}', {len(v)})" for k, v in LISTED.items()) + ") AS t(candidate, columns, n)")


def feature_list(spark, d) -> DataFrame:
    """The columns that models read, with their group."""
    frame = walk.feature_frame(fr.panel(spark, d), fr.MARKET, fr.funding(spark, d))
    cols = features.feature_columns(frame.columns, use_candidates=True)
    groups = {c: g for g, members in features.feature_groups(cols).items() for c in members}
    default = set(features.feature_columns(frame.columns))
    return spark.createDataFrame([(c, groups[c], c in default) for c in cols], "name string, grp string, by_default boolean")


query("prj1_model_features", "name, grp, by_default", feature_list, "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{g}', {str(c in COLUMNS).lower()})" for g, m in GROUPS.items() for c in m) + ") AS t(name, grp, by_default)")


def saved(spark, d) -> DataFrame:
    """Models saved and loaded again: bands of the last row of each asset by both."""
    from panelspark.operators import calibrate
    from panelspark.spark import scratch

    rows = pooled(spark, d)
    last = rows.agg(F.max("fold")).first()[0]
    rows = rows.where(F.col("fold") == F.lit(last))
    fitted = kept(walk.fit_trees(rows, COLUMNS, {"xgb": boosting.KINDS["xgb"]}), "models")
    z = calibrate.z_table(walk.tree_sigma(rows, fitted, COLUMNS).where("part = 'cal'"))
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    walk.save(folder, fitted, z, COLUMNS)
    models_, z_, names = walk.load(spark, folder)
    a, b = (walk.tree_sigma(rows, m, c) for m, c in ((fitted, COLUMNS), (models_, names)))
    differing = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"))
    return differing.join(z_.agg(F.count("*").alias("z_rows"))).join(models_.agg(F.count("*").alias("models")))


query("snk11_saved_models", "differing:i, z_rows:i, models:i", saved, "SELECT 0 AS differing, 7 AS z_rows, 7 AS models")
