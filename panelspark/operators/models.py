"""Forecasters: point baselines, classical price models, least squares, GARCH, a linear network, external rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import along, last_rows, safe_div, safe_ln
from panelspark.operators import likelihood
from panelspark.operators.features import daily_features, origin_mask

HORIZON, HISTORY, SEASON, TREND = 7, 60, 7, 30


def point_baselines(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Walk-forward rows of flat, drift and seasonal forecasts at every origin: asset, origin, model,
    h, y, yhat, last and naive_mae. History is read with lags, so no slice is built for an origin."""
    w = along()
    move = F.abs(F.col("close") - F.lag("close").over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = origin_mask(panel.withColumn("move", move)).withColumns({"naive_mae": F.avg("move").over(so_far), "slope": (F.col("close") - F.lag("close", TREND - 1).over(w)) / (TREND - 1)})
    ahead = {}
    for h in range(1, horizon + 1):
        ahead[f"_y{h}"] = F.lead("close", h).over(w)
        ahead[f"_s{h}"] = F.lag("close", SEASON - h).over(w)
    rows = rows.withColumns(ahead).where("is_origin")
    made = [F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), F.col(f"_y{h}").alias("y"), value.alias("yhat")) for h in range(1, horizon + 1) for m, value in (("flat", F.col("close")), ("drift", F.col("close") + h * F.col("slope")), ("seasonal", F.col(f"_s{h}")))]
    return rows.select("asset", F.col("date").alias("origin"), F.col("close").alias("last"), "naive_mae", F.inline(F.array(*made))).select("asset", "origin", "model", "h", "y", "yhat", "last", "naive_mae")


def trend_forecasts(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The line through the last 30 closes, continued: rows as point_baselines gives."""
    w = along()
    rows = panel.withColumn("_t", F.row_number().over(w).cast("double"))
    frame = last_rows(TREND)
    rows = rows.withColumns({"_b": F.regr_slope("close", "_t").over(frame), "_a": F.regr_intercept("close", "_t").over(frame), "move": F.abs(F.col("close") - F.lag("close").over(w))})
    rows = origin_mask(rows).withColumn("naive_mae", F.avg("move").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({f"_y{h}": F.lead("close", h).over(w) for h in range(1, horizon + 1)}).where("is_origin")
    made = [F.struct(F.lit("linreg").alias("model"), F.lit(h).alias("h"), F.col(f"_y{h}").alias("y"), (F.col("_a") + F.col("_b") * (F.col("_t") + h)).alias("yhat")) for h in range(1, horizon + 1)]
    return rows.select("asset", F.col("date").alias("origin"), F.col("close").alias("last"), "naive_mae", F.inline(F.array(*made))).select("asset", "origin", "model", "h", "y", "yhat", "last", "naive_mae")


def walk_forward(panel: DataFrame, predict: Callable[..., dict[str, np.ndarray]], horizon: int = HORIZON, context: int = 400, batch: bool = False) -> DataFrame:
    """Rows of any predictor of (last closes) -> {model: forecasts}, or, with `batch`, of one that takes
    the last closes of all origins of a group and gives a row of forecasts for each. A group is a stretch
    of `context` rows of an asset with the rows that its origins see before and after it, so one long
    series is many tasks. A predictor that raises or gives numbers that are not finite falls back to the
    last close."""
    w = along()
    rows = origin_mask(panel).select("asset", "date", "close", "is_origin", (F.row_number().over(w) - 1).alias("i"), F.abs(F.col("close") - F.lag("close").over(w)).alias("move"))
    rows = rows.withColumn("naive_mae", F.avg("move").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("move")
    wanted = F.sequence(F.greatest(F.floor((F.col("i") - horizon) / context), F.lit(0)), F.floor((F.col("i") + context - 1) / context))
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("block", F.explode(wanted)).repartition(parts, "asset", "block")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        close, own = group["close"].to_numpy(float), group["i"].to_numpy() // context == group["block"].to_numpy()
        at = np.flatnonzero(group["is_origin"].to_numpy(bool) & own)
        if not len(at):
            return pd.DataFrame(columns=["asset", "origin", "model", "h", "y", "yhat", "last", "naive_mae"], dtype=object)
        naive = group["naive_mae"].to_numpy()[at]
        if batch:
            found = predict([close[max(0, i + 1 - context) : i + 1] for i in at])
        else:
            found = {}
            for k, i in enumerate(at):
                try:
                    made = predict(close[max(0, i + 1 - context) : i + 1])
                except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                    made = {getattr(predict, "__name__", "model"): np.full(horizon, np.nan)}
                for model, values in made.items():
                    found.setdefault(model, np.full((len(at), horizon), np.nan))[k] = values
        steps = np.arange(1, horizon + 1)
        out = []
        for model, values in found.items():
            values = np.where(np.isfinite(values), values, close[at][:, None])
            each = {"asset": group["asset"].iloc[0], "origin": np.repeat(group["date"].to_numpy()[at], horizon), "model": model, "h": np.tile(steps.astype(np.int32), len(at))}
            each |= {"y": close[at[:, None] + steps].ravel(), "yhat": values.ravel(), "last": np.repeat(close[at], horizon), "naive_mae": np.repeat(naive, horizon)}
            out.append(pd.DataFrame(each))
        return pd.concat(out)

    return rows.groupBy("asset", "block").applyInPandas(run, "asset string, origin timestamp_ntz, model string, h int, y double, yhat double, last double, naive_mae double")


def arma_residuals(d: np.ndarray, size: np.ndarray, phi, theta, seasonal_phi, seasonal_theta, season: int = SEASON) -> np.ndarray:
    """One-step residuals of (1 - phi B)(1 - Phi B^s) d = (1 + theta B)(1 + Theta B^s) e for series in the
    rows of d, which end together and hold `size` values; parameters broadcast over the rows. Values
    before a series begins count as 0."""
    n = d.shape[-1]
    shape = np.broadcast_shapes(d.shape[:-1], np.shape(phi))
    e = np.zeros((n + season + 1, *shape))
    x = np.concatenate([np.zeros((season + 1, *d.shape[:-1])), np.moveaxis(d, -1, 0)])
    known = np.arange(n).reshape(-1, *[1] * len(d.shape[:-1])) >= n - size
    for t in range(n):
        at = t + season + 1
        value = x[at] - phi * x[at - 1] - seasonal_phi * (x[at - season] - phi * x[at - season - 1])
        value = value - theta * e[at - 1] - seasonal_theta * (e[at - season] + theta * e[at - season - 1])
        e[at] = np.where(known[t], value, 0.0)
    return e[season + 1 :]


def least_squares(histories: Sequence[np.ndarray], seasonal: bool = False, rounds: int = 12, season: int = SEASON) -> np.ndarray:
    """Parameters of ARIMA(1,1,1), or with (1,0,1) every seventh step, by least squares of the one-step
    residuals: a shrinking search over the parameters of all histories at once."""
    width = max(len(h) for h in histories) - 1
    size = np.array([len(h) - 1 for h in histories])
    d = np.stack([np.concatenate([np.zeros(width - n), np.diff(h)]) for h, n in zip(histories, size, strict=True)])
    k = 4 if seasonal else 2
    moves = np.concatenate([np.zeros((1, k)), np.eye(k), -np.eye(k)])
    best, step = np.zeros((len(d), k)), np.full(len(d), 0.4)
    for _ in range(rounds):
        tried = np.clip(best[:, None] + step[:, None, None] * moves, -0.95, 0.95)
        parameters = [tried[..., i] for i in range(k)] + [0.0] * (4 - k)
        e = arma_residuals(d[:, None, :], size[:, None], *parameters, season)
        at = np.argmin(np.sum(e * e, axis=0), axis=1)
        best = tried[np.arange(len(d)), at]
        step = np.where(at == 0, step / 2, step)
    return best


def arima(histories: Sequence[np.ndarray], seasonal: bool = False, horizon: int = HORIZON, season: int = SEASON) -> np.ndarray:
    """Forecasts of ARIMA(1,1,1), or with (1,0,1) every seventh step, by exact likelihood of the
    differences; the search begins where least squares ends. A history that does not move goes on so."""
    d, size = likelihood.differences(histories)
    start = least_squares(histories, seasonal, season=season)
    p = likelihood.fitted(d, size, start, season)
    last = np.array([h[-1] for h in histories])
    return last[:, None] + np.cumsum(likelihood.continued(d, size, p, horizon, season), axis=1)


def classical(histories: Sequence[np.ndarray], block: int = 128) -> dict[str, np.ndarray]:
    """ARIMA and seasonal ARIMA forecasts, a block of histories at a time."""
    parts = [histories[i : i + block] for i in range(0, len(histories), block)]
    return {name: np.concatenate([arima(p, seasonal) for p in parts]) for name, seasonal in (("arima", False), ("sarima", True))}


def linear_fits(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float = 0.0) -> DataFrame:
    """Least squares, or ridge with an unpenalised intercept, for every key at once: the sums of
    products are one aggregation, and only they reach the solver. keys, intercept and coefficients."""
    xs = ["1.0D", *(f"`{f}`" for f in features), f"`{target}`"]
    sums = [F.sum(F.expr(f"{xs[i]} * {xs[j]}")).alias(f"s{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    k = len(features)
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", intercept double, coefficients array<double>"

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                m = np.zeros((k + 2, k + 2))
                for i in range(k + 2):
                    for j in range(i, k + 2):
                        m[i, j] = m[j, i] = r[f"s{i}_{j}"]
                n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                centred = m[1:, 1:] - n * np.outer(mean, mean)
                beta = np.linalg.lstsq(centred[:k, :k] + alpha * np.eye(k), centred[:k, k], rcond=None)[0]
                out.append([r[c] for c in keys] + [float(mean[k] - mean[:k] @ beta), beta.tolist()])
            yield pd.DataFrame(out, columns=[*keys, "intercept", "coefficients"])

    return rows.na.drop(subset=[*features, target]).groupBy(*keys).agg(*sums).mapInPandas(solve, schema)


def linear_sigma(rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Adds sigma = exp of the fitted log volatility."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coefficients")[i] * F.col(f)
    return rows.join(fits, list(keys)).withColumn("sigma", F.exp(value)).drop("intercept", "coefficients")


def garch_filter(r: np.ndarray, omega: float, a: float, b: float) -> np.ndarray:
    """Variance for the step after each return; parameters may be arrays, one column each."""
    v = np.empty((len(r) + 1, *np.shape(omega)))
    v[0] = r.var()
    for t, x in enumerate(r * r):
        v[t + 1] = omega + a * x + b * v[t]
    return v[1:]


def garch_fit(r: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Zero-mean GARCH(1,1) by likelihood: variance targeting, then a shrinking search over the
    reaction and the persistence."""
    total = r.var()

    def losses(a: np.ndarray, p: np.ndarray) -> np.ndarray:
        v = np.concatenate([np.full((1, len(a)), total), garch_filter(r, total * (1 - p), a, p - a)[:-1]])
        return np.where((a >= 0.001) & (a < p) & (p < 0.999), np.sum(np.log(v) + (r * r)[:, None] / v, axis=0), np.inf)

    around = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)])
    best, step = np.array([0.08, 0.95]), np.array([0.05, 0.04])
    for _ in range(rounds):
        tried = best + step * around
        inside = np.clip(tried, 0.0005, 0.9995)
        at = int(np.argmin(np.where((tried == inside).all(axis=1), losses(*inside.T), np.inf)))
        best = tried[at]
        if not at:
            step /= 2
            if step.max() < 1e-4:
                break
    a, p = best
    return total * (1 - p), a, p - a


def pooled(window: np.ndarray, kernel: int = 25) -> np.ndarray:
    """Moving averages along time, zero-padded and the padding counted."""
    pad = kernel // 2
    wide = np.pad(window, ((0, 0), (pad, pad), (0, 0)))
    total = np.cumsum(np.pad(wide, ((0, 0), (1, 0), (0, 0))), axis=1)
    return (total[:, kernel:] - total[:, :-kernel]) / kernel


def window_matrix(column: pd.Series) -> np.ndarray:
    """Windows as rows of trend and remainder, flattened."""
    raw = np.array([[[s["r"], s["ar"], s["rng"], s["dv"]] for s in w] for w in column])
    trend = pooled(raw)
    return np.concatenate([trend, raw - trend], axis=2).reshape(len(raw), -1)


def decomposition_linear(windows: DataFrame, targets: Sequence[str], alpha: float = 1.0) -> dict:
    """Weights of a linear model on trend and remainder of each window, in closed form: tasks add
    products, Spark sums them by fold and place, the driver solves one small system a fold. Fitting the
    same model by gradient steps with early stopping gives other numbers."""

    def partial(batches):
        total: dict = {}
        for b in batches:
            for fold, g in b.groupby("fold"):
                x = np.hstack([np.ones((len(g), 1)), window_matrix(g["window"]), g[list(targets)].to_numpy(float)])
                total[fold] = total.get(fold, 0) + x.T @ x
        for fold, m in total.items():
            yield pd.DataFrame({"fold": fold, "place": np.arange(m.size), "value": m.ravel()})

    clean = windows.na.drop(subset=list(targets)).select("fold", "window", *targets)
    sums = clean.mapInPandas(partial, "fold timestamp_ntz, place int, value double").groupBy("fold", "place").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for fold, part in sums.groupby("fold"):
        part = part.sort_values("place")
        size = int(np.sqrt(len(part)))
        m, k = part["value"].to_numpy().reshape(size, size), size - len(targets)
        penalty = alpha * np.eye(k)
        penalty[0, 0] = 0
        out[fold] = np.linalg.lstsq(m[:k, :k] + penalty, m[:k, k:], rcond=None)[0]
    return out


def external_sigma(predictions: DataFrame, tests: DataFrame) -> DataFrame:
    """Volatilities made elsewhere, as (model, asset, date, h, sigma), joined to test rows in long form."""
    return tests.join(predictions, ["asset", "date", "h"])


def model_frame(panel: DataFrame) -> DataFrame:
    """Features that volatility models read."""
    return daily_features(panel).withColumn("spread", safe_div(F.col("high") - F.col("low"), "close"))
