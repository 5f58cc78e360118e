"""A multi-quantile network with hierarchical interpolation for 15-minute bars, in numpy.

Each stack pools the last bars, passes them with the exogenous signals through a small net and gives what
it explains of the past, which the next stack does not see, and a few knots of each quantile, which are
interpolated to all steps ahead. Forecasts start from the last value. Windows are scaled by their own
median and median deviation. The loss is the pinball loss of all quantiles, the optimiser Adam.

Cross-validation takes evenly spaced cutoffs from the end of each series. The net is trained once, on
windows that end before the first cutoff: steps x batch of them, drawn by a hash, however long the series
are (`steps` and `batch` bound the fit). Spark cuts the windows by positions and hands them in order of
their step to one task, which holds one batch at a time; all cutoffs are predicted where they lie.

Rows must be a whole grid without nulls (short_features); series shorter than a window have no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import blocks

SIGNALS = ("lret", "aret", "rng", "lvol")


@dataclass(frozen=True)
class Shape:
    """192 bars back, 8 ahead, quantiles 0.1, 0.5 and 0.9, pools of 4, 2 and 1 and knots at
    every 8th, 4th and single step, batches of 128 windows, 4000 steps, seed 42."""

    back: int = 192
    ahead: int = 8
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    pools: tuple[int, ...] = (4, 2, 1)
    knots: tuple[int, ...] = (8, 4, 1)
    hidden: int = 64
    batch: int = 128
    steps: int = 4000
    rate: float = 1e-3
    seed: int = 42
    signals: int = len(SIGNALS)

    def widths(self, s: int) -> tuple[int, int, int]:
        """Pooled bars, inputs and knots of a stack."""
        pooled = -(-self.back // self.pools[s])
        return pooled, pooled + self.signals * self.back, max(1, self.ahead // self.knots[s])


def begun(shape: Shape) -> list[np.ndarray]:
    """Weights and biases of the three layers of each stack, drawn evenly within 1 / sqrt(inputs)."""
    rng, out = np.random.default_rng(shape.seed), []
    for s in range(len(shape.pools)):
        _, inputs, knots = shape.widths(s)
        for a, b in ((inputs, shape.hidden), (shape.hidden, shape.hidden), (shape.hidden, shape.back + len(shape.quantiles) * knots)):
            out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def interpolation(knots: int, steps: int) -> np.ndarray:
    """The matrix that takes knots, at the middles of equal stretches, to steps."""
    at = np.clip((np.arange(steps) + 0.5) * knots / steps - 0.5, 0, knots - 1)
    return np.stack([np.interp(at, np.arange(knots), row) for row in np.eye(knots)])


def forward(w: list[np.ndarray], y: np.ndarray, signals: np.ndarray, shape: Shape) -> tuple[np.ndarray, list]:
    """(windows, quantiles, steps) from scaled values (windows, back) and signals (windows, back, channels)."""
    n, q = len(y), len(shape.quantiles)
    flat, left, kept = signals.reshape(n, -1), y, []
    out = np.repeat(np.repeat(y[:, -1:, None], q, 1), shape.ahead, 2)
    for s, pool in enumerate(shape.pools):
        pooled, _, knots = shape.widths(s)
        wide = np.pad(left, ((0, 0), (0, pooled * pool - shape.back)), constant_values=-np.inf).reshape(n, pooled, pool)
        top = wide.argmax(2)
        x = np.concatenate([np.take_along_axis(wide, top[:, :, None], 2)[:, :, 0], flat], 1)
        w1, b1, w2, b2, w3, b3 = w[6 * s : 6 * s + 6]
        a = np.maximum(x @ w1 + b1, 0)
        b = np.maximum(a @ w2 + b2, 0)
        theta = b @ w3 + b3
        kept.append((top, x, a, b))
        left = left - theta[:, : shape.back]
        out = out + theta[:, shape.back :].reshape(n, q, knots) @ interpolation(knots, shape.ahead)
    return out, kept


def pinball(found: np.ndarray, y: np.ndarray, shape: Shape) -> tuple[float, np.ndarray]:
    """The mean loss of (windows, quantiles, steps) and its gradient."""
    q = np.array(shape.quantiles)[None, :, None]
    d = y[:, None, :] - found
    return float(np.maximum(q * d, (q - 1) * d).mean()), np.where(d > 0, -q, 1 - q) / d.size


def gradients(w: list[np.ndarray], y: np.ndarray, signals: np.ndarray, target: np.ndarray, shape: Shape) -> tuple[float, list[np.ndarray]]:
    """The loss of some windows and the gradient of each array of weights."""
    n, q = len(y), len(shape.quantiles)
    found, kept = forward(w, y, signals, shape)
    loss, out = pinball(found, target, shape)
    grads: list[np.ndarray] = [np.zeros(0)] * len(w)
    left = np.zeros_like(y)
    for s in range(len(shape.pools) - 1, -1, -1):
        pool, (pooled, _, knots) = shape.pools[s], shape.widths(s)
        top, x, a, b = kept[s]
        w1, _, w2, _, w3, _ = w[6 * s : 6 * s + 6]
        theta = np.concatenate([-left, (out @ interpolation(knots, shape.ahead).T).reshape(n, q * knots)], 1)
        db = (theta @ w3.T) * (b > 0)
        da = (db @ w2.T) * (a > 0)
        grads[6 * s : 6 * s + 6] = [x.T @ da, da.sum(0), a.T @ db, db.sum(0), b.T @ theta, theta.sum(0)]
        back = np.zeros((n, pooled, pool))
        np.put_along_axis(back, top[:, :, None], (da @ w1.T)[:, :pooled, None], 2)
        left = left + back.reshape(n, -1)[:, : shape.back]
    return loss, grads


def robust(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and median deviation along the bars; the standard deviation, or 1, where that is 0."""
    middle = np.median(x, axis=1, keepdims=True)
    off = np.median(np.abs(x - middle), axis=1, keepdims=True)
    spread = x.std(axis=1, keepdims=True)
    off = np.where(off > 1e-12, off, spread)
    return middle, np.where(off > 1e-12, off, 1.0)


class Trainer:
    """Adam on batches as they come."""

    def __init__(self, shape: Shape):
        self.shape, self.w, self.step = shape, begun(shape), 0
        self.m, self.v = ([np.zeros_like(x) for x in self.w] for _ in range(2))

    def take(self, y: np.ndarray, signals: np.ndarray, target: np.ndarray) -> float:
        (my, sy), (ms, ss) = robust(y), robust(signals)
        loss, grads = gradients(self.w, (y - my) / sy, (signals - ms) / ss, (target - my) / sy, self.shape)
        self.step += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - self.shape.rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)
        return loss


def predict(w: list[np.ndarray], y: np.ndarray, signals: np.ndarray, shape: Shape) -> np.ndarray:
    """Quantiles in the units of y, in order."""
    (my, sy), (ms, ss) = robust(y), robust(signals)
    return np.sort(forward(w, (y - my) / sy, (signals - ms) / ss, shape)[0] * sy[:, :, None] + my[:, :, None], 1)


def cut_windows(placed: DataFrame, ends: DataFrame, first: int, last: int) -> DataFrame:
    """ends(asset, pos, ...) with the rows of the asset at pos + first to pos + last, in order, as an
    array of each column: dates, y and the signals."""
    wanted = ends.withColumn("at", F.explode(F.sequence(F.col("pos") + first, F.col("pos") + last)))
    rows = placed.select(F.col("asset").alias("_a"), F.col("pos").alias("_p"), F.struct(F.col("pos").alias("at"), "date", "y", *SIGNALS).alias("bar"))
    joined = wanted.join(rows, (F.col("asset") == F.col("_a")) & (F.col("at") == F.col("_p")))
    cut = joined.groupBy(*ends.columns).agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    return cut.select(*ends.columns, F.col("bars.date").alias("dates"), *(F.col(f"bars.{c}").alias(c) for c in ("y", *SIGNALS)))


def arrays(windows: pd.DataFrame, back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and signals of the first `back` bars of each window, and the values after."""
    whole = [np.stack(windows[c].to_numpy()).astype(float) for c in ("y", *SIGNALS)]
    return whole[0][:, :back], np.stack(whole[1:], 2)[:, :back], whole[0][:, back:]


def fit(placed: DataFrame, ends: DataFrame, shape: Shape) -> list[np.ndarray]:
    """Weights from windows that end at positions below `least` of their asset; ends has asset and least.
    Each step's batch is drawn by a hash of the step and the number in it."""
    room = ends.select("asset", (F.col("least") - shape.back - shape.ahead + 1).alias("room")).where("room > 0")
    order = Window.orderBy("asset").rowsBetween(Window.unboundedPreceding, -1)
    room = room.withColumn("low", F.coalesce(F.sum("room").over(order), F.lit(0)))
    total = room.agg(F.sum("room")).first()[0]
    if not total:
        return begun(shape)
    spark = placed.sparkSession
    drawn = spark.range(shape.steps * shape.batch).select((F.col("id") / shape.batch).cast("long").alias("step"), F.col("id").alias("number"), F.pmod(F.xxhash64("id", F.lit(shape.seed)), F.lit(total)).alias("place"))
    starts = drawn.join(F.broadcast(room), (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("room"))).select("asset", (F.col("place") - F.col("low") + shape.back - 1).alias("pos"), "step", "number")
    windows = cut_windows(placed, starts, 1 - shape.back, shape.ahead).drop("dates")

    def learn(batches):
        trainer, held = Trainer(shape), None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["step"].iloc[-1]
            for _, group in held[held["step"] < last].groupby("step"):
                trainer.take(*arrays(group, shape.back))
            held = held[held["step"] == last]
        if held is not None:
            trainer.take(*arrays(held, shape.back))
        yield pd.DataFrame({"at": range(len(trainer.w)), "body": [x.tobytes() for x in trainer.w]})

    ordered = windows.repartitionByRange(1, "step").sortWithinPartitions("step", "number")
    bodies = {r["at"]: bytes(r["body"]) for r in ordered.mapInPandas(learn, "at int, body binary").collect()}
    return [np.frombuffer(bodies[i]).reshape(x.shape) for i, x in enumerate(begun(shape))]


def cross_validation(frame: DataFrame, name: str = "NHITS", windows: int = 40, step: int = 48, shape: Shape | None = None) -> DataFrame:
    """Rows as a forecaster's cross-validation gives them: unique_id, ds, cutoff, y and the quantiles
    `<name>-lo-80.0`, `<name>-median` and `<name>-hi-80.0` of each step after each cutoff."""
    shape = shape or Shape()
    placed = blocks.positions(frame.select(F.col("unique_id").alias("asset"), F.col("ds").alias("date"), "y", *SIGNALS))
    ends = placed.groupBy("asset").agg((F.max("pos") - shape.ahead).alias("final")).withColumn("least", F.greatest(F.col("final") - step * (windows - 1), F.lit(shape.back - 1)))
    weights = placed.sparkSession.sparkContext.broadcast(fit(placed, ends.select("asset", "least"), shape))
    cutoffs = ends.select("asset", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("k"), "final").select("asset", (F.col("final") - F.col("k") * step).alias("pos")).where(F.col("pos") >= shape.back - 1)
    names: Sequence[str] = (f"{name}-lo-80.0", f"{name}-median", f"{name}-hi-80.0")

    def run(batches):
        for batch in batches:
            if len(batch):
                y, signals, after = arrays(batch, shape.back)
                found = predict(weights.value, y, signals, shape)
                for asset, dates, real, q in zip(batch["asset"], batch["dates"], after, found, strict=True):
                    yield pd.DataFrame({"unique_id": asset, "ds": dates[shape.back :], "cutoff": dates[shape.back - 1], "y": real, **dict(zip(names, q[[0, len(q) // 2, -1]], strict=True))})

    cut = cut_windows(placed, cutoffs, 1 - shape.back, shape.ahead)
    return cut.mapInPandas(run, "unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, y double, " + ", ".join(f"`{n}` double" for n in names))
