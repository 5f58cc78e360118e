"""A recurrent network on windows of daily signals, trained in numpy by synchronous data-parallel steps.

One LSTM layer reads a window bar by bar; its last state, with dropout, gives the log volatility of all
horizons. Gradients go back through time by hand. Adam with a fixed step takes batches in order; training
stops when the loss on the calibration part, which comes later, has not fallen for `patience` epochs, and
the best weights stay.

A batch is cut into small pieces of `piece` rows, whose gradients are summed in their order, so weights
are the same for any number of tasks. A fold of up to TASK_ROWS rows is a group; a larger one is a barrier
stage: each task holds its pieces, and the tasks exchange the gradients of a batch by allGather, some 40 kB
a piece. An exchange takes about a second, so a batch of 256 is too small there; raise it with the rows. Weights and the state of
Adam are written to the shared folder after every epoch, so a stage that is begun again goes on from there.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import blocks
from panelspark.spark import dropped, scratch

CHANNELS = ("r", "ar", "rng", "dv")
TASK_ROWS = 200_000


@dataclass(frozen=True)
class Plan:
    """32 hidden units, dropout 0.1, Adam at 1e-3, batches of 256, at most 200 epochs with a
    patience of 15 for steps of 1e-5, seed 42."""

    hidden: int = 32
    dropout: float = 0.1
    rate: float = 1e-3
    batch: int = 256
    piece: int = 128
    epochs: int = 200
    patience: int = 15
    least: float = 1e-5
    seed: int = 42


def shapes(channels: int, hidden: int, outputs: int) -> dict[str, tuple[int, ...]]:
    """Parameters in order. Gates are input, forget, cell and output."""
    return {"wx": (channels, 4 * hidden), "wh": (hidden, 4 * hidden), "bx": (4 * hidden,), "bh": (4 * hidden,), "head": (hidden, outputs), "bias": (outputs,)}


def parts_of(w: np.ndarray, channels: int, hidden: int, outputs: int) -> dict[str, np.ndarray]:
    """A vector of weights as views of its parameters."""
    out, at = {}, 0
    for name, shape in shapes(channels, hidden, outputs).items():
        size = int(np.prod(shape))
        out[name] = w[at : at + size].reshape(shape)
        at += size
    return out


def begun(channels: int, outputs: int, plan: Plan) -> np.ndarray:
    """Weights drawn evenly within 1 / sqrt(hidden)."""
    size = sum(int(np.prod(s)) for s in shapes(channels, plan.hidden, outputs).values())
    return np.random.default_rng(plan.seed).uniform(-1, 1, size) / np.sqrt(plan.hidden)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
    """The last state for each window (rows, bars, channels), and what going back needs."""
    hidden = p["wh"].shape[0]
    h = c = np.zeros((len(x), hidden))
    kept = []
    given = x @ p["wx"] + (p["bx"] + p["bh"])
    for t in range(x.shape[1]):
        z = given[:, t] + h @ p["wh"]
        i, f, o = sigmoid(z[:, :hidden]), sigmoid(z[:, hidden : 2 * hidden]), sigmoid(z[:, 3 * hidden :])
        g = np.tanh(z[:, 2 * hidden : 3 * hidden])
        before, c = c, f * c + i * g
        up = np.tanh(c)
        kept.append((i, f, g, o, before, up, h))
        h = o * up
    return h, kept


def predict(w: np.ndarray, x: np.ndarray, plan: Plan, outputs: int) -> np.ndarray:
    p = parts_of(w, x.shape[2], plan.hidden, outputs)
    return run(p, x)[0] @ p["head"] + p["bias"]


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, plan: Plan, mask: np.ndarray, scale: float) -> np.ndarray:
    """The gradient of scale times the sum of squared errors of some windows."""
    p = parts_of(w, x.shape[2], plan.hidden, y.shape[1])
    out = np.zeros_like(w)
    g = parts_of(out, x.shape[2], plan.hidden, y.shape[1])
    h, kept = run(p, x)
    error = 2 * scale * ((h * mask) @ p["head"] + p["bias"] - y)
    g["head"][:], g["bias"][:] = (h * mask).T @ error, error.sum(0)
    dh, dc = (error @ p["head"].T) * mask, np.zeros_like(h)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, cell, o, before, up, last = kept[t]
        dc = dc + dh * o * (1 - up * up)
        dz = np.concatenate([dc * cell * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - cell * cell), dh * up * o * (1 - o)], 1)
        g["wx"] += x[:, t].T @ dz
        g["wh"] += last.T @ dz
        g["bx"] += dz.sum(0)
        dh, dc = dz @ p["wh"].T, dc * f
    g["bh"][:] = g["bx"]
    return out


Pieces = dict[int, tuple[np.ndarray, np.ndarray]]
Gather = Callable[[list[tuple[int, np.ndarray]]], list[tuple[int, np.ndarray]]]


class States:
    """The state of training after each epoch, as files in a shared folder."""

    def __init__(self, folder: str):
        folder = "file://" + folder[5:] if folder.startswith("file:") and not folder.startswith("file://") else folder
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)

    def save(self, epoch: int, state: dict) -> None:
        body = io.BytesIO()
        np.savez(body, **state)
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/new-{epoch}") as f:
            f.write(body.getvalue())
        self.fs.move(f"{self.root}/new-{epoch}", f"{self.root}/epoch-{epoch:06d}")

    def last(self) -> dict | None:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.startswith("epoch-"))
        if not names:
            return None
        with self.fs.open_input_file(names[-1]) as f, np.load(io.BytesIO(f.read())) as held:
            return {k: held[k] for k in held.files}


def train(fit: Pieces, valid: Pieces, n: int, n_valid: int, shape: tuple[int, int], plan: Plan, gather: Gather, states: States | None = None, leads: bool = True) -> tuple[np.ndarray, int, float]:
    """Best weights, epochs made and least loss. fit and valid hold the pieces of this task, by number, of
    n and n_valid rows in all; shape is channels and outputs. Every task takes the same steps."""
    channels, outputs = shape
    w = begun(channels, outputs, plan)
    state = {"w": w, "m": np.zeros_like(w), "v": np.zeros_like(w), "best": w, "least": np.inf, "wait": 0, "step": 0, "epoch": 0}
    state |= (states.last() or {}) if states else {}
    w, m, v, best = (np.array(state[k], float) for k in ("w", "m", "v", "best"))
    least, wait, step, epoch = float(state["least"]), int(state["wait"]), int(state["step"]), int(state["epoch"])
    each = plan.batch // plan.piece
    while epoch < plan.epochs and wait < plan.patience:
        for b in range(-(-n // plan.batch)):
            scale = 1 / (min(plan.batch, n - b * plan.batch) * outputs)
            own = []
            for k in (k for k in range(b * each, (b + 1) * each) if k in fit):
                x, y = fit[k]
                keep = np.random.default_rng((plan.seed, epoch, k)).random((len(x), plan.hidden)) >= plan.dropout
                own.append((k, gradient(w, x, y, plan, keep / (1 - plan.dropout), scale)))
            g, step = sum(x for _, x in gather(own)), step + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - plan.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        off = [(k, np.array([((predict(w, x, plan, outputs) - y) ** 2).sum()])) for k, (x, y) in valid.items()]
        loss = float(sum(x for _, x in gather(off))[0]) / (n_valid * outputs) if n_valid else 0.0
        wait = wait + 1
        if loss < least - plan.least:
            least, best, wait = loss, w, 0
        epoch += 1
        if states and leads:
            states.save(epoch, {"w": w, "m": m, "v": v, "best": best, "least": least, "wait": wait, "step": step, "epoch": epoch})
    return best, epoch, least


def alone(own: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    return sorted(own, key=lambda x: x[0])


def together(own: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """What all tasks of a barrier stage have, in order."""
    body = io.BytesIO()
    np.savez(body, at=np.array([k for k, _ in own], np.int64), x=np.array([x for _, x in own]))
    out = []
    for text in BarrierTaskContext.get().allGather(base64.b64encode(body.getvalue()).decode()):
        with np.load(io.BytesIO(base64.b64decode(text))) as held:
            out += list(zip(held["at"].tolist(), held["x"], strict=True))
    return alone(out)


def scaled(rows: pd.DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    raw = np.array([[[s[c] for c in CHANNELS] for s in w] for w in rows["window"]], float)
    return (raw - mean) / spread


def pieces(rows: pd.DataFrame, targets: Sequence[str], mean: np.ndarray, spread: np.ndarray, size: int) -> Pieces:
    """Rows with positions as whole pieces."""
    if rows.empty:
        return {}
    rows = rows.sort_values("pos", ignore_index=True)
    x, y = scaled(rows, mean, spread), rows[list(targets)].to_numpy(float)
    number = rows["pos"].to_numpy() // size
    return {int(k): (x[number == k], y[number == k]) for k in np.unique(number)}


def networks(rows: DataFrame, targets: Sequence[str], plan: Plan | None = None, task_rows: int = TASK_ROWS, tasks: int = 4) -> dict:
    """For each fold the mean and spread of its channels, its best weights, epochs and least loss. rows:
    fold, part (fit or cal), asset, date, window (structs of CHANNELS) and targets, none of them null.
    Folds of more than task_rows rows are trained by `tasks` tasks."""
    plan, targets = plan or Plan(), list(targets)
    if plan.batch % plan.piece:
        raise ValueError("a batch must be whole pieces")
    stats = rows.where("part = 'fit'").select("fold", F.inline("window")).groupBy("fold").agg(*(F.avg(c).alias(f"m_{c}") for c in CHANNELS), *(F.stddev_pop(c).alias(f"s_{c}") for c in CHANNELS))
    scale = {r["fold"]: (np.array([r[f"m_{c}"] for c in CHANNELS]), np.array([r[f"s_{c}"] for c in CHANNELS]) + 1e-8) for r in stats.collect()}
    sizes: dict = {}
    for r in rows.groupBy("fold", "part").count().collect():
        sizes.setdefault(r["fold"], {})[r["part"]] = r["count"]
    placed = blocks.positions(rows.select(F.struct("fold", "part").alias("asset"), F.struct("asset", "date").alias("date"), "window", *targets)).select("asset.fold", "asset.part", "pos", "window", *targets)
    out, shape = {}, (len(CHANNELS), len(targets))
    made = "fold timestamp_ntz, weights array<double>, epochs int, loss double"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        fold = group["fold"].iloc[0]
        fit, valid = (pieces(group[group["part"] == p], targets, *scale[fold.to_pydatetime()], plan.piece) for p in ("fit", "cal"))
        n = {p: int((group["part"] == p).sum()) for p in ("fit", "cal")}
        w, epochs, loss = train(fit, valid, n["fit"], n["cal"], shape, plan, alone)
        return pd.DataFrame({"fold": [fold], "weights": [w], "epochs": [epochs], "loss": [loss]})

    known = [f for f in scale if sizes[f].get("fit")]
    large = [f for f in known if sum(sizes[f].values()) > task_rows]
    small = [f for f in known if f not in large]
    found = placed.where(F.col("fold").isin(small)).groupBy("fold").applyInPandas(one, made).collect() if small else []
    for fold in large:
        path = f"{scratch(rows.sparkSession)}/training-{uuid.uuid4().hex}"
        n = sizes[fold]

        def share(batches, fold=fold, path=path, n=n):
            held = pd.concat([*batches] or [pd.DataFrame({c: [] for c in ("part", "pos", "window", *targets)})], ignore_index=True)
            fit, valid = (pieces(held[held["part"] == p], targets, *scale[fold], plan.piece) for p in ("fit", "cal"))
            leads = BarrierTaskContext.get().partitionId() == 0
            w, epochs, loss = train(fit, valid, n["fit"], n.get("cal", 0), shape, plan, together, States(path), leads)
            if leads:
                yield pd.DataFrame({"fold": [pd.Timestamp(fold)], "weights": [w], "epochs": [epochs], "loss": [loss]})

        own = placed.where(F.col("fold") == F.lit(fold)).drop("fold")
        found += own.repartition(tasks, "part", F.expr(f"pos div {plan.piece}")).mapInPandas(share, made, barrier=True).collect()
        dropped(rows.sparkSession, path)
    for r in found:
        out[r["fold"]] = (*scale[r["fold"]], np.array(r["weights"]), r["epochs"], r["loss"])
    return out
