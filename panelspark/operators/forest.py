"""Boosted trees whose rows are many tasks: each level of all trees is one aggregation of histograms.

Rows are a table in the shared folder: the bins of their columns as bytes, their targets, and what the
models predict so far. In a pass each task adds up, for every fit and every node that is asked for, the
whole residuals and counts of its rows by column and bin; Spark sums them by cell, and one group a node
finds its split. The driver holds the trees and the splits, whose number the shapes set. Predictions are
written anew every KEEP trees; in between, a pass applies the trees since. Trees are those of
boosting.fit on the same cuts and keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import boosting
from panelspark.spark import dropped, written

KEEP = 10
#: Leaves that a pass divides at once, of those a tree may still have.
WIDTH = 16
TASK_ROWS = 200_000
CELLS = "fit int, node int, cell int, total long, count long"
SPLITS = "fit int, node int, total double, n long, gain double, column int, bin int, missing_left boolean"
Fit = tuple  # (fold, model, target)


def fold_cuts(rows: DataFrame, columns: Sequence[str], bins: int = boosting.BINS, accuracy: int = 10_000) -> dict[object, list[np.ndarray]]:
    """For each fold the values at which the bins of the columns begin: quantiles from mergeable summaries
    within 1 / accuracy of their rank. One row a fold comes to the driver."""
    at = [float(q) for q in np.arange(1, bins - 1) / (bins - 1)]
    known = [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, accuracy).alias(c) for c in columns]
    return {r["fold"]: [np.unique(np.asarray(r[c] if r[c] is not None else [], float)) for c in columns] for r in rows.groupBy("fold").agg(*known).collect()}


def coded(rows: DataFrame, columns: Sequence[str], targets: Sequence[str], cuts: Mapping[object, list[np.ndarray]], bins: int) -> DataFrame:
    """fold, key, codes (a byte a column) and y (an array of targets) of each row."""

    def stage(batches):
        for batch in batches:
            for fold, group in batch.groupby("fold"):
                codes = boosting.binned(group[list(columns)].to_numpy(float), cuts[fold.to_pydatetime()], bins).astype(np.uint8)
                yield pd.DataFrame({"fold": group["fold"], "key": group["key"], "codes": [c.tobytes() for c in codes], "y": list(group[list(targets)].to_numpy(float))})

    return rows.select("fold", "key", *columns, *targets).mapInPandas(stage, "fold timestamp_ntz, key long, codes binary, y array<double>")


def fit(rows: DataFrame, columns: Sequence[str], targets: Sequence[str], kinds: Mapping[str, boosting.Shape], cuts: Mapping[object, list[np.ndarray]], seed: int = 42, bins: int = boosting.BINS) -> dict[Fit, tuple[boosting.Booster, int]]:
    """A booster and its number of rows for each (fold, kind, target). rows: fold, key, the columns and the
    targets, any of them null."""
    spark = rows.sparkSession
    names = list(kinds)
    count = rows.count()
    spread = rows.repartitionByRange(max(1, -(-count // TASK_ROWS)), "fold", "key")
    width = len(names) * len(targets)
    bare, first = written(coded(spread, columns, targets, cuts, bins), "forest")
    unit = F.rint(F.greatest(F.least("v", F.lit(boosting.MOST)), F.lit(-boosting.MOST)) * boosting.UNIT).cast("long")
    sums = bare.select("fold", F.posexplode("y").alias("t", "v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')").groupBy("fold", "t").agg(F.sum(unit).alias("total"), F.count("*").alias("n")).collect()
    fits = sorted(((r["fold"], k, r["t"], r["total"] / boosting.UNIT / r["n"], r["n"]) for r in sums for k in names), key=lambda f: (f[0], names.index(f[1]), f[2]))
    means = {f[0]: [0.0] * width for f in fits}
    for fold, model, t, mean, _ in fits:
        means[fold][names.index(model) * len(targets) + t] = mean
    begun = spark.createDataFrame(list(means.items()), "fold timestamp_ntz, held array<double>")
    table, path = written(bare.join(F.broadcast(begun), "fold"), "forest")
    dropped(spark, first)
    done: list[list[boosting.Tree]] = [[] for _ in fits]
    recent: list[list[boosting.Tree]] = [[] for _ in fits]
    for number in range(max(s.trees for s in kinds.values())):
        open_fits = [i for i, f in enumerate(fits) if number < kinds[f[1]].trees]
        growing = {i: boosting.Growth(kinds[fits[i][1]], boosting.drawn_columns(number, kinds[fits[i][1]], seed, len(columns))) for i in open_fits}
        wanted = {i: [0] for i in open_fits}
        while wanted:
            shared = spark.sparkContext.broadcast((fits, names, recent, {i: (growing[i], wanted[i]) for i in wanted}, number, kinds, seed, bins, len(targets)))
            for r in _splits(table, shared).collect():
                growing[r["fit"]].put(r["node"], r["total"], r["n"], (r["gain"], r["column"], r["bin"], r["missing_left"]))
            shared.destroy()
            wanted = {i: fresh for i in wanted if (fresh := [c for part in growing[i].divide(WIDTH) for c in part[1:]])}
        for i in open_fits:
            tree = growing[i].tree()
            done[i].append(tree)
            recent[i].append(tree)
        if (number + 1) % KEEP == 0:
            shared = spark.sparkContext.broadcast((fits, names, recent, bins, len(targets)))
            old = path
            table, path = written(table.mapInPandas(_held(shared), table.schema), "forest")
            dropped(spark, old)
            recent = [[] for _ in fits]
    dropped(spark, path)
    return {(f[0], f[1], f[2]): (boosting.Booster(cuts[f[0]], f[3], trees, bins), f[4]) for f, trees in zip(fits, done, strict=True)}


def _of_fold(fits, fold):
    return [(i, f) for i, f in enumerate(fits) if f[0] == fold]


def _rows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(len(batch), -1).astype(np.int64)
    return codes, batch["key"].to_numpy().view(np.uint64), np.stack(batch["y"].to_numpy()), np.stack(batch["held"].to_numpy())


def _predicted(held: np.ndarray, trees: Sequence[boosting.Tree], codes: np.ndarray, bins: int) -> np.ndarray:
    """What a fit predicts after more trees; the sum is taken in the order in which they were made."""
    for t in trees:
        held = held + t.predict(codes, bins)
    return held


def _held(shared):
    """A map stage that writes predictions anew."""

    def stage(batches):
        fits, names, recent, bins, width = shared.value
        for batch in batches:
            for fold, group in batch.groupby("fold"):
                codes, _, _, held = _rows(group)
                for i, f in _of_fold(fits, fold.to_pydatetime()):
                    at = names.index(f[1]) * width + f[2]
                    held[:, at] = _predicted(held[:, at], recent[i], codes, bins)
                yield group.assign(held=list(held))

    return stage


def _splits(table: DataFrame, shared) -> DataFrame:
    """The sum, the number of rows and the best split of each node that is asked for."""

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        fits, _, _, growing, _, kinds, _, bins, _ = shared.value
        i, node = int(group["fit"].iloc[0]), int(group["node"].iloc[0])
        k = len(growing[i][0].columns)
        total, count = np.zeros(k * bins), np.zeros(k * bins, np.int64)
        total[group["cell"]], count[group["cell"]] = group["total"], group["count"]
        g, n, split = boosting.judged(total.reshape(k, bins), count.reshape(k, bins), kinds[fits[i][1]])
        return pd.DataFrame([(i, node, g, n, *split)], columns=[c.split()[0] for c in SPLITS.split(", ")])

    cells = table.mapInArrow(_sums(shared), CELLS).groupBy("fit", "node", "cell").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    return cells.groupBy("fit", "node").applyInPandas(judge, SPLITS)


def _sums(shared):
    """A map stage: the histograms of a task's rows, one row a cell that is not empty."""

    def stage(batches):
        fits, names, recent, growing, number, kinds, seed, bins, width = shared.value
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for fold, group in batch.to_pandas().groupby("fold"):
                codes, keys, y, held = _rows(group)
                for i, f in _of_fold(fits, fold.to_pydatetime()):
                    if i not in growing:
                        continue
                    tree, wanted = growing[i]
                    target = y[:, f[2]]
                    use = np.flatnonzero(np.isfinite(target) & boosting.drawn(keys, number, kinds[f[1]], seed, f[4]))
                    own, at = codes[use], names.index(f[1]) * width + f[2]
                    residual = boosting.whole(target[use] - _predicted(held[use, at], recent[i], own, bins))
                    flat = own[:, tree.columns] + np.arange(len(tree.columns)) * bins
                    node = tree.place(own, bins)
                    for n in wanted:
                        total, count = boosting.histogram(flat, residual, np.flatnonzero(node == n), bins)
                        if (i, n) in sums:
                            sums[i, n][0].__iadd__(total.astype(np.int64))
                            sums[i, n][1].__iadd__(count)
                        else:
                            sums[i, n] = (total.astype(np.int64), count)
        for (i, n), (total, count) in sums.items():
            cells = np.flatnonzero(count.ravel())
            k = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(np.full(k, n, np.int32)), pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells]), pa.array(count.ravel()[cells])], names=["fit", "node", "cell", "total", "count"])

    return stage
