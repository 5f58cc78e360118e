"""Boosted regression trees on histograms, in numpy.

Features are cut into bins at quantiles; a missing value has a bin of its own, which each split sends
to the side that gains more. A tree grows at the leaf of the largest gain, up to a number of leaves
and a depth, so both usual shapes (31 leaves, or five levels) are settings.

Residuals enter histograms as whole numbers (of 2**-22), so that sums don't depend on their order, and
the rows of a tree are drawn by a hash of their keys: a fit in one task and one whose histograms are
summed over a cluster (forest.py) give the same trees.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """How trees grow. Fixed values of the two kinds are in KINDS."""

    leaves: int
    depth: int
    ridge: float
    trees: int = 300
    rate: float = 0.05
    least: int = 50
    rows: float = 0.8
    columns: float = 0.8


# 300 trees at rate 0.05; 31 leaves, or depth 5; 50 rows a leaf; 0.8 of rows and columns.
KINDS = {"lgbm": Shape(leaves=31, depth=64, ridge=0.0), "xgb": Shape(leaves=32, depth=5, ridge=1.0)}
BINS = 64
#: One in residuals, as a whole number; the most that a residual counts.
UNIT, MOST = float(1 << 22), 256.0
#: Gain, column, bin and side of missing values where nothing is gained.
NO_SPLIT = (0.0, -1, 0, False)


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values at which its bins begin."""
    out = []
    for column in x.T:
        known = column[~np.isnan(column)]
        out.append(np.unique(np.quantile(known, np.arange(1, bins - 1) / (bins - 1))) if len(known) else np.zeros(0))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """The bin of each value; the last bin is for missing ones."""
    return np.stack([np.where(np.isnan(c), bins - 1, np.searchsorted(k, c, "right")) for c, k in zip(x.T, cuts, strict=True)], 1).astype(np.int64)


class Tree:
    """Splits as arrays; a leaf has column -1 and a value."""

    def __init__(self):
        self.column, self.bin, self.missing_left, self.left, self.right, self.value = ([] for _ in range(6))

    def add(self, value: float) -> int:
        for items, x in ((self.column, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            items.append(x)
        return len(self.value) - 1

    def predict(self, at: np.ndarray, bins: int) -> np.ndarray:
        column, cut, gone, left, right, value = (np.array(x) for x in (self.column, self.bin, self.missing_left, self.left, self.right, self.value))
        node = np.zeros(len(at), np.int64)
        while True:
            inner = np.flatnonzero(column[node] >= 0)
            if not len(inner):
                return value[node]
            n = node[inner]
            b = at[inner, column[n]]
            node[inner] = np.where(np.where(b == bins - 1, gone[n], b <= cut[n]), left[n], right[n])


def best_split(total: np.ndarray, count: np.ndarray, shape: Shape) -> tuple[float, int, int, bool]:
    """(gain, column, bin, whether missing values go left) from sums and counts of columns by bins."""
    g, n = total[0].sum(), count[0].sum()
    whole = g * g / (n + shape.ridge)
    best = NO_SPLIT
    left, held = np.cumsum(total[:, :-1], 1), np.cumsum(count[:, :-1], 1)
    for missing_left in (False, True) if count[:, -1].any() else (False,):
        if missing_left:
            left, held = left + total[:, -1:], held + count[:, -1:]
        ok = (held >= shape.least) & (n - held >= shape.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left * left / (held + shape.ridge) + (g - left) ** 2 / (n - held + shape.ridge) - whole, 0.0)
        at = int(np.argmax(gain))
        if gain.flat[at] > best[0] + 1e-12:
            best = (float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1], missing_left)
    return best


def whole(residual: np.ndarray) -> np.ndarray:
    """Residuals as whole numbers, held as floats: sums of some 8 million of them are exact."""
    return np.rint(np.clip(residual, -MOST, MOST) * UNIT)


def drawn(keys: np.ndarray, tree: int, shape: Shape, seed: int, n: int) -> np.ndarray:
    """Which rows tree number `tree` is grown on; all where a share of n rows is too few to split."""
    if shape.rows >= 1 or n * shape.rows < 2 * shape.least:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD6E8FEB86659FD93) % (1 << 64))
        for turn in (30, 27):
            x = (x ^ (x >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) < shape.rows * 2.0**53


def drawn_columns(tree: int, shape: Shape, seed: int, width: int) -> np.ndarray:
    k = max(1, round(shape.columns * width))
    return np.sort(np.random.default_rng((seed, tree)).choice(width, k, replace=False))


def judged(total: np.ndarray, count: np.ndarray, shape: Shape) -> tuple[float, int, tuple[float, int, int, bool]]:
    """Sum, number and best split of rows whose whole residuals add up to total."""
    return float(total[0].sum() / UNIT), int(count[0].sum()), best_split(total / UNIT, count, shape)


class Growth:
    """A tree as it grows: nodes whose histograms are known, and which to divide next. With a width
    over 1 it divides leaves that may turn out not to be needed; the tree is the same."""

    def __init__(self, shape: Shape, columns: np.ndarray):
        self.shape, self.columns = shape, columns
        self.split, self.value, self.depth, self.children = {}, {}, {0: 0}, {}

    def give(self, node: int, total: np.ndarray, count: np.ndarray) -> None:
        """The sums of whole residuals and the counts of a node's rows, of columns by bins."""
        self.put(node, *judged(total, count, self.shape))

    def put(self, node: int, g: float, n: int, split: tuple[float, int, int, bool]) -> None:
        """The sum and the number of a node's rows, and the best split of them."""
        self.value[node] = float(self.shape.rate * g / (n + self.shape.ridge)) if n + self.shape.ridge else 0.0
        self.split[node] = split if self.depth[node] < self.shape.depth else NO_SPLIT

    def divisible(self, node: int, n: int) -> bool:
        """Whether a node of n rows may have a split at all."""
        return self.depth[node] < self.shape.depth and n >= 2 * self.shape.least

    def replay(self) -> tuple[list[int], list[int], int]:
        """The splits made so far in their order, the leaves, and how many splits may follow."""
        leaves, made = [0], []
        while len(made) < self.shape.leaves - 1:
            i = max(range(len(leaves)), key=lambda j: self.split[leaves[j]][0])
            if self.split[leaves[i]][0] <= 0:
                return made, leaves, 0
            if leaves[i] not in self.children:
                return made, leaves, self.shape.leaves - 1 - len(made)
            made.append(leaves[i])
            leaves[i : i + 1] = self.children[leaves[i]]
        return made, leaves, 0

    def divide(self, width: int = 1) -> list[tuple[int, int, int]]:
        """Divides the leaves of the largest gains: (node, left, right) of each. Empty when the tree is done."""
        _, leaves, more = self.replay()
        if not more:
            return []
        best = sorted((n for n in leaves if n not in self.children and self.split[n][0] > 0), key=lambda n: -self.split[n][0])[: min(width, more)]
        for n in best:
            at = len(self.depth)
            self.children[n] = (at, at + 1)
            self.depth[at] = self.depth[at + 1] = self.depth[n] + 1
        return [(n, *self.children[n]) for n in best]

    def goes_left(self, node: int, at: np.ndarray, rows: np.ndarray, bins: int) -> np.ndarray:
        _, column, cut, missing_left = self.split[node]
        b = at[rows, self.columns[column]]
        return np.where(b == bins - 1, missing_left, b <= cut)

    def place(self, at: np.ndarray, bins: int) -> np.ndarray:
        """The node that each row has come to."""
        node = np.zeros(len(at), np.int64)
        for n in sorted(self.children):
            rows = np.flatnonzero(node == n)
            left = self.goes_left(n, at, rows, bins)
            node[rows] = np.where(left, *self.children[n])
        return node

    def tree(self) -> Tree:
        made, _, _ = self.replay()
        tree = Tree()
        name = {0: tree.add(self.value[0])}
        for n in made:
            _, column, cut, missing_left = self.split[n]
            i = name[n]
            tree.column[i], tree.bin[i], tree.missing_left[i] = int(self.columns[column]), cut, missing_left
            for side, child in zip((tree.left, tree.right), self.children[n], strict=True):
                name[child] = tree.add(self.value[child])
                side[i] = name[child]
        return tree


def histogram(flat: np.ndarray, residual: np.ndarray, rows: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of whole residuals and counts of the rows, of columns by bins. flat: the bin of each value,
    plus that of its column's first."""
    k = flat.shape[1]
    cells = flat[rows].ravel()
    return np.bincount(cells, np.repeat(residual[rows], k), k * bins).reshape(k, bins), np.bincount(cells, minlength=k * bins).reshape(k, bins)


def grow(at: np.ndarray, flat: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, shape: Shape, bins: int) -> Tree:
    """One tree on the whole residuals of `rows`. Nodes that can't be divided need no histogram."""
    tree = Growth(shape, columns)
    held = {0: (rows, *histogram(flat, residual, rows, bins))}
    tree.give(0, *held[0][1:])
    while parts := tree.divide():
        node, left, right = parts[0]
        r, total, count = held.pop(node)
        goes = tree.goes_left(node, at, r, bins)
        sides = {left: r[goes], right: r[~goes]}
        known = {}
        if any(tree.divisible(child, len(own)) for child, own in sides.items()):
            small, large = sorted(sides, key=lambda child: len(sides[child]))
            known[small] = histogram(flat, residual, sides[small], bins)
            known[large] = (total - known[small][0], count - known[small][1])
        for child, own in sides.items():
            if tree.divisible(child, len(own)):
                held[child] = (own, *known[child])
                tree.give(child, *known[child])
            else:
                tree.put(child, float(residual[own].sum() / UNIT), len(own), NO_SPLIT)
    return tree.tree()


class Booster:
    """Trees, the bins they split on, and the mean they start from."""

    def __init__(self, cuts: list[np.ndarray], start: float, trees: list[Tree], bins: int):
        self.cuts, self.start, self.trees, self.bins = cuts, start, trees, bins

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = binned(np.asarray(x, float), self.cuts, self.bins)
        return self.start + sum((t.predict(at, self.bins) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, shape: Shape, seed: int = 42, bins: int = BINS, cuts: list[np.ndarray] | None = None, keys: np.ndarray | None = None) -> Booster:
    """Least squares by gradient boosting. Rows whose y is not finite are left out; the rows of each tree
    are drawn by their keys, its columns by the seed."""
    known = np.isfinite(y)
    keys = np.arange(len(y), dtype=np.uint64) if keys is None else keys
    x, y, keys = x[known], y[known], keys[known]
    cuts = cut_points(x, bins) if cuts is None else cuts
    at = binned(x, cuts, bins)
    n = len(y)
    start, trees = float(whole(y).sum() / UNIT / max(n, 1)), []
    predicted = np.full(n, start)
    for t in range(shape.trees):
        rows = np.flatnonzero(drawn(keys, t, shape, seed, n))
        columns = drawn_columns(t, shape, seed, x.shape[1])
        tree = grow(at, at[:, columns] + np.arange(len(columns)) * bins, whole(y - predicted), rows, columns, shape, bins)
        trees.append(tree)
        predicted = predicted + tree.predict(at, bins)
    return Booster(cuts, start, trees, bins)


def to_bytes(b: Booster) -> bytes:
    """A model as a compressed archive of arrays."""
    names = ("column", "bin", "missing_left", "left", "right", "value")
    arrays = {n: np.array([x for t in b.trees for x in getattr(t, n)]) for n in names}
    out = io.BytesIO()
    np.savez_compressed(out, sizes=[len(t.value) for t in b.trees], cuts=np.concatenate(b.cuts), cut_sizes=[len(c) for c in b.cuts], start=b.start, bins=b.bins, **arrays)
    return out.getvalue()


def from_bytes(raw: bytes) -> Booster:
    with np.load(io.BytesIO(raw)) as held:
        d = {k: held[k] for k in held.files}
    trees, at = [], 0
    for n in d["sizes"].tolist():
        t = Tree()
        for name in ("column", "bin", "missing_left", "left", "right", "value"):
            setattr(t, name, d[name][at : at + n].tolist())
        trees.append(t)
        at += n
    return Booster(np.split(d["cuts"], np.cumsum(d["cut_sizes"])[:-1]), float(d["start"]), trees, int(d["bins"]))
