"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of a fixed number of bytes. A window is embedded byte by byte, filters of
several widths slide over it, each filter keeps its maximum, and a softmax layer gives the languages.
A document's probabilities are the means over all windows of its whole text, weighted by their bytes.
For prediction the embedding and the filters fold into two tables over pairs of bytes, so a window
costs two lookups a byte.

The network learns from at most `max_windows` labelled windows, one drawn from each labelled document
in the order of a hash; that bound is a parameter, and predictions cover all rows and whole texts. The
sample is drawn from all labels alike: a language with fewer than 1 in `max_windows` of the labelled
documents may have no window in it, and is then never predicted.

Edge cases: a text that is null or has no letter is `und` with score 0; rows without a label are not
learned from; if no row can be learned from, everything is `und`; repeated rows are predicted alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import store
from . import textkit as tk

WINDOW = 256
MAX_WINDOWS = 6000
EMBED = 8
FILTERS = ((2, 8), (3, 12), (4, 12))
WIDE = max(w for w, _ in FILTERS)
TOTAL = sum(n for _, n in FILTERS)
PAD = 256


class ByteNet:
    """Multi-width byte convolutions, max pooling and softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.mask = np.zeros((WIDE, 1, TOTAL), np.float32)
        at = 0
        for width, n in FILTERS:
            self.mask[:width, :, at : at + n] = 1
            at += n
        self.filters = rng.normal(0, 0.3, (WIDE, EMBED, TOTAL)).astype(np.float32) * self.mask
        self.bias = np.zeros(TOTAL, np.float32)
        self.dense = rng.normal(0, 0.2, (TOTAL, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of bytes adds at offsets 0 and 1, and at 2 and 3."""
        one = np.einsum("be,wef->wbf", self.embed, self.filters)
        return tuple((one[i][:, None, :] + one[i + 1][None, :, :]).reshape(-1, TOTAL) for i in (0, 2))

    def pooled(self, windows: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over windows padded by WIDE bytes, and the responses."""
        pairs = windows[:, :-1] * np.int32(PAD + 1) + windows[:, 1:]
        out = tables[0].take(pairs[:, :-2].ravel(), axis=0)
        out += tables[1].take(pairs[:, 2:].ravel(), axis=0)
        out = out.reshape(len(windows), -1, TOTAL)
        return out.max(axis=1), out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        """Adam on the cross entropy, classes weighted to count alike; gradients of the pooled
        filters reach only the positions of the maxima. The number of steps does not depend on how
        many windows there are, so a small table is learned as well as a large one."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(self.labels))
        weight = (len(labels) / (np.maximum(counts, 1) * len(self.labels))).astype(np.float32)
        names = ("embed", "filters", "bias", "dense", "shift")
        moment = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        step = 0
        while step < steps:
            order = rng.permutation(len(labels))
            for lo in range(0, min(len(order), (steps - step) * batch), batch):
                rows = order[lo : lo + batch]
                x, y = windows[rows], labels[rows]
                pooled, out = self.pooled(x, self.tables())
                where = out.argmax(axis=1)
                hidden = np.maximum(pooled + self.bias, 0)
                grad = self.probabilities(pooled)
                grad[np.arange(len(y)), y] -= 1
                grad *= weight[y][:, None] / len(y)
                below = (grad @ self.dense.T) * (hidden > 0)
                seen = x[np.arange(len(y))[:, None, None], where[:, :, None] + np.arange(WIDE)]
                vectors = self.embed[seen]
                g = {"dense": hidden.T @ grad, "shift": grad.sum(0), "bias": below.sum(0)}
                g["filters"] = np.einsum("nf,nfwe->wef", below, vectors) * self.mask
                to_bytes = below[:, :, None, None] * self.filters.transpose(2, 0, 1)[None]
                g["embed"] = np.zeros_like(self.embed)
                np.add.at(g["embed"], seen.ravel(), to_bytes.reshape(-1, EMBED))
                g["embed"][PAD] = 0
                step += 1
                for n in names:
                    m, v = moment[n]
                    m += 0.1 * (g[n] - m)
                    v += 0.01 * (g[n] * g[n] - v)
                    setattr(self, n, (getattr(self, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        return self


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded windows of all documents, how many bytes each holds, and the first window of each."""
    sizes = np.diff(offsets)
    n = (sizes + WINDOW - 1) // WINDOW
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(sizes)), n)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    held = np.minimum(WINDOW, offsets[1:][doc] - start)
    at = start[:, None] + np.arange(WINDOW + WIDE - 1)
    inside = np.arange(WINDOW + WIDE - 1)[None, :] < held[:, None]
    wide = data.astype(np.int32)[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.int32)
    return np.where(inside, wide, np.int32(PAD)), held, first


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn(docs: DataFrame, text: str, lang: str, held_out: Column, order: Column, max_windows: int) -> ByteNet | None:
    """A network from one window of each of at most max_windows labelled rows, or None."""
    at = F.pmod(F.xxhash64(order, F.lit(3)), F.greatest(F.length(text) - F.lit(WINDOW), F.lit(1)))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.substring(F.col(text).cast("string"), (at + 1).cast("int"), F.lit(WINDOW)).alias("window"), F.xxhash64(order, F.lit(5)).alias("draw"))
    eligible = rows.count()
    if eligible > 2 * max_windows:
        # A hash threshold that about twice the bound pass: each task sends its share, not the bound.
        rows = rows.where(F.col("draw") < F.lit(-(1 << 63) + int((1 << 64) * (2 * max_windows / eligible))))
    sample = [(r["lang"], r["window"]) for r in rows.orderBy("draw", "lang", "window").limit(max_windows).collect() if has_letter(r["window"])]
    if not sample:
        return None
    labels = sorted({x for x, _ in sample})
    raw = [w.encode()[:WINDOW] for _, w in sample]
    windows, _, _ = cut(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return ByteNet(labels).fit(windows, np.array([labels.index(x) for x, _ in sample]))


def predict(shared, text: str, kept: bool):
    """A map stage: language and score of each text, which stays among the columns if kept."""

    def stage(batches):
        net: ByteNet | None = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            column = batch.column(text)
            lettered = np.array([has_letter(v.as_py()) for v in column], bool)
            names, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            for lo, hi, data, off in tk.each_chunk(column, 1 << 17) if net else ():
                windows, held, first = cut(data, off)
                total = np.zeros((hi - lo, len(net.labels)))
                doc = tk.owner(first, np.arange(len(windows)))
                for a in range(0, len(windows), 512):
                    p = net.probabilities(net.pooled(windows[a : a + 512], tables)[0])
                    np.add.at(total, doc[a : a + 512], p * held[a : a + 512, None])
                mean = total / np.maximum(np.diff(off), 1)[:, None]
                best = mean.argmax(axis=1)
                ok = lettered[lo:hi]
                names[lo:hi] = np.where(ok, np.array(net.labels, object)[best], "und")
                scores[lo:hi] = np.where(ok, np.clip(mean[np.arange(hi - lo), best], 0, 1), 0.0)
            out = {n: batch.column(n) for n in batch.schema.names if kept or n != text}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return stage


def crc_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the identifier as text leaves remainder `fold`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, keep: list[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, the columns of keep, held_out, lang_pred and score. Rows whose
    identifier falls in the held-out fold, and rows without identifier, are never learned from."""
    store.small_batches(docs.sparkSession)
    held = F.coalesce(crc_fold(F.col(doc_id), folds, fold), F.lit(True))
    net = learn(docs, text, lang, held, F.col(doc_id), max_windows)
    kept = text in (keep or [])
    read = text if kept else "text"
    held_out = F.coalesce(crc_fold(F.col(doc_id), folds, fold), F.lit(False)).alias("held_out")
    given = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(c) for c in keep or []), held_out)
    schema = StructType([*given.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    rows = given if kept else docs.select(F.col(doc_id).alias("doc_id"), *(F.col(c) for c in keep or []), held_out, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(store.lean(predict(docs.sparkSession.sparkContext.broadcast(net), read, kept)), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op9 from the operator's output."""
    return found.select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs whose language is found with a score of `least` or more, all their columns."""
    names = docs.columns
    own = {c: f"keep_{i}" for i, c in enumerate(names)}
    packed = docs.select(*(F.col(c).alias(own[c]) for c in names))
    found = languages(packed, doc_id=own[doc_id], text=own[text], lang=own[lang], keep=list(own.values()), max_windows=max_windows)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(names)))
