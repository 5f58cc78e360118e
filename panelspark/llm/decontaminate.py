"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `width` consecutive words of an item; an item with fewer words, but not none, is one
window. The set of a window is its shingles. A window occurs only where all of its shingles do, so
its necessary prefix under rarity order is one shingle: the one that the corpus has least often.
Documents join on that shingle alone; the position inside the window and the ends of the document
bound the place, where every word is then compared.

Items are read in blocks of bounded size and each block is broadcast; documents flow through one
map stage a block, so neither the items nor the documents are ever shuffled.

Edge cases: null and empty texts have no words and are never hit; an item without words has no
window; items without an identifier hit like others and are together one null, listed first, which
counts as an item and adds nothing to the hash of the list; repeated items and repeated rows are each
reported; an empty table gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textkit as tk

#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 4 << 20
SHINGLE = 4


def by_name(names) -> list[str | None]:
    """Names in order, null first."""
    return sorted(names, key=lambda x: (x is not None, x or ""))


def lowered(data: np.ndarray) -> np.ndarray:
    return tk.LOWER[data]


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Blocks of (id, text) of bounded size; one item may exceed it."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        raw = (row[1] or "").encode()
        block.append((row[0], raw))
        size += len(raw) + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


class Windows:
    """The distinct windows of a block of items, by length."""

    def __init__(self, block: list[tuple[str | None, bytes]], width: int, shingle: int):
        found: dict[bytes, set[str | None]] = {}
        for name, raw in block:
            words = tk.word_hashes(lowered(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]), tk.ALNUM_WORD)[0]
            if len(words):
                n = min(width, len(words))
                for i in range(len(words) - n + 1):
                    found.setdefault(words[i : i + n].tobytes(), set()).add(name)
        keys = sorted(found)
        self.words = [np.frombuffer(k, tk.U) for k in keys]
        self.items = [by_name(found[k]) for k in keys]
        self.grams = [tk.gram_hashes(w, min(shingle, len(w))) for w in self.words]
        self.sizes = sorted({min(shingle, len(w)) for w in self.words})
        self.tokens = {k: np.unique(np.concatenate([g for g, w in zip(self.grams, self.words, strict=True) if min(shingle, len(w)) == k])) for k in self.sizes}
        self.shingle = shingle
        self.prefix: dict[int, tuple] = {}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps for each window the rarest shingle; one that the corpus lacks ends the window."""
        by: dict[int, list[tuple[int, int, int]]] = {k: [] for k in self.sizes}
        for i, (g, w) in enumerate(zip(self.grams, self.words, strict=True)):
            k = min(self.shingle, len(w))
            c = counts[k][np.searchsorted(self.tokens[k], g)]
            at = int(np.lexsort((g, c))[0])
            if c[at]:
                by[k].append((int(g[at]), at, i))
        for k, rows in by.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], tk.U)
            self.prefix[k] = (keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        width = int(self.lengths.max()) if len(self.lengths) else 0
        self.matrix = np.zeros((len(self.words), width), tk.U)
        for i, w in enumerate(self.words):
            self.matrix[i, : len(w)] = w
        del self.grams


def among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of the values that are among the sorted keys; a bitmap drops most others first."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(keys >> tk.U(44)).astype(np.int64)] = True
    at = np.flatnonzero(bitmap[(values >> tk.U(44)).astype(np.int64)])
    where = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    return at[keys[where] == values[at]]


def count_tokens(tokens: dict[int, np.ndarray]):
    """A map stage: how often the documents have each token of the items."""

    def stage(batches):
        held = tokens.value
        counts = {k: np.zeros(len(v), np.int64) for k, v in held.items()}
        for batch in batches:
            for _, _, data, off in tk.each_chunk(batch.column("text")):
                words, _ = tk.word_hashes(lowered(data), off, tk.ALNUM_WORD)
                for k, keys in held.items():
                    g = tk.gram_hashes(words, k)
                    np.add.at(counts[k], np.searchsorted(keys, g[among(keys, g)]), 1)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"k": np.full(len(at), k), "at": at, "n": c[at]})

    return stage


def join_windows(windows):
    """A map stage: adds the hits of one block of windows to the rows that flow through."""

    def hits(w: Windows, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all occurrences."""
        starts, which = [], []
        ends = first[1:]
        for k, (keys, place, window) in w.prefix.items():
            g = tk.gram_hashes(words, k)
            at = among(keys, g)
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            n = hi - lo
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(at, n)
            begin = pos - place[rows]
            win = window[rows]
            doc = tk.owner(first, pos)
            ok = (begin >= first[doc]) & (begin + w.lengths[win] <= ends[doc])
            begin, win = begin[ok], win[ok]
            good = np.ones(len(begin), bool)
            for j in range(w.matrix.shape[1]):
                deep = j < w.lengths[win]
                good &= ~deep | (words[np.minimum(begin + j, len(words) - 1)] == w.matrix[win, j])
            starts.append(begin[good])
            which.append(win[good])
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def stage(batches):
        w: Windows = windows.value
        for batch in batches:
            n_words = np.zeros(len(batch), np.int64)
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for lo, hi, data, off in tk.each_chunk(batch.column("text")):
                words, first = tk.word_hashes(lowered(data), off, tk.ALNUM_WORD)
                n_words[lo:hi] = np.diff(first)
                starts, which = hits(w, words, first)
                if not len(starts):
                    continue
                doc = tk.owner(first, starts)
                for d in np.unique(doc):
                    mine = doc == d
                    s, v = starts[mine] - first[d], which[mine]
                    spans = old_spans[lo + d] or []
                    flags = tk.covered(int(n_words[lo + d]), np.concatenate([s, np.array(spans[::2], np.int64)]), np.concatenate([w.lengths[v], np.array(spans[1::2], np.int64) - np.array(spans[::2], np.int64)]))
                    a, b = tk.runs(flags, np.array([0, len(flags)]))
                    old_spans[lo + d] = np.stack([a, b], 1).ravel().tolist()
                    old_items[lo + d] = by_name({*(old_items[lo + d] or []), *(x for i in np.unique(v) for x in w.items[i])})
            out = {name: batch.column(name) for name in batch.schema.names}
            out |= {"n_words": pa.array(n_words), "spans": pa.array(old_spans, pa.list_(pa.int64())), "items": pa.array(old_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return stage


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = SHINGLE, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text, the columns of `keep`, n_words, spans (start and end of each
    hit run, in words, flattened) and items (ids of the items with occurring windows, sorted, null first)."""
    spark = docs.sparkSession
    store.small_batches(spark)
    flow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in keep or []))
    plain = flow.select("text")
    flow = flow.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<bigint>)"), "items": F.expr("cast(array() as array<string>)")})
    any_block = False
    for block in item_blocks(items, item_id, item_text, block_bytes):
        w = Windows(block, width, shingle)
        if not w.words:
            continue
        sent = spark.sparkContext.broadcast(w.tokens)
        counts = {k: np.zeros(len(v), np.int64) for k, v in w.tokens.items()}
        for row in plain.mapInArrow(store.lean(count_tokens(sent)), "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
            counts[row["k"]][row["at"]] = row["n"]
        w.order(counts)
        flow = flow.mapInArrow(store.lean(join_windows(spark.sparkContext.broadcast(w))), flow.schema)
        any_block = True
    if not any_block:
        flow = flow.mapInArrow(store.lean(join_windows(spark.sparkContext.broadcast(empty_windows(width, shingle)))), flow.schema)
    return flow


def empty_windows(width: int, shingle: int) -> Windows:
    w = Windows([], width, shingle)
    w.order({})
    return w


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op10 from the operator's output."""
    pairs = "aggregate(sequence(0, cast(size(spans) / 2 as int)), 0L, (t, i) -> t + if(2 * i < size(spans), get(spans, 2 * i + 1) - get(spans, 2 * i), 0L))"
    return found.select("doc_id", "n_words", F.expr(pairs).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that no item window occurs in, with all their columns."""
    names = docs.columns
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    rest = [c for c in names if c not in (doc_id, text)]
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(rest)))
    found = contamination(renamed, items, keep=[f"keep_{i}" for i in range(len(rest))], **{k: v for k, v in options.items() if k not in ("doc_id", "text")})
    back = {doc_id: "doc_id", text: "text"} | {c: f"keep_{i}" for i, c in enumerate(rest)}
    return found.where(F.size("spans") == 0).select(*(F.col(back[c]).alias(c) for c in names))
