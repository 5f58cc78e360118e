"""An interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays
and memory-mapped by the workers that score.

Counting: tasks count the pairs of their training documents and send each range of history hashes one
packed row; a range merges its pairs into a file of sorted pair hashes with counts and of histories
with totals and counts of counts, and sends on how many histories each word follows; ranges of words
merge those into files of continuation counts. Only sums of counts reach the driver: the discounts
follow from them. The model's files stay in the shared folder; a worker maps them and looks up the
sorted distinct pairs of a batch, so its memory does not grow with the model.

A text is its lower-cased words (A-Z only), then one end token, after one start token that is not
scored. Words are 64-bit hashes; as followers in pairs they keep 40 bits, so among a million distinct words about one pair of them is
counted as one word, and among a hundred million 1 in 20,000 words shares its counts with another.

Edge cases: null and empty texts are an end alone; rows without identifier are neither held out nor
learned from; with nothing to learn from, all tokens are unknown and every probability is 1; repeated
rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, store
from . import textkit as tk
from .language import crc_fold

START = np.array([0x5BD1E995A3C59AC3], tk.U)
END = np.array([0x2545F4914F6CDD1D], tk.U)
BATCH_BYTES = 16 << 20
#: Bytes of training text for each range of hashes, which is one group and one file.
PART_BYTES = 24 << 20
SCORE_BYTES = (2 << 20) - 64
_LOW = tk.U((1 << 40) - 1)


def follower(words: np.ndarray) -> np.ndarray:
    return tk.mix(words) & _LOW


def pair_keys(histories: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """Hashes of pairs that sort by the hash of the history first."""
    return histories >> tk.U(40) << tk.U(40) | tk.mix(histories * tk.U(0x9E6C63D0676A9A99) + followers) & _LOW


def ranges(values: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes each value is in."""
    return ((values >> tk.U(40)) * tk.U(n) >> tk.U(24)).astype(np.int64)


def token_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the token before each, and the first token of each document."""
    words, first = tk.word_hashes(tk.LOWER[data], offsets)
    first = first + np.arange(len(first))
    tokens = np.empty(int(first[-1]), tk.U)
    inner = np.ones(len(tokens), bool)
    inner[first[1:] - 1] = False
    tokens[inner] = words
    tokens[~inner] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return tokens, before, first


def grouped(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, one place of each, and how often each occurs."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(heads, len(ranked)))
    else:
        total = np.add.reduceat(counts[order], heads) if len(heads) else np.zeros(0, np.int64)
    return ranked[heads], order[heads], total


NAMES = ("histories", "lengths", "low", "high", "counts")
PAIRS = "part int, " + ", ".join(f"{n} binary" for n in NAMES)


def count_pairs(parts: int, limit: int):
    """A map stage over training texts: packed counts of pairs for each range of histories."""

    def flush(tokens, before):
        w, v = follower(np.concatenate(tokens)), np.concatenate(before)
        keys, at, n = grouped(pair_keys(v, w))
        w, v = w[at], v[at]
        cuts = np.searchsorted(ranges(keys, parts), np.arange(parts + 1))
        rows = []
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            h = v[a:b]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            rows.append((p, h[heads].tobytes(), np.diff(np.append(heads, len(h))).astype(np.uint32).tobytes(), w[a:b].astype(np.uint32).tobytes(), (w[a:b] >> tk.U(32)).astype(np.uint8).tobytes(), n[a:b].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))], names=["part", *NAMES])

    def stage(batches):
        tokens, before, size = [], [], 0
        for batch in batches:
            for _, _, data, off in tk.each_chunk(batch.column("text")):
                t, b, _ = token_pairs(data, off)
                tokens.append(t)
                before.append(b)
                size += len(data)
                if size >= limit:
                    yield flush(tokens, before)
                    tokens, before, size = [], [], 0
        if tokens:
            yield flush(tokens, before)

    return stage


def blobs(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def counts_of(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


WORDS = "part int, low binary, high binary, counts binary, kind string, sums array<long>"
_WORDS = pa.schema([("part", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary()), ("kind", pa.string()), ("sums", pa.list_(pa.int64()))])


def merge_pairs(folder: str, parts: int):
    """A range of histories: writes its file; sends on the continuations and sums."""

    def stage(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        v = np.repeat(blobs(table, "histories", tk.U), blobs(table, "lengths", np.uint32))
        w = blobs(table, "low", np.uint32).astype(tk.U) | blobs(table, "high", np.uint8).astype(tk.U) << tk.U(32)
        keys, at, n = grouped(pair_keys(v, w), blobs(table, "counts", np.uint32).astype(np.int64))
        v, w = v[at], w[at]
        order = np.argsort(v, kind="stable")
        ranked = v[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        histories = {"histories": ranked[heads], "total": np.add.reduceat(n[order], heads)}
        for k in (1, 2, 3):
            histories[f"n{k}"] = np.add.reduceat(((n[order] == k) if k < 3 else (n[order] >= 3)).astype(np.uint32), heads)
        more = np.flatnonzero(n > 255)
        arrays.write(folder, f"pairs-{part:06d}", histories | {"pairs": keys, "counts": np.minimum(n, 255).astype(np.uint8), "more": more, "more_counts": n[more]})
        started = histories["total"][ranked[heads] == START[0]].sum()
        rows = [(0, b"", b"", b"", "pairs", [part, int(n.sum()), len(heads) - int((ranked[heads] == START[0]).any()), int(started), *counts_of(n)])]
        words, _, follows = grouped(w)
        cuts = np.searchsorted((words * tk.U(parts)) >> tk.U(40), np.arange(parts + 1).astype(tk.U))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                rows.append((p, words[a:b].astype(np.uint32).tobytes(), (words[a:b] >> tk.U(32)).astype(np.uint8).tobytes(), follows[a:b].astype(np.uint32).tobytes(), "words", []))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WORDS, strict=True)], schema=_WORDS)

    return stage


def merge_words(folder: str):
    """A range of words: writes its file; passes sums on."""

    def stage(table: pa.Table) -> pa.Table:
        sums = [(r["kind"], r["sums"]) for r in table.select(["kind", "sums"]).to_pylist() if r["kind"] != "words"]
        part = table.column("part")[0].as_py()
        w = blobs(table, "low", np.uint32).astype(tk.U) | blobs(table, "high", np.uint8).astype(tk.U) << tk.U(32)
        if len(w):
            words, _, n = grouped(w, blobs(table, "counts", np.uint32).astype(np.int64))
            arrays.write(folder, f"words-{part:06d}", {"words": words, "follows": n.astype(np.uint64)})
            sums.append(("words", [part, int(n.sum()), len(words), 0, *counts_of(n), int((n >= 3).sum())]))
        return pa.table({"kind": pa.array([k for k, _ in sums], pa.string()), "sums": pa.array([s for _, s in sums], pa.list_(pa.int64()))})

    return stage


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified discounts for counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.01), k) for k, x in enumerate(d, 1))])


class Model:
    """Where the files are and what follows from the sums."""

    def __init__(self, folder: str, parts: int, rows):
        self.folder, self.parts = folder, parts
        pairs = [r[1] for r in rows if r[0] == "pairs"]
        words = [r[1] for r in rows if r[0] == "words"]
        self.pair_files, self.word_files = {r[0] for r in pairs}, {r[0] for r in words}
        self.texts = sum(r[3] for r in pairs)
        self.tokens = sum(r[1] for r in pairs)
        self.distinct = sum(r[2] for r in pairs) + (1 if pairs else 0)
        self.pair_discounts = discounts(np.array([r[4:8] for r in pairs]).sum(0)) if pairs else np.zeros(4)
        self.follows, self.followers = sum(r[1] for r in words), sum(r[2] for r in words)
        counts = np.array([r[4:9] for r in words]).sum(0) if words else np.zeros(5)
        self.word_discounts = discounts(counts[:4])
        self.spare = float(self.word_discounts[1:] @ counts[[0, 1, 4]]) / self.follows / (self.followers + 1) if words else 1.0
        self.open: dict[str, dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            self.open[name] = arrays.mapped(self.folder, name)
        return self.open[name]

    def lookup(self, keys: np.ndarray, part: np.ndarray, kind: str, column: str, out: list[str]) -> list[np.ndarray]:
        """Values of sorted keys in the files of their ranges; 0 where a key is missing."""
        found = [np.zeros(len(keys), np.int64) for _ in out]
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for p in range(self.parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b or p not in (self.pair_files if kind == "pairs" else self.word_files):
                continue
            held = self.file(f"{kind}-{p:06d}")
            at = np.minimum(np.searchsorted(held[column], keys[a:b]), len(held[column]) - 1)
            ok = held[column][at] == keys[a:b]
            for values, name in zip(found, out, strict=True):
                values[a:b][ok] = held[name][at[ok]]
                if name == "counts" and len(held["more"]):
                    rich = np.flatnonzero(ok & (values[a:b] == 255))
                    place = np.minimum(np.searchsorted(held["more"], at[rich]), len(held["more"]) - 1)
                    exact = held["more"][place] == at[rich]
                    values[a:b][rich[exact]] = held["more_counts"][place[exact]]
        return found

    def spread(self, keys: np.ndarray):
        """Sorted distinct keys and the place of each key among them."""
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        return ranked[new], place

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score and model score."""
        tokens, before, first = token_pairs(data, offsets)
        words, word = self.spread(tokens)
        part = ranges(words, self.parts)
        count, = self.lookup(words, part, "pairs", "histories", ["total"])
        count[words == END[0]] = self.texts
        known = count[word]
        base = np.log10((known + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        short, place = self.spread(follower(words))
        follows, = self.lookup(short, ((short * tk.U(self.parts)) >> tk.U(40)).astype(np.int64), "words", "words", ["follows"])
        single = (follows - self.word_discounts[np.minimum(follows, 3)]) / max(self.follows, 1) + self.spare
        lower = single[place][word]
        histories, history = self.spread(before)
        total, n1, n2, n3 = self.lookup(histories, ranges(histories, self.parts), "pairs", "histories", ["total", "n1", "n2", "n3"])
        d = self.pair_discounts
        back = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        pairs, pair = self.spread(pair_keys(before, follower(tokens)))
        joint, = self.lookup(pairs, ranges(pairs, self.parts), "pairs", "pairs", ["counts"])
        c = joint[pair]
        p = (c - d[np.minimum(c, 3)]) / np.maximum(total[history], 1) + back[history] * lower
        heads = first[:-1]
        return np.diff(first), np.add.reduceat((known > 0).astype(np.int64), heads), np.add.reduceat(base, heads), np.add.reduceat(np.log10(p), heads)


def fit(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES) -> Model:
    """Counts a model over the texts of docs and writes it to the shared folder."""
    spark = docs.sparkSession
    folder = store.new_path(spark, "ngrams")
    rows = docs.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(store.partitions(spark), -(-size // PART_BYTES))
    merged = rows.mapInArrow(store.lean(count_pairs(parts, batch_bytes)), PAIRS).repartition(parts, "part").groupBy("part").applyInArrow(store.lean_group(merge_pairs(folder, parts)), WORDS)
    sums = merged.repartition(parts, "part").groupBy("part").applyInArrow(store.lean_group(merge_words(folder)), "kind string, sums array<long>")
    return Model(folder, parts, [(r["kind"], list(r["sums"])) for r in sums.collect()])


def score_texts(shared):
    """A map stage: tokens and scores of each text."""

    def stage(batches):
        model: Model = shared.value
        for batch in batches:
            parts = [model.score(data, off) for _, _, data, off in tk.each_chunk(batch.column("text"), SCORE_BYTES)]
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")} | dict(zip(("n_tokens", "n_known", "base_score", "score"), joined, strict=True)))

    return stage


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability) and perplexity. The model learns from the rows outside the held-out fold."""
    held = crc_fold(F.col(doc_id), folds, fold)
    model = fit(docs.where(~held), text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(store.lean(score_texts(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op6 from the operator's output."""
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
