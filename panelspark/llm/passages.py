"""Substring dedup by level-wise doubling: windows of words repeated at one length alone go on.

The first level looks up all windows of a quarter of the target length. Those that one document has
alone end there; where both halves of a window of twice the length survive, it is a candidate of the
next level. So the length doubles, the last step up to the target by overlap, until the target is
reached or no candidate survives. Which candidates are in question is one bit a word and block.

At the target length the words themselves meet (see repeats): every word that a window covers which
also starts in a document with a smaller identifier is removed. Hashes of the levels only say which
windows to look at; what is removed is decided on the words.

Edge cases: null and empty texts have no words; a document with fewer words than the target loses
nothing; windows never cross documents; rows with one identifier are not earlier than each other; a
null identifier is the smallest; a text of any length is one document; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, store
from . import textkit as tk

WORDS = 13


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.word_hashes(data, offsets)


def cut(data: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each range, each with one space after it."""
    starts, ends, _ = tk.word_bounds(data, offsets, tk.SPACE_WORD)
    word, count = repeats.spread(lo, hi - lo), hi - lo
    size = ends[word] - starts[word] + 1
    body = np.append(data, np.uint8(32))[repeats.spread(starts[word], size)]
    body[np.cumsum(size) - 1] = 32
    return body, np.add.reduceat(size, np.cumsum(count) - count) if len(count) else count


def judge(words: int, text: np.ndarray, sizes: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows of the texts a smaller identifier has too, word by word."""
    space = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], space[:-1] + 1])
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    at = repeats.spread(first, windows)
    lo, size = starts[at], space[at + words - 1] - starts[at]
    owner = np.repeat(ids, windows)
    hashes = tk.span_hash(text, lo, lo + size)
    order = np.lexsort((owner, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = owner > owner[head]
    asked = np.flatnonzero(head != np.arange(len(head)))
    equal = size[asked] == size[head[asked]]
    equal[equal] = repeats.same_text(text, lo[asked][equal], lo[head[asked]][equal], size[asked][equal])
    if not equal.all():
        clash = np.flatnonzero(np.isin(hashes, hashes[asked[~equal]]))
        least: dict[bytes, int] = {}
        texts = [text[a : a + n].tobytes() for a, n in zip(lo[clash], size[clash], strict=True)]
        for key, name in zip(texts, owner[clash].tolist(), strict=True):
            least[key] = min(name, least.get(key, name))
        out[clash] = [name > least[key] for key, name in zip(texts, owner[clash].tolist(), strict=True)]
    return out


def level_hashes(rows: pa.Table, length: int, chosen: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes of the windows in question, their starts, their documents, first words, words before) of
    each chunk of a block."""
    base = 0
    for lo, _, data, off in tk.each_chunk(rows.column("text")):
        units, first = tk.word_hashes(data, off)
        starts = tk.gram_starts(first, length)
        starts = starts[repeats.chosen_at(chosen, base, int(first[-1]))[starts]]
        yield tk.gram_hashes(units, length)[starts], starts, tk.owner(first, starts) + lo, first, base
        base += int(first[-1])


def level_groups(rows: pa.Table, length: int, chosen: bytes | None, buckets: int) -> repeats.Groups:
    hashes, _, docs, _, _ = zip(*level_hashes(rows, length, chosen), strict=True)
    return repeats.Groups(np.concatenate(hashes), repeats.identifiers(rows)[np.concatenate(docs)], buckets)


def ask_level(folder: str, length: int, buckets: int):
    """A map stage over (block, flags): the hashes of the windows in question."""

    def stage(batches):
        for batch in batches:
            for name, chosen in zip(batch.column("block").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                groups = level_groups(store.read_block(folder, name), length, chosen, buckets)
                yield from repeats.table_of(groups.asks(name), repeats._ASK).to_batches()

    return stage


def extend(folder: str, length: int, longer: int, buckets: int):
    """A group stage over the answers of a level: the windows of the longer length whose first and last
    `length` words both repeat, as one bit a word."""

    def stage(table: pa.Table) -> pa.Table:
        name, chosen = table.column("block")[0].as_py(), repeats.in_question(table)
        rows, known = store.read_block(folder, name), repeats.told(table, 1)
        said = level_groups(rows, length, chosen, buckets).answered(known) > 0 if known else np.zeros(0, bool)
        bits, done = [], 0
        for _, starts, _, first, _ in level_hashes(rows, length, chosen):
            alive = np.zeros(int(first[-1]) + 1, bool)
            alive[starts] = said[done : done + len(starts)]
            done += len(starts)
            at = tk.gram_starts(first, longer)
            keep = np.zeros(int(first[-1]), bool)
            keep[at] = alive[at] & alive[at + longer - length]
            bits.append(keep)
        every = np.concatenate(bits)
        flags = np.packbits(every).tobytes() if every.any() else b""
        return repeats.table_of([(name, 0, 0, flags)], repeats._ANSWER)

    return stage


def candidates(blocks: store.Blocks, words: int) -> DataFrame:
    """The windows of `words` words in question, block by block, after all levels below."""
    spark = blocks.rows.sparkSession
    buckets, tasks = repeats.buckets_for(spark, blocks.size), max(store.partitions(spark), min(blocks.count, 20_000))
    chosen = blocks.rows.select("block", F.lit(0).alias("bucket"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("flags"))
    length = -(-words // 4)
    while length < words:
        longer = min(2 * length, words)
        asks = chosen.select("block", "flags").mapInArrow(store.lean(ask_level(blocks.folder, length, buckets)), repeats.ASK)
        known = chosen.union(repeats.meet_groups(asks, buckets)).repartition(tasks, "block").groupBy("block")
        chosen, _ = store.materialise(known.applyInArrow(store.lean_group(extend(blocks.folder, length, longer, buckets)), repeats.ANSWER), f"level-{longer}")
        if not chosen.where(F.length("flags") > 0).limit(1).count():
            break
        length = longer
    return chosen


KEPT = "doc_id long, n_words long, spans array<long>, kept string"


def finish(rows: pa.Table, covered: np.ndarray) -> pa.Table:
    """Removed spans and the remaining words of each document, joined by one space."""
    counts, spans, kept, base = [], [], [], 0
    for lo, hi, data, off in tk.each_chunk(rows.column("text")):
        starts, ends, first = tk.word_bounds(data, off, tk.SPACE_WORD)
        gone = covered[base : base + len(starts)]
        base += len(starts)
        counts.append(np.diff(first))
        begins, stops = tk.runs(gone, first)
        at = np.searchsorted(begins, first)
        raw = data.tobytes()
        dropped = tk.per_doc(gone, first)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            text = raw[off[d] : off[d + 1]]
            if dropped[d]:
                words = text.split()
                kept.append(b" ".join(w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g))
                mine = slice(at[d], at[d + 1])
                spans.append((np.stack([begins[mine], stops[mine]], 1).ravel() - a).tolist())
            else:
                kept.append(b" ".join(text.split()))
                spans.append([])
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": np.concatenate(counts) if counts else np.zeros(0, np.int64), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def without_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (start and end of each removed run, in words,
    flattened) and kept (the remaining words)."""
    kind = repeats.Kind(words, (words + 1) // 2, word_units, cut, partial(judge, words), repeats.HOT)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = store.block_table(rows, "passages", repeats.BLOCK_BYTES)
    return repeats.repeated(blocks, kind, finish, KEPT, candidates(blocks, words))


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op7 from the operator's output."""
    removed = F.expr("aggregate(spans, 0L, (t, s) -> s - t)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
