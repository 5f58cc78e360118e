"""Exchanges between blocks of whole documents and buckets of hashes, and the text that windows share.

A window is `window` units (bytes or words) of one document. Of the runs of `gram` units in a window
the least by hash is its anchor, so equal windows have equal anchors. An anchor stands for all
consecutive windows that share it; their text is its stretch.

First the hashes of the anchors meet: an anchor of one document alone ends there. Then the texts of
the stretches whose anchor is shared meet in the anchor's bucket, where the operator judges every
window on the text itself. Equal stretches of a block, compared byte by byte, go there once, for the
least identifier; so a passage in a third of all documents is one text a block. An anchor with very
many stretches is split: its windows go alone, each to the bucket of its own hash.

Hashes only decide what meets; a collision sends a text in vain. Documents stay in blocks in the
shared folder. A block sends a bucket one packed row; no pair of documents is ever listed. Buckets
grow in number with the bytes of the table, and a bucket is judged in parts of whole anchors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import textkit as tk

#: Stands for a null identifier, the smallest.
NO_ID = -(1 << 63)
#: Bytes of documents in a block and for each bucket, and bytes of text that are judged at a time.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 8 << 20, 16 << 20, 2 << 20
#: Occurrences from which an anchor's windows go alone.
HOT = 1 << 15
#: Bits of a place in a text; the others of a hash order the runs in a window.
PLACE_BITS = 28


@dataclass(frozen=True)
class Kind:
    """What units are, and how their texts are sent and judged."""

    window: int
    gram: int
    units: Callable  # (bytes, offsets) -> (unit hashes, first unit of each document)
    cut: Callable  # (bytes, offsets, lo, hi) -> the texts of unit ranges in one array, and their lengths
    judge: Callable  # (texts in one array, lengths, windows of each text, identifiers) -> flag of each window
    hot: int


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def buckets_for(spark: SparkSession, size: int) -> int:
    """How many buckets a table of `size` bytes gets."""
    return max(store.partitions(spark), -(-size // BUCKET_BYTES))


def identifiers(rows: pa.Table) -> np.ndarray:
    return np.asarray(rows.column("doc_id").combine_chunks().fill_null(NO_ID)).astype(np.int64)


class Groups:
    """Hashes of a block by bucket and key: what it asks, and how answers come back to each hash."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, buckets: int):
        full = tk.mix(hashes)
        place = (full >> tk.U(34)) % tk.U(buckets) << tk.U(32) | full & tk.U(0xFFFFFFFF)
        self.order = np.argsort(place)
        place = place[self.order]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.key, self.bucket = place[heads].astype(np.uint32), (place[heads] >> tk.U(32)).astype(np.int64)
        if len(heads):
            owner = ids[self.order]
            several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
            counts = np.frexp(np.diff(np.append(heads, len(place))).astype(np.float64))[1]
            self.mark = (np.minimum(counts, 63) | several << 7).astype(np.uint8)

    def asks(self, name: str) -> list[tuple]:
        """(block, bucket, keys, marks): a mark is the bit length of a count, and whether the hash is in
        documents of several identifiers."""
        if not len(self.key):
            return []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.key)]])
        return [(name, int(self.bucket[a]), self.key[a:b].tobytes(), self.mark[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def answered(self, found: bytes) -> np.ndarray:
        """The answer for each hash."""
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = np.frombuffer(found, np.uint8)[self.group]
        return out


ASK = "block string, bucket int, keys binary, marks binary"
_ASK = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary())])
SENT = "block string, bucket int, keys binary, body binary, sizes binary, windows binary, ids binary"
_SENT = pa.schema([("block", pa.string()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "body", "sizes", "windows", "ids"))])
#: What a block knows: level 0 which windows are in question (null: all), level 1 and 2 the answers.
ANSWER = "block string, bucket int, level int, flags binary"
_ANSWER = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("level", pa.int32()), ("flags", pa.binary())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers of a binary column, row after row."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def answers(table: pa.Table, level: int, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    cuts = np.cumsum(sizes)
    parts = [flags[a:b].tobytes() for a, b in zip(cuts - sizes, cuts, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "level": pa.array([level] * len(parts), pa.int32()), "flags": pa.array(parts, pa.binary())}, schema=_ANSWER)


def told(table: pa.Table, level: int) -> bytes:
    """The answers of a level to a block, in the order in which it asked."""
    rows = sorted(((r["bucket"], r["flags"]) for r in table.to_pylist() if r["level"] == level), key=lambda r: r[0])
    return b"".join(f for _, f in rows)


def in_question(table: pa.Table) -> bytes | None:
    return next((r["flags"] for r in table.to_pylist() if r["level"] == 0), None)


def judge_groups(hot: int):
    """A bucket of hashes: 0 in one document alone, 1 in several, 2 in several and very often."""

    def stage(table: pa.Table) -> pa.Table:
        keys, marks = joined(table, "keys", np.uint32), joined(table, "marks", np.uint8)
        order = np.argsort(keys)
        k, m = keys[order], marks[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        heads = np.flatnonzero(new)
        shared = (np.diff(np.append(heads, len(k))) > 1) | np.bitwise_or.reduceat(m >> 7, heads).astype(bool)
        often = np.add.reduceat(np.ldexp(0.5, (m & 63).astype(np.int64)), heads) >= hot
        flags = np.empty(len(k), np.uint8)
        flags[order] = np.where(shared, 1 + often, 0)[np.cumsum(new) - 1]
        return answers(table, 1, flags, np.array([len(x.as_buffer()) for x in table.column("marks")]))

    return stage


def meet_groups(asks: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """The answers (ANSWER) to the asked hashes (ASK)."""
    return asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(store.lean_group(judge_groups(hot)), ANSWER)


def chosen_at(chosen: bytes | None, base: int, n: int) -> np.ndarray:
    """Which of the n units from `base` start a window in question."""
    if chosen is None:
        return np.ones(n, bool)
    bits = np.frombuffer(chosen, np.uint8)
    found = np.unpackbits(bits[base // 8 : -(-(base + n) // 8)])[base % 8 : base % 8 + n].astype(bool)
    return np.concatenate([found, np.zeros(n - len(found), bool)])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of each run of `width` values, by their upper bits: a value and its
    place are one number. Places beyond those bits, in very long texts, are carried beside it."""
    best, span = values >> tk.U(PLACE_BITS) << tk.U(PLACE_BITS), 1
    if len(values) >> PLACE_BITS:
        at = np.arange(len(values))
        while span < width:
            step = min(span, width - span)
            right = best[step:] < best[:-step]
            best, at, span = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step]), span + step
        return at
    best |= np.arange(len(values), dtype=tk.U)
    while span < width:
        step = min(span, width - span)
        best, span = np.minimum(best[:-step], best[step:]), span + step
    return (best & tk.U((1 << PLACE_BITS) - 1)).astype(np.int64)


def anchors(units: np.ndarray, first: np.ndarray, kind: Kind, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last of the windows in question that it stands for."""
    starts = tk.gram_starts(first, kind.window)
    starts = starts[chosen[starts]]
    if not len(starts):
        return np.zeros(0, tk.U), starts, starts
    hashes = tk.gram_hashes(units, kind.gram)
    place = sliding_least(hashes, kind.window - kind.gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    return hashes[place[new]], starts[new], starts[last]


class Block:
    """The anchors of a block, with positions counted over the whole block."""

    def __init__(self, rows: pa.Table, kind: Kind, buckets: int, chosen: bytes | None):
        self.ids, self.text, self.kind, self.buckets = identifiers(rows), rows.column("text").combine_chunks(), kind, buckets
        parts, self.bases, base = [], [], 0
        for lo, _, data, off in tk.each_chunk(self.text):
            units, first = kind.units(data, off)
            hashes, a, b = anchors(units, first, kind, chosen_at(chosen, base, int(first[-1])))
            parts.append((hashes, a + base, b + base, tk.owner(first, a) + lo))
            self.bases.append(base)
            base += int(first[-1])
        self.units = base
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (tk.U, np.int64, np.int64, np.int64)]
        self.hash, self.lo, self.hi, self.row = columns
        self.groups = Groups(self.hash, self.ids[self.row], buckets)


def same_text(body: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the texts of equal size at a and at b agree, byte by byte."""
    out = np.ones(len(a), bool)
    for lo, hi in tk.chunks(np.concatenate([[0], np.cumsum(sizes)])):
        n = sizes[lo:hi]
        differ = body[spread(a[lo:hi], n)] != body[spread(b[lo:hi], n)]
        out[lo + np.repeat(np.arange(hi - lo), n)[differ]] = False
    return out


def heads(hashes: np.ndarray, ids: np.ndarray, body: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text an equal one with the least identifier: by hash, and then by its bytes."""
    order = np.lexsort((ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    mine = np.arange(len(head))
    head = np.where(sizes[head] == sizes, head, mine)
    other = np.flatnonzero(head != mine)
    wrong = other[~same_text(body, start[other], start[head[other]], sizes[other])]
    head[wrong] = wrong
    return head


class Stretches:
    """The stretches of a block whose anchors are shared, and which of them go to the buckets."""

    def __init__(self, b: Block, flags: np.ndarray):
        whole, alone = np.flatnonzero(flags == 1), np.flatnonzero(flags == 2)
        each = b.hi[alone] - b.lo[alone] + 1
        single = spread(b.lo[alone], each)
        lo = np.concatenate([b.lo[whole], single])
        order = np.argsort(lo, kind="stable")
        self.lo, self.windows = lo[order], np.concatenate([b.hi[whole] - b.lo[whole] + 1, np.ones(len(single), np.int64)])[order]
        self.ids = b.ids[np.concatenate([b.row[whole], np.repeat(b.row[alone], each)])[order]]
        go = np.concatenate([b.hash[whole], np.zeros(len(single), tk.U)])[order]
        own = np.zeros(len(lo), bool)
        own[len(whole) :] = True
        own = own[order]
        cuts = np.searchsorted(self.lo, [*b.bases, b.units + 1])
        bodies, sizes, hashes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, tk.U)]
        for (_, _, data, off), base, start, end in zip(tk.each_chunk(b.text), b.bases, cuts[:-1], cuts[1:], strict=True):
            if end > start:
                at, n = self.lo[start:end] - base, self.windows[start:end] + b.kind.window - 1
                body, size = b.kind.cut(data, off, at, at + n)
                bodies.append(body)
                sizes.append(size)
                hashes.append(tk.run_hash(tk.prefix_sums(b.kind.units(data, off)[0]), at, n))
        self.body, self.sizes, text = np.concatenate(bodies), np.concatenate(sizes), np.concatenate(hashes)
        self.start = np.cumsum(self.sizes) - self.sizes
        full = tk.mix(np.where(own, text, go))
        self.key, self.bucket = full.astype(np.uint32), ((full >> tk.U(34)) % tk.U(b.buckets)).astype(np.int64)
        self.head = heads(text, self.ids, self.body, self.start, self.sizes)
        sent = np.flatnonzero(self.head == np.arange(len(self.head)))
        self.sent = sent[np.argsort(self.bucket[sent] << 32 | self.key[sent], kind="stable")]

    def rows(self, name: str) -> list[tuple]:
        """What the block sends to each bucket."""
        b = self.bucket[self.sent]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
        out = []
        for part in (self.sent[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)):
            n = self.sizes[part]
            out.append((name, int(self.bucket[part[0]]), self.key[part].tobytes(), self.body[spread(self.start[part], n)].tobytes(), n.astype(np.uint32).tobytes(), self.windows[part].astype(np.uint32).tobytes(), self.ids[part].tobytes()))
        return out

    def state(self, units: int) -> bytes:
        """What the block keeps in mind: which windows repeat already, and for each other stretch where its
        windows are in the answers."""
        later = self.ids > self.ids[self.head]
        known = np.zeros(units, bool)
        known[spread(self.lo[later], self.windows[later])] = True
        at = np.zeros(len(self.lo), np.int64)
        n = self.windows[self.sent]
        at[self.sent] = np.cumsum(n) - n
        rest = np.flatnonzero(~later)
        columns = (self.lo[rest], self.windows[rest], at[self.head[rest]])
        return b"".join([len(rest).to_bytes(8, "little"), *(c.astype("<u4").tobytes() for c in columns), np.packbits(known).tobytes()])


def repeats_at(state: bytes, found: bytes, units: int) -> np.ndarray:
    """Starts of the windows that repeat, by a block's state and the answers for what it sent."""
    n = int.from_bytes(state[:8], "little")
    lo, windows, at = np.frombuffer(state, "<u4", 3 * n, 8).reshape(3, n).astype(np.int64)
    known = np.unpackbits(np.frombuffer(state, np.uint8, offset=8 + 12 * n), count=units).astype(bool)
    said = np.frombuffer(found, np.uint8).astype(bool)
    known[spread(lo, windows)[said[spread(at, windows)]]] = True
    return np.flatnonzero(known)


def send_anchors(folder: str, kind: Kind, buckets: int):
    """A map stage over (block, flags): the hashes of the anchors."""

    def stage(batches):
        for batch in batches:
            for name, chosen in zip(batch.column("block").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                b = Block(store.read_block(folder, name), kind, buckets, chosen)
                yield from table_of(b.groups.asks(name), _ASK).to_batches()

    return stage


def send_stretches(folder: str, kind: Kind, buckets: int):
    """A group stage over what a block was told of its anchors: the texts of the shared ones."""

    def stage(table: pa.Table) -> pa.Table:
        name, known = table.column("block")[0].as_py(), told(table, 1)
        if not known:
            return table_of([], _SENT)
        b = Block(store.read_block(folder, name), kind, buckets, in_question(table))
        found = Stretches(b, b.groups.answered(known))
        return table_of([*found.rows(name), (name, zlib.crc32(name.encode()) % buckets, None, found.state(b.units), None, None, None)], _SENT)

    return stage


def parts_of(keys: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Places of items by key, in parts of whole keys of about `limit` bytes."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1
    total = np.cumsum(sizes[order])[ends - 1]
    lo = begun = 0
    for end, upto in zip(ends.tolist(), total.tolist(), strict=True):
        if upto - begun >= limit or end == len(order):
            yield order[lo:end]
            lo, begun = end, upto


def judge_stretches(kind: Kind, limit: int = PART_BYTES):
    """A bucket of texts: a flag for each window. Equal texts are judged once, for the least identifier.
    The states of blocks pass through."""

    def judged(table: pa.Table) -> pa.Table:
        keys, ids, body = joined(table, "keys", np.uint32), joined(table, "ids", np.int64), joined(table, "body", np.uint8)
        sizes, windows = (joined(table, c, np.uint32).astype(np.int64) for c in ("sizes", "windows"))
        rows = np.array([len(x.as_buffer()) // 4 for x in table.column("keys")])
        start, at = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
        flags = np.zeros(int(windows.sum()), np.uint8)
        for part in parts_of(keys, sizes, limit):
            n, w, who = sizes[part], windows[part], ids[part]
            text, lo, upto = body[spread(start[part], n)], np.cumsum(n) - n, np.cumsum(w)
            head = heads(tk.span_hash(text, lo, lo + n), who, text, lo, n)
            one = np.flatnonzero(head == np.arange(len(head)))
            said = np.zeros(upto[-1], bool)
            said[spread((upto - w)[one], w[one])] = kind.judge(text[spread(lo[one], n[one])], n[one], w[one], who[one])
            flags[spread(at[part], w)] = said[spread((upto - w)[head], w)] | np.repeat(who > who[head], w)
        return answers(table, 2, flags, np.add.reduceat(windows, np.cumsum(rows) - rows))

    def stage(table: pa.Table) -> pa.Table:
        states = pc.is_null(table.column("keys"))
        kept, sent = table.filter(states), table.filter(pc.invert(states))
        passed = table_of([(r["block"], r["bucket"], 3, r["body"]) for r in kept.select(["block", "bucket", "body"]).to_pylist()], _ANSWER)
        return pa.concat_tables([passed, judged(sent)]) if len(sent) else passed

    return stage


def repeated(blocks: store.Blocks, kind: Kind, finish: Callable, schema: str, chosen: DataFrame | None = None) -> DataFrame:
    """Gives each block, with the units that repeated windows cover, to finish(rows of the block,
    covered) -> table. `chosen` (ANSWER, level 0) says which windows of a block are in question."""
    spark, folder = blocks.rows.sparkSession, blocks.folder
    buckets = buckets_for(spark, blocks.size)
    every = blocks.rows.select("block", F.lit(0).alias("bucket"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("flags")) if chosen is None else chosen
    asks = every.select("block", "flags").mapInArrow(store.lean(send_anchors(folder, kind, buckets)), ASK)
    level1, _ = store.materialise(meet_groups(asks, buckets, kind.hot), "level1")
    tasks = max(store.partitions(spark), min(blocks.count, 20_000))
    sent = every.union(level1).repartition(tasks, "block").groupBy("block").applyInArrow(store.lean_group(send_stretches(folder, kind, buckets)), SENT)
    level2 = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(store.lean_group(judge_stretches(kind)), ANSWER)

    def end(table: pa.Table) -> pa.Table:
        rows = store.read_block(folder, table.column("block")[0].as_py())
        units = sum(int(kind.units(data, off)[1][-1]) for _, _, data, off in tk.each_chunk(rows.column("text")))
        state = told(table, 3)
        return finish(rows, tk.covered(units, repeats_at(state, told(table, 2), units) if state else np.zeros(0, np.int64), kind.window))

    return every.union(level2).repartition(tasks, "block").groupBy("block").applyInArrow(store.lean_group(end), schema)
