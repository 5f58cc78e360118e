"""Token ids in binary shard files: frequency-ranked ids, byte-aligned variable-length coding with
separate control bytes, decoded by numpy table lookup.

Documents are range-partitioned and sorted by identifier, tokenised once and written as shards of a
bounded number of ids. Every shard ranks its own ids by how often they occur and holds the table, so
one pass suffices, files decode alone, and a lost task writes the same file again. An id is stored
as its rank in 1 to 4 bytes; two bits of a control byte give the length, four ids a control byte.

Tokenising: a text is cut where the tokenizer's pre-tokenizer always cuts (a lone space or newline
between characters that are not white space, a letter before ASCII punctuation); each distinct piece
is encoded by the tokenizers library once a task and its ids are looked up by hash from then on. A
text with the string of a special token is encoded whole, and so is every text where the tokenizer has
another pre-tokenizer than the byte-level one, or a normalizer.

Edge cases: null and empty texts have the end id alone; a null identifier sorts first; repeated rows
are separate documents, those of one identifier in the order of a text hash; an empty table gives an
empty folder of shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textkit as tk

MAGIC = b"PSIDS1\0\0"
HEAD = struct.Struct("<8sqqqqq")
SHARD_IDS = 2 << 20
CACHE_UNITS = 1 << 20
PIECE_BYTES = (1 << 20) - 64
PACK_IDS = 1 << 19

_ASCII = np.zeros(256, bool)
_ASCII[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = _ASCII & ~_LETTER
_PUNCT[48:58] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that tokenise alone; every document starts one.

    0xC3 leads the Latin-1 letters, none of which is white space or splits from its neighbours."""
    n = len(data)
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True
    if n > 2:
        before = _ASCII[data]
        before[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        after = _ASCII[data] | (data == 0xC3)
        lone = np.zeros(n, bool)
        lone[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & before[:-2] & after[2:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        lone[edge] = False
        lone[edge - 1] = False
        cuts[:-1] |= lone
        cuts[1:] |= lone & (data == 10)
        cuts[1:-1] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    return np.flatnonzero(cuts[:n])


class Encoder:
    """A tokenizer with a table of the ids of the pieces seen so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plan = json.loads(self.tokenizer.to_str())
        before = plan.get("pre_tokenizer") or {}
        self.cuts = plan.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, tk.U)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_distinct(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; those of one word are encoded a hundred at a time, between newlines."""
        out: list[list[int] | None] = [None] * len(texts)
        joined = []
        for i, t in enumerate(texts):
            w = t[1:] if t[0] == " " else t
            if w.split() == [w] and len(self.newline) == 1:
                joined.append(i)
        groups = [joined[i : i + 100] for i in range(0, len(joined), 100)]
        end = self.newline[0] if self.newline else -1
        for group, ids in zip(groups, self.plain(["\n".join(texts[i] for i in g) for g in groups]), strict=True):
            lo, k = 0, 0
            for at, x in enumerate(ids):
                if x == end:
                    out[group[k]] = ids[lo:at]
                    lo, k = at + 1, k + 1
            out[group[k]] = ids[lo:]
            if k != len(group) - 1:
                raise ValueError("pieces and newlines do not match")
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def add(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self.encode_distinct(texts)
        sizes = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, sizes)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a chunk, one after another, and how many each has."""
        raw = data.tobytes()
        if not self.cuts or any(s in raw for s in self.special):
            parts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if len(parts) == 1:
                ids = self.plain([raw.decode()])[0]
                return np.array(ids, np.uint32), np.array([len(ids)])
            both = [self.encode(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in parts]
            return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
        starts = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = tk.span_hash(data, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        keys, sample = ranked[new], order[new]
        if len(self.keys) + len(keys) > CACHE_UNITS:
            self.reset()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        if not known.all():
            lost = ~known
            self.add(keys[lost], [raw[a:b].decode() for a, b in zip(starts[sample[lost]].tolist(), ends[sample[lost]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        size = self.size[place][group]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[place][group] - (total - size), size) + np.arange(total[-1])]
        per = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(per)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The task's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the ranks."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = extra
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    at = ends - extra - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = extra >= k
        if k and not has.any():
            break
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks: lengths by a table over control bytes, then one pass a byte."""
    sizes = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    at = ends - sizes
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    value = padded[at].astype(np.uint32)
    for k in range(1, int(sizes.max()) if n else 0):
        more = np.flatnonzero(sizes > k)
        value[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file."""
    counts = np.bincount(ids, minlength=1)
    seen = np.flatnonzero(counts)
    table = seen[np.argsort(-counts[seen], kind="stable")].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    parts = [pack(rank[ids[i : i + PACK_IDS]]) for i in range(0, len(ids), PACK_IDS)]
    control, data = (b"".join(p[k].tobytes() for p in parts) for k in (0, 1))
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool)) if doc_ids else np.zeros(0, np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(table), len(control), len(data))
    return b"".join((head, table.tobytes(), keys.tobytes(), nulls.tobytes(), sizes.astype("<u4").tobytes(), control, data))


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Identifiers, sizes and ids of a shard file."""
    magic, docs, n, table, control, data = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    names, keys = take("<u4", table), take("<i8", docs)
    nulls = np.unpackbits(take(np.uint8, (docs + 7) // 8), count=docs).astype(bool)
    sizes = take("<u4", docs).astype(np.int64)
    ranks = unpack(take(np.uint8, control), take(np.uint8, data), n)
    return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], sizes, names[ranks]


def write_file(folder: str, name: str, raw: bytes) -> None:
    """Writes a file under a name of the attempt, then moves it, so that a retried task is safe."""
    fs, root = store.opened(folder)
    fs.create_dir(root, recursive=True)
    context = TaskContext.get()
    own = f"{root}/_{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(own) as out:
        out.write(raw)
    fs.move(own, f"{root}/{name}")


def read_file(folder: str, name: str) -> bytes:
    fs, root = store.opened(folder)
    with fs.open_input_stream(f"{root}/{name}") as file:
        return file.read()


def writer(folder: str, vocabulary: str, end_id: int, shard_ids: int):
    """A map stage over sorted partitions: writes the shards of a partition."""

    def stage(batches):
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        enc = encoder(vocabulary)
        keys: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, shard = 0, 0

        def flush():
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            name = f"shard-{part:06d}-{shard:06d}.ids"
            write_file(folder, name, shard_bytes(keys, n, np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "name": [name], "n_docs": [len(keys)], "n_ids": [int(n.sum())]})

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, off in tk.each_chunk(batch.column(1), min(PIECE_BYTES, shard_ids)):
                found, n = enc.encode(data, off)
                out = np.full(len(found) + len(n), end_id, np.uint32)
                inner = np.ones(len(out), bool)
                inner[np.cumsum(n + 1) - 1] = False
                out[inner] = found
                keys += names[lo:hi]
                sizes.append(n + 1)
                ids.append(out)
                held += len(out)
                if held >= shard_ids:
                    yield flush()
                    keys, sizes, ids, held, shard = [], [], [], 0, shard + 1
        if keys:
            yield flush()
        # An idle worker would keep the vocabulary while other stages need the memory.
        _encoders.clear()

    return stage


def write_ids(docs: DataFrame, folder: str, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS, order: Sequence[Column] = ()) -> DataFrame:
    """Writes the shards; returns their index, a table of part, shard, name, n_docs, n_ids and base (the
    ids before the shard), in ascending order of identifiers, or of the columns `order` of docs where
    these are given. Bases are summed by part, so neither the driver nor one task lists all shards."""
    store.small_batches(docs.sparkSession)
    places = [f"place_{i}" for i in range(len(order))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(c.alias(p) for c, p in zip(order, places, strict=True)))
    by_id = F.col("doc_id").asc_nulls_first()
    spread = rows.repartitionByRange(store.partitions(docs.sparkSession), *(places or [by_id]))
    dealt = spread.sortWithinPartitions(*(places or [by_id, F.xxhash64("text")])).select("doc_id", "text")
    done, _ = store.materialise(dealt.mapInArrow(store.lean(writer(folder, vocabulary, end_id, shard_ids)), "part long, shard long, name string, n_docs long, n_ids long"), "shards")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = done.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before(Window.orderBy("part")).alias("part_base"))
    inside = done.withColumn("n", F.col("n_ids")).withColumn("inner", before(Window.partitionBy("part").orderBy("shard")))
    return inside.join(parts, "part").select("part", "shard", "name", "n_docs", "n_ids", (F.col("part_base") + F.col("inner")).alias("base"))


def reader(folder: str):
    """A map stage over (name, base): identifier, start, size and checksum of each document."""

    def stage(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                keys, sizes, ids = read_shard(read_file(folder, name))
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": base + ends - sizes, "n_tokens": sizes, "ids_crc32": pa.array(sums, pa.int64())})

    return stage


def read_ids(spark, folder: str, index: DataFrame) -> DataFrame:
    """Per document, read from the shards: doc_id, start, n_tokens and ids_crc32."""
    files = index.select("name", "base").repartition(4 * store.partitions(spark))
    return files.mapInArrow(store.lean(reader(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
