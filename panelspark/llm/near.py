"""MinHash near-dedup with odd sketches.

A document's MinHash samples are banded to find candidates and folded into a parity bitmap, its odd
sketch. The XOR of two sketches has about as many ones as the samples that differ, which estimates
high similarities precisely; candidates whose estimate lies four deviations below the threshold are
dropped, the others are confirmed on their full shingle sets.

Equal sets are one representative. In a first round each band's bucket gives the tree of its closest
pairs by sketch, and the closest few edges of each member are confirmed, so a group of copies joins
at once. What then still shares a bucket with another component is settled exactly: its shingles are
ordered by rarity, and two sets that link share a shingle among the first few of each, at places that
leave room for the overlap (prefix and positional bounds). Documents that meet on such a shingle are
held against each other by their sketches and by parity bitmaps of their whole sets, whose XOR has no
more ones than shingles differ. Those that pass name each other's components: rows outside the shingle's
largest ask it, and of two others the smaller one asks. A document that asks meets the sets of all
members, in blocks, and one link a block is told. A family of texts that are alike but below the
threshold is compared bit by bit where it meets, in the task of its shingle, and asks for next to
nothing (about what lies within 0.01 of the threshold, more for texts of over 5000 words, whose bitmaps
fill). No pairs are written for a group.

Documents stay in blocks in the shared folder; only the sets of candidates move. Two documents with
the least similarity linked miss every band with probability (1 - s**4)**24, 2e-8 at s = 0.85.

Edge cases: null and empty texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; repeated rows have equal sets and so one component; a null identifier never
names a component unless all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, store
from . import textkit as tk
from .components import components

BANDS, ROWS = 24, 4
SAMPLES = 256
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Bits of the parity bitmap of a whole set.
PARITY_WORDS = 32
PARITY_BITS = 64 * PARITY_WORDS
#: Members of a bucket or component that meet in one step.
BLOCK = 2048
#: Rows of a bucket from which it is handed over in parts.
PART = 1 << 16
#: Closest edges of a document that the first round confirms.
EDGES = 3
#: Documents with one shingle that are compared pair by pair at once.
FEW = 64
_SEEDS = tk.mix(np.arange(1, 2 * SAMPLES + 1, dtype=tk.U) * tk.U(0x9FB21C651E98DF25))
_XOR, _MULTIPLY = _SEEDS[:SAMPLES], _SEEDS[SAMPLES:] | tk.U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    units, first = tk.word_hashes(tk.LOWER[data], offsets)
    total = tk.prefix_sums(units)
    starts = tk.gram_starts(first, words)
    grams = tk.run_hash(total, starts, np.int64(words))
    cuts = np.searchsorted(starts, first)
    counts = np.diff(first)
    sets = []
    for d, n in enumerate(counts.tolist()):
        if n >= words:
            sets.append(np.unique(grams[cuts[d] : cuts[d + 1]]))
        else:
            sets.append(tk.run_hash(total, first[d : d + 1], np.int64(n)) if n else np.zeros(0, tk.U))
    return sets


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SAMPLES), tk.U)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MULTIPLY[k], heads)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of the samples."""
    rows = found[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=tk.U) * tk.U(0xD1342543DE82EF95), (len(found), BANDS)).copy()
    for r in range(ROWS):
        key = tk.mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """The parity bitmaps of the samples."""
    at = (tk.mix(found + np.arange(SAMPLES, dtype=tk.U)) % tk.U(SKETCH_BITS)).astype(np.int64)
    cells = (np.arange(len(found)) * SKETCH_BITS)[:, None] + at
    bits = np.bincount(cells.ravel(), minlength=len(found) * SKETCH_BITS) & 1
    return np.packbits(bits.reshape(len(found), -1).astype(np.uint8), axis=1)


def most_ones(similarity: float) -> int:
    """How many ones the XOR of two sketches may have before the pair is surely below `similarity`."""
    low = max(0.0, similarity - 4 * math.sqrt(similarity * (1 - similarity) / SAMPLES))
    differ = 2 * SAMPLES * (1 - low)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmaps of whole sets. Equal shingles cancel in their XOR and others only in pairs, so
    its ones are never more than the shingles that one of two sets has alone."""
    at = (tk.mix(np.concatenate(sets) ^ tk.U(0x8CB92BA72F3D8DD7)) % tk.U(PARITY_BITS)).astype(np.int64)
    cells = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * PARITY_BITS + at
    bits = np.bincount(cells, minlength=len(sets) * PARITY_BITS) & 1
    return np.packbits(bits.reshape(len(sets), -1).astype(np.uint8), axis=1)


def most_odd(total: np.ndarray, percent: int) -> np.ndarray:
    """How many ones the XOR of two parity bitmaps may have where sets of `total` shingles together are
    linked: as many as shingles may differ, or, where that many fill the bitmap, 4.5 deviations over
    what is expected."""
    differ = (100 - percent) * total // (100 + percent)
    odd = (1 - np.exp(-2 * differ / PARITY_BITS)) / 2
    return np.minimum(differ, np.ceil(PARITY_BITS * odd + 4.5 * np.sqrt(PARITY_BITS * odd * (1 - odd))))


SIGNED = "node long, block string, doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary"


def sign(folder: str, words: int):
    """A map stage over blocks: size, digest, bands and sketch of each document."""

    def stage(batches):
        for batch in batches:
            for block, number in zip(batch.column("block").to_pylist(), batch.column("block_no").to_pylist(), strict=True):
                rows = store.read_block(folder, block)
                ids = rows.column("doc_id").combine_chunks()
                for lo, hi, data, off in tk.each_chunk(rows.column("text")):
                    sets = shingle_sets(data, off, words)
                    sizes = np.array([len(s) for s in sets], np.int64)
                    full = np.flatnonzero(sizes)
                    digests = np.zeros((2, hi - lo), np.int64)
                    bands = np.zeros((hi - lo, BANDS), np.int64)
                    sketch = np.zeros((hi - lo, SKETCH_BITS // 8), np.uint8)
                    if len(full):
                        held = [sets[i] for i in full]
                        flat = np.concatenate(held)
                        heads = np.cumsum([0, *(len(s) for s in held[:-1])])
                        for k, salt in enumerate((0x51ED270B9F652295, 0xB492B66FBE98F273)):
                            digests[k, full] = np.add.reduceat(tk.mix(flat ^ tk.U(salt)), heads).view(np.int64)
                        found = samples(held)
                        bands[full], sketch[full] = band_keys(found), odd_sketches(found)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                    columns = {"node": (number << 32) + np.arange(lo, hi), "block": [block] * (hi - lo), "doc_id": ids[lo:hi], "n": sizes, "d1": digests[0], "d2": digests[1], "bands": lists, "sketch": pa.array([r.tobytes() for r in sketch], pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)

    return stage


def sets_of(folder: str, block: str, nodes: np.ndarray, words: int) -> list[np.ndarray]:
    """The shingle sets of documents of a block."""
    texts = store.read_block(folder, block).column("text").combine_chunks().take(pa.array(nodes & 0xFFFFFFFF))
    return [s for _, _, data, off in tk.each_chunk(texts) for s in shingle_sets(data, off, words)]


def send_sets(folder: str, words: int):
    """A group stage over the wanted documents of a block: their shingle sets."""

    def stage(table: pa.Table) -> pa.Table:
        nodes = np.sort(np.asarray(table.column("node")))
        bodies = [s.tobytes() for s in sets_of(folder, table.column("block")[0].as_py(), nodes, words)]
        return pa.table({"node": nodes, "body": pa.array(bodies, pa.binary())})

    return stage


def confirm(percent: int):
    """A map stage over pairs with their sets: the pairs that are linked."""

    def stage(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())})

    return stage


def by_key(batches, size: int = PART):
    """Batches of whole keys from batches that are sorted by key; a long key comes in parts that
    follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.asarray(table.column("key"))
            cut = int(np.searchsorted(keys == keys[-1], True))
            if not cut:
                cut = len(keys)
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
    if held and sum(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


class Rows:
    """Columns of some rows as arrays."""

    def __init__(self, table: pa.Table):
        self.key, self.node, self.n = (np.asarray(table.column(c)) for c in ("key", "node", "n"))
        sketch = table.column("sketch").combine_chunks()
        self.sketch = tk.flat(sketch)[0].view(np.uint64).reshape(len(table), SKETCH_WORDS)
        if "parity" in table.column_names:
            self.parity = tk.flat(table.column("parity").combine_chunks())[0].view(np.uint64).reshape(len(table), PARITY_WORDS)
        self.root = np.asarray(table.column("root")) if "root" in table.column_names else None
        self.size = np.asarray(table.column("size")) if "size" in table.column_names else None
        self.pos, self.index, self.main = (np.asarray(table.column(c)) if c in table.column_names else None for c in ("pos", "is_index", "is_main"))
        self.heads = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(table) else np.zeros(0, np.int64)


def ones(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, row by row."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def near_sizes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def closest_tree(n: np.ndarray, sketch: np.ndarray, percent: int, most: int) -> np.ndarray:
    """The pairs (from, to, differing bits) of a least spanning tree, of those that may link."""
    far = SKETCH_BITS + 1
    best, frm = np.full(len(n), far), np.zeros(len(n), np.int64)
    left = np.ones(len(n), bool)
    at, out = 0, []
    for _ in range(len(n) - 1):
        left[at] = False
        d = np.where(near_sizes(n, n[at], percent), ones(sketch, sketch[at]), far)
        closer = left & (d < best)
        best[closer], frm[closer] = d[closer], at
        at = int(np.argmin(np.where(left, best, far + 1)))
        if best[at] <= most:
            out.append((frm[at], at, best[at]))
    return np.array(out, np.int64).reshape(-1, 3)


def closest_pairs(percent: int):
    """A map stage over buckets sorted by key: (a, b, differing bits), the tree of each; b joins at a."""
    most = most_ones(percent / 100)

    def stage(batches):
        key, lead = None, None
        for table in by_key(batches):
            r = Rows(table)
            ends = np.append(r.heads[1:], len(r.key))
            two = r.heads[ends - r.heads == 2]
            apart = ones(r.sketch[two], r.sketch[two + 1])
            ok = near_sizes(r.n[two], r.n[two + 1], percent) & (apart <= most)
            out = [np.stack([r.node[two[ok]], r.node[two[ok] + 1], apart[ok]], 1)]
            for lo, hi in zip(r.heads, ends, strict=True):
                if r.key[lo] != key:
                    key, lead = r.key[lo], None
                if hi - lo == 2 and lead is None:
                    lead = (r.node[lo : lo + 1], r.n[lo : lo + 1], r.sketch[lo : lo + 1])
                    continue
                for at in range(lo, hi, BLOCK):
                    part = slice(at, min(hi, at + BLOCK))
                    node, n, sketch = r.node[part], r.n[part], r.sketch[part]
                    if lead is None:
                        lead = (node[:1], n[:1], sketch[:1])
                    else:
                        node, n, sketch = (np.concatenate(x) for x in zip(lead, (node, n, sketch), strict=True))
                    tree = closest_tree(n, sketch, percent, most)
                    out.append(np.stack([node[tree[:, 0]], node[tree[:, 1]], tree[:, 2]], 1))
            found = np.unique(np.concatenate(out), axis=0)
            found = found[found[:, 0] != found[:, 1]]
            yield pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1], "apart": found[:, 2]})

    return stage


def prefixes(sets: list[np.ndarray], rank: np.ndarray, nodes: np.ndarray, percent: int) -> dict[str, object]:
    """key, node, n, pos, is_index and parity (of the whole set) of the first shingles of each set, the rarest first (`rank` of the
    sets one after another, 0 for a shingle of one document alone). A set meets larger ones on its index
    prefix and smaller ones on the longer probing prefix."""
    size = np.array([len(x) for x in sets], np.int64)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((flat, rank, doc))
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    least = -(-percent * size // 100)
    probe = size + 1 + (-percent * (size + least) // (100 + percent))
    index = size + 1 + (-2 * percent * size // (100 + percent))
    keep = (pos < probe[doc]) & (rank[order] > 0)
    doc, pos = doc[keep], pos[keep]
    odd = [x.tobytes() for x in parities(sets)]
    return {"key": flat[order][keep].view(np.int64), "node": nodes[doc], "n": size[doc], "pos": pos, "is_index": pos < index[doc], "parity": pa.array([odd[d] for d in doc], pa.binary())}


def may_link(r: Rows, i: np.ndarray, j: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Which rows i and j of one shingle, of different components, pass the bounds, the sketches and the
    parities of their whole sets."""
    n, m = np.broadcast_arrays(r.n[i], r.n[j])
    first = (n < m) | (n == m) & (r.node[i] < r.node[j])
    room = 1 + np.minimum(n - r.pos[i], m - r.pos[j]) - 1
    ok = (r.root[i] != r.root[j]) & np.where(first, r.index[i], r.index[j]) & near_sizes(n, m, percent) & (room * (100 + percent) >= percent * (n + m))
    ok[ok] = ones(r.sketch[i[ok]], r.sketch[j[ok]]) <= most
    ok[ok] = ones(r.parity[i[ok]], r.parity[j[ok]]) <= most_odd(n[ok] + m[ok], percent)
    return ok


def asks(r: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(node, root) for pairs of rows: the one outside the main component asks, else the smaller one."""
    mine = r.main[j] | ~r.main[i] & ((r.size[i] < r.size[j]) | (r.size[i] == r.size[j]) & (r.root[i] < r.root[j]))
    return np.stack([np.where(mine, r.node[i], r.node[j]), np.where(mine, r.root[j], r.root[i])], 1)


COLUMNS = ("key", "node", "n", "sketch", "parity", "root", "size", "pos", "is_index", "is_main")


def close_components(percent: int):
    """A map stage over shingles sorted by key, the main component of each last: (node, root), the other
    components of which a member may link with the node. Rows outside the main component are kept from
    part to part of a key, so all parts are compared."""
    most, size_of_part = most_ones(percent / 100), PART

    def stage(batches):
        key, held = None, None
        for table in by_key(batches, size_of_part):
            table = table.select(COLUMNS)
            fresh = len(table)
            goes_on = held is not None and len(held) and fresh and table.column("key")[0].as_py() == key
            if goes_on:
                table = pa.concat_tables([held, table]).combine_chunks()
            r = Rows(table)
            old = len(table) - fresh
            ends = np.append(r.heads[1:], len(r.key))
            small = np.repeat(ends - r.heads <= FEW, ends - r.heads)
            out = [np.zeros((0, 2), np.int64)]
            for d in range(1, FEW):
                i = np.flatnonzero(small[:-d] & (r.key[d:] == r.key[:-d]) & (np.arange(d, len(table)) >= old))
                if not len(i):
                    break
                i = i[may_link(r, i, i + d, percent, most)]
                out.append(asks(r, i, i + d))
            for lo, hi in zip(r.heads, ends, strict=True):
                if hi - lo <= FEW:
                    continue
                for q in lo + np.flatnonzero(~r.main[lo:hi]):
                    others = np.arange(max(q + 1, old) if q < old else q + 1, hi)
                    i = np.full(len(others), q)
                    ok = may_link(r, i, others, percent, most)
                    if ok.any():
                        out.append(np.unique(asks(r, i[ok], others[ok]), axis=0))
            if fresh:
                key = r.key[-1]
                held = table.filter(pa.array((r.key == key) & ~r.main))
            found = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_pydict({"node": found[:, 0], "root": found[:, 1]})

    return stage


def ask_counts(folder: str, words: int, buckets: int):
    """A group stage over documents of a block: the shingles of their sets, for how many have them."""

    def stage(table: pa.Table) -> pa.Table:
        name = table.column("block")[0].as_py()
        sets = sets_of(folder, name, np.sort(np.asarray(table.column("node"))), words)
        flat = np.concatenate(sets)
        return repeats.table_of(repeats.Groups(flat, np.arange(len(flat)), buckets).asks(name), repeats._ASK)

    return stage


def judge_counts(table: pa.Table) -> pa.Table:
    """A bucket of shingles: 0 for one document alone, else a rank that rises with their number."""
    keys, marks = repeats.joined(table, "keys", np.uint32), repeats.joined(table, "marks", np.uint8)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(np.ldexp(0.5, (marks[order] & 63).astype(np.int64)), np.flatnonzero(new))
    rank = np.where(total > 1, np.minimum(4 * np.log2(total), 255), 0).astype(np.uint8)
    flags = np.empty(len(keys), np.uint8)
    flags[order] = rank[np.cumsum(new) - 1]
    return repeats.answers(table, 1, flags, np.array([len(x.as_buffer()) for x in table.column("marks")]))


PREFIX = "key long, node long, n long, pos long, is_index boolean, parity binary"


def send_prefixes(folder: str, words: int, percent: int, buckets: int):
    """A stage over documents of a block and the ranks of their shingles: their prefixes."""

    def stage(wanted: pa.Table, ranks: pa.Table) -> pa.Table:
        if not len(wanted) or not len(ranks):
            return pa.table({"key": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "pos": pa.array([], pa.int64()), "is_index": pa.array([], pa.bool_()), "parity": pa.array([], pa.binary())})
        nodes = np.sort(np.asarray(wanted.column("node")))
        sets = sets_of(folder, wanted.column("block")[0].as_py(), nodes, words)
        flat = np.concatenate(sets)
        return pa.table(prefixes(sets, repeats.Groups(flat, np.arange(len(flat)), buckets).answered(repeats.told(ranks, 1)), nodes, percent))

    return stage


def meet(percent: int):
    """A map stage over blocks of components sorted by key, members first: the members' sets against
    those of the nodes that came close. One link a node and block."""

    def stage(batches):
        key, members = None, ([], [])
        for table in by_key(batches, 1 << 11):
            keys, node, member = (np.asarray(table.column(c)) for c in ("key", "node", "member"))
            sets = [np.frombuffer(x.as_buffer(), tk.U) for x in table.column("body")]
            a, b = [], []
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for lo, hi in zip(heads, np.append(heads[1:], len(keys)), strict=True):
                if keys[lo] != key:
                    key, members = keys[lo], ([], [])
                ours = np.flatnonzero(member[lo:hi]) + lo
                members[0].extend(node[ours])
                members[1].extend(sets[i] for i in ours)
                asked = np.flatnonzero(~member[lo:hi]) + lo
                if not len(asked) or not members[0]:
                    continue
                sizes = np.array([len(x) for x in members[1]])
                flat, starts = np.concatenate(members[1]), np.cumsum(sizes) - sizes
                for q in asked:
                    mine = sets[q]
                    both = np.add.reduceat((mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat).astype(np.int64), starts)
                    ok = np.flatnonzero(100 * both >= percent * (sizes + len(mine) - both))
                    if len(ok):
                        a.append(node[q])
                        b.append(members[0][ok[0]])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stage


class Near:
    """One run over a table; holds the scratch tables of its steps."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
        store.small_batches(docs.sparkSession)
        names = docs.columns
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(names) if c not in (doc_id, text)))
        self.names, self.doc_id, self.text = names, doc_id, text
        self.words, self.percent = words, percent
        self.blocks = store.block_table(rows, "near")
        self.folder = self.blocks.folder
        self.signed, _ = store.materialise(self.blocks.rows.mapInArrow(store.lean(sign(self.folder, words)), SIGNED), "signed")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node and body (shingle set) of the wanted nodes (node, block)."""
        parts = store.partitions(wanted.sparkSession)
        return wanted.repartition(parts, "block").groupBy("block").applyInArrow(store.lean_group(send_sets(self.folder, self.words)), "node long, body binary")

    def linked(self, pairs: DataFrame, where: DataFrame) -> DataFrame:
        """The pairs (a, b) that their full sets confirm, as a table (a, b, ok)."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(where, "node")
        sets = self.sets(wanted)
        left = pairs.join(sets.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
        whole = left.join(sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
        return store.materialise(whole.select("a", "b", "body_a", "body_b").mapInArrow(store.lean(confirm(self.percent)), "a long, b long, ok boolean"), "linked")[0]

    def classes(self) -> DataFrame:
        """d1, d2, n, top (the node that stands for the component) and component_id of every distinct
        non-empty set."""
        parts = store.partitions(self.signed.sparkSession)
        heads = self.signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"))
        reps, _ = store.materialise(heads.join(self.signed.select("node", "block", "bands", "sketch"), "node"), "reps")
        keys = reps.select("node", F.explode("bands").alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
        buckets, _ = store.materialise(keys.join(shared, "key"), "buckets")
        brief, where = reps.select("node", "n", "sketch"), reps.select("node", "block")
        near = buckets.join(brief, "node").repartition(parts, "key").sortWithinPartitions("key", "node")
        edges = near.mapInArrow(store.lean(closest_pairs(self.percent)), "a long, b long, apart long").groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "a"))), 1, EDGES).alias("near"))
        pairs = edges.select("b", F.explode("near").alias("x")).select(F.least("b", "x.a").alias("a"), F.greatest("b", "x.a").alias("b")).distinct()
        first, _ = store.materialise(pairs, "pairs")
        roots = components(self.linked(first, where).where("ok").select("a", "b"))
        late = self.second(buckets, brief, where, roots)
        over = late.alias("l").join(roots.alias("x"), F.col("l.a") == F.col("x.node"), "left").join(roots.alias("y"), F.col("l.b") == F.col("y.node"), "left")
        over = over.select(F.coalesce("x.root", "l.a").alias("a"), F.coalesce("y.root", "l.b").alias("b"))
        tops = components(over).select(F.col("node").alias("mid"), F.col("root").alias("top"))
        named = reps.select("node", "d1", "d2", "n", "least_id").join(roots, "node", "left").withColumn("mid", F.coalesce("root", "node")).join(tops, "mid", "left").withColumn("top", F.coalesce("top", "mid"))
        least = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
        return named.join(least, "top").select("d1", "d2", "n", "top", "component_id")

    def second(self, buckets: DataFrame, brief: DataFrame, where: DataFrame, roots: DataFrame) -> DataFrame:
        """The links (a, b) between components that still share a bucket."""
        parts = store.partitions(buckets.sparkSession)
        held = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = held.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
        left, _ = store.materialise(held.join(mixed, "key").select("node").distinct().join(where, "node").select("node", "block"), "open")
        sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
        met = self.meeting(left).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counted = met.groupBy("key", "root").agg(F.count("*").alias("here"), F.max("is_index").alias("index"))
        open_keys = counted.groupBy("key").agg(F.max_by("root", F.struct("here", "root")).alias("main"), F.count("*").alias("roots"), F.max("index").alias("index")).where("roots > 1 and index").select("key", "main")
        rows = met.join(open_keys, "key").join(sizes, "root", "left").join(brief.select("node", "sketch"), "node").select("key", "node", "n", "sketch", "root", F.coalesce("size", F.lit(1)).cast("long").alias("size"), "pos", "is_index", "parity", (F.col("root") == F.col("main")).alias("is_main"))
        asked, _ = store.materialise(rows.repartition(parts, "key").sortWithinPartitions("key", "is_main").mapInArrow(store.lean(close_components(self.percent)), "node long, root long").distinct(), "asked")
        wide = asked.select("root").distinct().join(sizes, "root", "left").select("root", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("long").alias("blocks"))
        all_roots = brief.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        members = all_roots.join(wide, "root").select("root", F.pmod(F.xxhash64("node"), "blocks").alias("part"), "node", F.lit(True).alias("member"))
        queries = asked.join(wide, "root").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), "node", F.lit(False).alias("member"))
        both = members.union(queries)
        sets = self.sets(both.select("node").distinct().join(where, "node"))
        keyed = both.join(sets, "node").select(F.xxhash64("root", "part").alias("key"), "node", "member", "body")
        dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", F.desc("member"))
        return store.materialise(dealt.mapInArrow(store.lean(meet(self.percent)), "a long, b long"), "late")[0]

    def meeting(self, left: DataFrame) -> DataFrame:
        """The first shingles (PREFIX) of the documents left(node, block), by rarity among them."""
        spark = left.sparkSession
        buckets, tasks = repeats.buckets_for(spark, self.blocks.size), max(store.partitions(spark), min(self.blocks.count, 20_000))
        dealt = left.repartition(tasks, "block")
        counts = dealt.groupBy("block").applyInArrow(store.lean_group(ask_counts(self.folder, self.words, buckets)), repeats.ASK)
        ranks = counts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(store.lean_group(judge_counts), repeats.ANSWER)
        stage = store.lean_cogroup(send_prefixes(self.folder, self.words, self.percent, buckets))
        return store.materialise(dealt.groupBy("block").cogroup(ranks.repartition(tasks, "block").groupBy("block")).applyInArrow(stage, PREFIX), "prefixes")[0]

    def labelled(self) -> DataFrame:
        """node, block, top, doc_id, n_shingles, component_id and kept of every row; without shingles a
        row is its own top."""
        found = self.signed.select("node", "block", "doc_id", "n", "d1", "d2").join(self.classes(), ["d1", "d2", "n"], "left")
        named = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return found.select("node", "block", F.coalesce("top", "node").alias("top"), "doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least identifier of the documents reachable
    over links of at least `percent` similarity) and kept (it names its component)."""
    return Near(docs, doc_id, text, words, percent).labelled().drop("node", "block", "top")


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op3 from the operator's output."""
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def take_rows(folder: str, names: list[str], doc_id: str, text: str, schema: pa.Schema):
    """A group stage over the chosen rows of a block: those rows with all columns."""

    def stage(table: pa.Table) -> pa.Table:
        rows = store.read_block(folder, table.column("block")[0].as_py())
        rows = rows.take(pa.array(np.sort(np.asarray(table.column("node")) & 0xFFFFFFFF)))
        source = {doc_id: "doc_id", text: "text"}
        return pa.table([rows.column(source.get(c, f"keep_{i}")) for i, c in enumerate(names)], names=names).cast(schema)

    return stage


def unique(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with all columns: of the rows that name it, the first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    run = Near(docs, doc_id, text, words, percent)
    kept = run.labelled().where("kept").groupBy("top").agg(F.min_by("block", "node").alias("block"), F.min("node").alias("node"))
    return kept.select("block", "node").groupBy("block").applyInArrow(store.lean_group(take_rows(run.folder, docs.columns, doc_id, text, to_arrow_schema(docs.schema))), docs.schema)
