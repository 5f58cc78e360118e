"""Exact dedup: compressed radix tries own partitions of (length, content hash).

Each task first merges its own copies, so a text that fills a third of the rows crosses the network
once a task. Representatives are dealt by length and content hash; the owner of a partition inserts
their full byte strings into a Patricia trie, whose terminals hold the least and greatest identifier
and the number of rows. A trie that outgrows its memory spills its heaviest subtree to a local file
of its own, which is read into a trie of its own once the others are done.

Edge cases: null counts as empty text, and empty texts are copies of each other; a null identifier
never wins; of rows that tie in text and identifier each is kept; an empty table gives no rows; other
columns are ignored. Two texts with the same length and SHA-256 stop the job rather than merge.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

TRIE_BYTES = 96 << 20
MERGE_BYTES = 16 << 20
_HEAD = struct.Struct("<iqqqB")
_NODE_BYTES = 200


class Node:
    __slots__ = ("edge", "below", "end", "file")

    def __init__(self, edge: bytes):
        self.edge, self.below, self.end, self.file = edge, None, None, None


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def most(a, b):
    return b if a is None else a if b is None else max(a, b)


class RadixTrie:
    """Byte strings to (sha256, least id, greatest id, rows)."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.size, self.spilled = Node(b""), limit, 0, []

    def insert(self, key: bytes, sha: bytes, lo: int | None, hi: int | None, n: int) -> None:
        node, at = self.root, 0
        while node.file is None and at < len(key):
            child = node.below.get(key[at]) if node.below else None
            if child is None:
                child = Node(key[at:])
                node.below = node.below or {}
                node.below[key[at]] = child
                self.size += len(key) - at + _NODE_BYTES
            elif not key.startswith(child.edge, at):
                m = shared(child.edge, key, at)
                middle = Node(child.edge[:m])
                child.edge = child.edge[m:]
                middle.below = {child.edge[0]: child}
                node.below[key[at]] = middle
                self.size += _NODE_BYTES
                child = middle
            node, at = child, at + len(child.edge)
        if node.file is not None:
            write(node.file, key, sha, lo, hi, n)
            return
        if node.end is None:
            node.end = (sha, lo, hi, n)
        else:
            old = node.end
            node.end = (sha, least(old[1], lo), most(old[2], hi), old[3] + n)
        if self.size > self.limit:
            self.spill()

    def spill(self) -> None:
        """Moves the heaviest subtree below the first branching to a file."""
        node, prefix = self.root, b""
        while node.below and len(node.below) == 1:
            child = next(iter(node.below.values()))
            if child.file is not None or not child.below:
                break
            node, prefix = child, prefix + child.edge
        found = [(sum(len(n.edge) + _NODE_BYTES for n, _ in walk(c, b"")), k) for k, c in (node.below or {}).items() if c.file is None and c.below]
        if not found:
            self.limit *= 2
            return
        size, first = max(found)
        child = node.below[first]
        file = tempfile.TemporaryFile()
        for n, key in walk(child, prefix):
            if n.file is None and n.end is not None:
                write(file, key, *n.end)
            elif n.file is not None:
                self.spilled.remove(n.file)
                n.file.seek(0)
                while block := n.file.read(1 << 20):
                    file.write(block)
                n.file.close()
        stub = Node(child.edge)
        stub.file = file
        node.below[first] = stub
        self.spilled.append(file)
        self.size -= size

    def terminals(self):
        """(sha256, least id, greatest id, rows) of every distinct text."""
        for node, _ in walk(self.root, b"", False):
            if node.end is not None:
                yield node.end
        self.root = Node(b"")
        for file in self.spilled:
            file.seek(0)
            sub = RadixTrie(self.limit)
            while head := file.read(_HEAD.size):
                length, lo, hi, n, known = _HEAD.unpack(head)
                sha = file.read(32)
                sub.insert(file.read(length), sha, lo if known else None, hi if known else None, n)
            file.close()
            yield from sub.terminals()


def walk(node: Node, prefix: bytes, keys: bool = True):
    """The nodes of a subtree with their whole keys."""
    stack = [(node, prefix)]
    while stack:
        n, before = stack.pop()
        key = before + n.edge if keys else b""
        yield n, key
        stack.extend((c, key) for c in (n.below or {}).values())


def write(file, key: bytes, sha: bytes, lo, hi, n: int) -> None:
    file.write(_HEAD.pack(len(key), lo or 0, hi or 0, n, lo is not None) + sha + key)


def texts(batch: pa.RecordBatch):
    """(identifier, normalised bytes) of the rows of a batch."""
    for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield key, (raw.as_py() or b"").lower()


def members(batches):
    """A map stage: identifier, length and content hash of each row."""
    for batch in batches:
        ids, shas, sizes = [], [], []
        for key, raw in texts(batch):
            ids.append(key)
            shas.append(hashlib.sha256(raw).digest())
            sizes.append(len(raw))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64()), "sha": pa.array(shas, pa.binary())})


REPRESENTATIVE = "size long, sha binary, lo long, hi long, n long, body binary"
_ARROW = pa.schema([("size", pa.int64()), ("sha", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def representatives(limit: int):
    """A map stage: one row for each text of a task, or of a bounded part of one."""

    def flush(held: dict):
        rows = [{"size": len(v[0]), "sha": k, "lo": v[1], "hi": v[2], "n": v[3], "body": v[0]} for k, v in held.items()]
        return pa.RecordBatch.from_pylist(rows, _ARROW)

    def stage(batches):
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for key, raw in texts(batch):
                sha = hashlib.sha256(raw).digest()
                seen = held.get(sha)
                if seen is None:
                    held[sha] = [raw, key, key, 1]
                    size += len(raw) + 200
                    if size > limit:
                        yield flush(held)
                        held, size = {}, 0
                elif seen[0] != raw:
                    raise ValueError("two texts have the same SHA-256")
                else:
                    seen[1:] = least(seen[1], key), most(seen[2], key), seen[3] + 1
        if held:
            yield flush(held)

    return stage


def owners(limit: int):
    """A map stage over whole partitions: the classes that a trie finds."""

    def stage(batches):
        trie = RadixTrie(limit)
        for batch in batches:
            cols = [batch.column(c) for c in ("body", "sha", "lo", "hi", "n")]
            for row in zip(*cols, strict=True):
                trie.insert(*(x.as_py() for x in row))
        seen: set[bytes] = set()
        rows: list[tuple] = []
        for end in trie.terminals():
            if end[0] in seen:
                raise ValueError("two texts have the same SHA-256")
            seen.add(end[0])
            rows.append(end)
            if len(rows) == 10_000:
                yield packed(rows)
                rows = []
        yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["sha", "lo", "hi", "n"])

    return stage


def duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, n_bytes and sha (SHA-256) of the
    text after lower-casing A-Z. keep: which identifier of equal texts stays, smallest or largest."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    parts = store.partitions(docs.sparkSession)
    held = rows.mapInArrow(store.lean(representatives(MERGE_BYTES)), REPRESENTATIVE).repartition(parts, "size", "sha")
    classes = held.mapInArrow(store.lean(owners(trie_bytes)), "sha binary, lo long, hi long, n long")
    named = classes.select("sha", F.col("lo" if keep == "smallest" else "hi").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.mapInArrow(store.lean(members), "doc_id long, size long, sha binary").join(named, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("size").alias("n_bytes"), "sha")


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op2 from the operator's output."""
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
