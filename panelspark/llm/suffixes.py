"""Suffix-array dedup: longest previous factors of at least `least` bytes are later copies.

The longest previous factor of a position is the longest string that starts there and also starts in
a document with a smaller identifier. In suffix order it is shared with the previous or the next
suffix of a smaller document, so two walks over the array give all lengths; the least common prefix
on the way is carried along. Every byte of a factor of `least` bytes or more is removed and the
first occurrence is kept.

Only suffixes that share an anchor with another document need an order, and those meet in one bucket
as text (see repeats): there the suffix array is built. Factors are measured up to `least` bytes,
which is what removal asks; a longer copy is a run of such positions.

Edge cases: null and empty texts have no bytes; a document shorter than `least` loses nothing;
matches never cross documents; rows with one identifier are not earlier than each other; a null
identifier is the smallest; a text of any length is one document; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, store
from . import textkit as tk

LEAST = 50


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, whose order is that of the bytes."""
    padded = np.concatenate([text, np.zeros(15, np.uint8)])
    out = np.empty(len(text) + 8, tk.U)
    for k in range(8):
        part = out[k::8]
        part[:] = np.frombuffer(padded[k : k + 8 * ((len(padded) - k) // 8)].tobytes(), ">u8")[: len(part)]
    return out


def suffix_order(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `at` sorted by their first `depth` bytes. Sorts by eight bytes, then sorts again
    only what is still tied."""
    key = words[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    done = 8
    while done < depth:
        step = min(done, depth - 8)
        done += 8
        tied = ~new
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        key = words[at[order[where]] + step]
        inner = np.lexsort((key, group))
        order[where] = order[where][inner]
        key = key[inner]
        same = np.zeros(len(where), bool)
        same[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        new[where] = ~same
    return order


def common_prefixes(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The length, up to depth, of the common prefix of each suffix with the one before it."""
    out = np.full(len(at), depth, np.int64)
    out[:1] = 0
    left, done = np.arange(1, len(at)), 0
    while done < depth and len(left):
        step = max(0, min(done, depth - 8))
        differ = words[at[left] + step] ^ words[at[left - 1] + step]
        found = differ != 0
        x = differ[found]
        equal = sum((x < tk.U(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8))
        out[left[found]] = np.minimum(step + equal, depth)
        left = left[~found]
        done += 8
    return out


def to_smaller(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, what it shares with the nearest earlier place of a smaller value: the least of
    `shared` (a place with the one before it) on the way there, 0 without one. Jumps along such places."""
    to = np.arange(len(values)) - 1
    least = shared.copy()
    active = np.flatnonzero((to >= 0) & (values[to] >= values))
    while len(active):
        over = to[active]
        least[active] = np.minimum(least[active], least[over])
        to[active] = to[over]
        active = active[(to[active] >= 0) & (values[to[active]] >= values[active])]
    least[to < 0] = 0
    return least


def previous_factors(text: np.ndarray, at: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """The longest previous factor, up to depth, of each suffix: from the previous and from the next
    smaller identifier in suffix order."""
    words = words_at(text)
    if depth < 8:
        words &= tk.U((1 << 64) - (1 << 64 - 8 * depth))
    order = suffix_order(words, at, depth)
    shared, owner = common_prefixes(words, at[order], depth), ids[order]
    before = to_smaller(owner, shared)
    after = to_smaller(owner[::-1], np.append(shared[1:], 0)[::-1])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def cut(data: np.ndarray, _offsets, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[repeats.spread(lo, hi - lo)], hi - lo


def judge(least: int, text: np.ndarray, sizes: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = repeats.spread(np.cumsum(sizes) - sizes, windows)
    return previous_factors(text, at, np.repeat(ids, windows), least) >= least


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.BYTE_VALUE[data], offsets


KEPT = "doc_id long, n_bytes long, spans array<long>, kept binary"


def finish(rows: pa.Table, covered: np.ndarray) -> pa.Table:
    """Removed spans and remaining bytes of each document."""
    data, off = tk.flat(rows.column("text"))
    removed = tk.per_doc(covered, off)
    begins, ends = tk.runs(covered, off)
    first = np.searchsorted(begins, off)
    doc = tk.owner(off, begins)
    flat = np.stack([begins - off[doc], ends - off[doc]], 1).ravel()
    spans = pa.ListArray.from_arrays(pa.array(2 * first, pa.int32()), pa.array(flat, pa.int64()))
    kept = np.concatenate([[0], np.cumsum(np.diff(off) - removed)])
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(data[~covered].tobytes())])
    return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": np.diff(off), "spans": spans, "kept": body.cast(pa.binary())})


def without_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (start and end of each removed run, in bytes,
    flattened) and kept (the remaining bytes)."""
    kind = repeats.Kind(least, (least + 1) // 2, byte_units, cut, partial(judge, least), repeats.HOT)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return repeats.repeated(store.block_table(rows, "copies", repeats.BLOCK_BYTES), kind, finish, KEPT)


def digest(found: DataFrame) -> DataFrame:
    """The contract columns of op5 from the operator's output."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
