"""Vectorised text kernels on Arrow buffers: words, word hashes and hashes of runs of units.

A chunk is a slice of whole documents, held as one byte array and document offsets, so that each
kernel is a few numpy passes. Runs are hashed by a polynomial in 2**64 over random unit values,
then mixed; two hashes of a run agree when the units agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Just below a power of two, so that the tables of powers stay as small.
CHUNK_BYTES = (1 << 20) - 64
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(29)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xE7037ED1A0B428DB))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True

_tables: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n."""
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PI)):
            t = np.full(size, base, U)
            t[0] = 1
            _tables[k] = np.cumprod(t)
    return _tables[0][:n], _tables[1][:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        column = pc.fill_null(column, "" if text else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def each_chunk(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of the chunks of a column."""
    raw, off = flat(column)
    for lo, hi in chunks(off, limit):
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def word_bounds(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and the first word of each document."""
    inside = classes[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    p, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0x8EBC6AF09C88C6E3))


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the first word of each document."""
    starts, ends, first = word_bounds(data, offsets, classes)
    return span_hash(data, starts, ends), first


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of units follows."""
    total = np.zeros(len(units) + 1, U)
    np.cumsum(units * powers(len(units) + 1)[0][:-1], out=total[1:])
    return total


def run_hash(total: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hash of `lengths` units from each start."""
    inverse = powers(len(total))[1]
    ends = starts + lengths
    return mix((total[ends] - total[starts]) * inverse[starts] + np.asarray(lengths).astype(U) * U(0xC2B2AE3D27D4EB4F))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, those across documents too."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = prefix_sums(units)
    return mix((total[k:] - total[:n]) * powers(len(total))[1][:n] + np.full(1, k, U) * U(0xC2B2AE3D27D4EB4F))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k units that lie in one document."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    ends = first[1:]
    for back in range(1, k):
        at = ends - back
        ok[at[at >= 0]] = False
    return np.flatnonzero(ok)


def owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which document each unit belongs to."""
    return np.searchsorted(first, at, "right") - 1


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flagged units each document has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal flagged runs; a run ends with its document."""
    return word_bounds(flags.astype(np.uint8), first, np.arange(256) > 0)[:2]


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n units some interval covers."""
    if not len(starts):
        return np.zeros(n, bool)
    order = np.argsort(starts, kind="stable")
    begins, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > ends[:-1]
    step = np.zeros(n + 1, np.int8)
    step[begins[new]] = 1
    step[ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]] = -1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)
