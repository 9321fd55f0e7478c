"""Vectorised text primitives over Arrow string columns.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII characters of the
lower-cased text. Words are hashed to 64 bits straight from the Arrow byte buffer with
numpy, so that no Python object is made per word. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_RINV = U64(pow(int(_R), -1, 1 << 64))
_Q = U64(0xD1342543DE82EF95)
_SPAN = 1 << 20
GROUP_BYTES = 2 << 20

WORD = np.zeros(256, bool)
for _b in b"abcdefghijklmnopqrstuvwxyz0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD[_b] = True
WORD[128:] = True

_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; makes every bit depend on every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, _SPAN + 4096)
        for key, base in (("p", _R), ("i", _RINV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets with one more entry than rows, from 0) of a string column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row, base = 0, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, base + most, "right")))
        yield row, stop
        row, base = stop, int(ends[stop - 1])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and the number of words of each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    is_word = WORD[data]
    begins, closes = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    closes[:-1] &= ~is_word[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], closes[last] = is_word[first], is_word[last]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(closes) + 1, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        span = int(ends[j - 1]) - base
        power, inverse = _powers(span + 1)
        prefix = np.zeros(span + 1, U64)
        np.cumsum((data[base : base + span].astype(U64) + U64(1)) * power[:span], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each row) of a string column."""
    data, offsets = string_parts(pc.utf8_lower(column))
    starts, ends, counts = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of each row, in order, and their number by row.

    A row of 1 to k-1 words has one shingle, of all its words; a row without words has none.
    """
    long = counts >= k
    per_row = np.where(long, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(per_row.sum()), U64)
    ends = np.cumsum(counts)
    total = len(hashes)
    if total >= k and long.any():
        rolled = np.zeros(total - k + 1, U64)
        for j in range(k):
            rolled *= _Q
            rolled += hashes[j : total - k + 1 + j]
        left = np.repeat(ends, counts)[: total - k + 1] - np.arange(total - k + 1)
        out[np.repeat(long, per_row)] = mix(rolled[left >= k] + U64(k))
    at = np.cumsum(per_row) - per_row
    for row in np.flatnonzero((counts > 0) & ~long):
        value = 0
        for h in hashes[ends[row] - counts[row] : ends[row]].tolist():
            value = (value * int(_Q) + h) & 0xFFFFFFFFFFFFFFFF
        out[at[row]] = mix(np.array([value], U64) + U64(counts[row]))[0]
    return out, per_row


def distinct_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and their number by row."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(counts))


def sequence_hash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row's whole sequence of words; 0 for a row without words."""
    out = np.zeros(len(counts), U64)
    filled = counts > 0
    if filled.any():
        starts = (np.cumsum(counts) - counts)[filled]
        place = np.arange(len(hashes), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        terms = mix(hashes ^ mix(place.astype(U64) + U64(0x51ED270B)))
        out[filled] = mix(np.add.reduceat(terms, starts) + counts[filled].astype(U64))
    return out


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as a binary column, one value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
