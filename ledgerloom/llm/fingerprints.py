"""Document fingerprints by one-permutation MinHash.

Every shingle of a document is hashed once. The hash's top bits choose one of ``bins``
bins, the rest is the value, and each bin keeps its least value. An empty bin takes over
the value of a full one, found by a fixed sequence of hashed probes (optimal
densification), so that equal positions of two fingerprints still agree with probability
equal to the Jaccard similarity. Of each value only the lowest ``bits`` bits are kept,
packed; :func:`estimate` corrects for the chance agreement that this brings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import textarrays as ta

BINS, BITS, SHINGLE = 128, 8, 3
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(shingles: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """(rows, bins) least value of each bin; all ones where a bin is empty."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    out = np.full(len(counts) * bins, _FULL, np.uint64)
    row = np.repeat(np.arange(len(counts), dtype=np.int64) * bins, counts)
    cell = row + (shingles >> shift).astype(np.int64)
    value = shingles & ((np.uint64(1) << shift) - np.uint64(1))
    np.minimum.at(out, cell, value)
    return out.reshape(len(counts), bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill every empty bin of each row that has a full one; a row without any stays empty."""
    bins = minima.shape[1]
    full = minima != _FULL
    out = minima.copy()
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    probe = 0
    while len(row):
        probe += 1
        to = (ta.mix(col.astype(np.uint64) * np.uint64(0x10001) + np.uint64(probe << 32)) & np.uint64(bins - 1)).astype(np.int64)
        hit = full[row, to]
        out[row[hit], col[hit]] = minima[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return out


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bins) values to (rows, bins * bits / 8) bytes of their lowest bits."""
    low = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, 8), axis=2, bitorder="little")[:, :, :bits]
    return np.packbits(low.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(fingerprint: bytes, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(fingerprint, np.uint8), bitorder="little").reshape(-1, bits)
    return flat.dot(1 << np.arange(bits))


def estimate(a: bytes | None, b: bytes | None, bits: int = BITS) -> float | None:
    """Jaccard similarity of two fingerprints, corrected for chance agreement of low bits.

    Clipped to 0..1; None if either document has no fingerprint.
    """
    if a is None or b is None:
        return None
    agree = float(np.mean(unpack(a, bits) == unpack(b, bits)))
    chance = 2.0**-bits
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_shingles, fingerprint: one row for each row of ``docs``.

    ``bins`` is a power of two and at least 8. Null or word-free text: counts are 0 and
    the fingerprint is null. A text of fewer than ``shingle`` words has one shingle. Rows
    with a null doc_id and repeated rows are fingerprinted like any other. Other columns
    of ``docs`` are not read, whatever their names. The plan is one scan without shuffle.
    """
    if bins < 8 or bins & (bins - 1) or not 1 <= bits <= 56:
        raise ValueError("bins must be a power of two from 8 on, bits from 1 to 56")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("fingerprint", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(1)):
                hashes, n_words = ta.words(batch.column(1).slice(lo, hi - lo))
                shingles, n_shingles = ta.shingles(hashes, n_words, shingle)
                packed = ta.fixed_binary(pack(densify(bin_minima(shingles, n_shingles, bins)), bits))
                packed = pa.compute.if_else(pa.array(n_shingles > 0), packed, pa.scalar(None, pa.binary()))
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_shingles), packed], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
