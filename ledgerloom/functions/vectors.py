"""Vectors as arrays of doubles."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


#: Terms whose hashes a worker remembers.
_KNOWN = 200_000
#: Terms of the rows that a worker takes at once, and rows; a single row may have more.
_TERMS, _ROWS = 200_000, 1024


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows of about ``_TERMS`` terms, so that a worker's memory doesn't go by the length of the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TERMS, side="right"))
            size = min(max(end - at, 1), _ROWS)
            yield batch.slice(at, size)
            at += size


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v, F.lit(1), n)
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Null elements count as 0."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def rounded(x: Column, places: int) -> Column:
    """What rounds to zero keeps its sign, as in SQL."""
    r = F.round(x, places)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector; longer vectors are cut to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v, F.lit(1), n)
    bottom = norm(cut(a)) * norm(cut(b))
    return F.when((n > 0) & (bottom > 0), dot(a, b) / bottom).otherwise(F.lit(0.0))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of each key's unit vectors, brought to length 1."""
    at = df.select(key, F.posexplode(unit(F.col(vector))).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    packed = at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    return packed.select(key, unit(F.col("v")).alias(vector))


def _hashed(term: str, dim: int) -> tuple[int, float]:
    digest = hashlib.blake2b(term.encode(), digest_size=16).digest()
    place, sign = struct.unpack_from(">QB", digest)
    return place % dim, -1.0 if sign % 2 else 1.0


def hashed_vectors(df: DataFrame, key: str, terms: str, dim: int = 384) -> DataFrame:
    """key, vector: signed feature hashing of an array of terms (blake2b), brought to length 1."""
    kind = df.schema[key].dataType.simpleString()
    dim = max(64, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in _pieces(batches):
            out = np.zeros((batch.num_rows, dim))
            for row, words in enumerate(batch.column(1).to_pylist()):
                for w, times in Counter(words or ()).items():
                    if w is not None:
                        if w not in known:
                            if len(known) >= _KNOWN:
                                known.clear()
                            known[w] = _hashed(w, dim)
                        out[row, known[w][0]] += known[w][1] * times
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.round(np.divide(out, lengths, out=out, where=lengths > 0), 6)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "vector"])

    return df.select(key, terms).mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def subword_vectors(df: DataFrame, key: str, terms: str, dim: int = 384) -> DataFrame:
    """key, vector: the mean of the terms' vectors, brought to length 1.

    A term's vector is the sum of its hashed substrings of 3 to 5 characters, its ends marked by ``<`` and ``>``, brought to length 1.
    """
    kind = df.schema[key].dataType.simpleString()
    dim = max(64, dim)

    def of_term(term: str) -> tuple[np.ndarray, np.ndarray]:
        marked = f"<{term}>"
        grams = [marked[i : i + n] for n in range(3, 6) for i in range(len(marked) - n + 1)] or [term]
        places, signs = zip(*[_hashed(g, dim) for g in grams])
        at, inverse = np.unique(places, return_inverse=True)
        sums = np.bincount(inverse, weights=signs)
        length = np.linalg.norm(sums)
        return at, sums / length if length > 0 else sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _pieces(batches):
            out = np.zeros((batch.num_rows, dim))
            for row, words in enumerate(batch.column(1).to_pylist()):
                places, values = [], []
                for w in words or ():
                    if w:
                        if w not in known:
                            if len(known) >= _KNOWN:
                                known.clear()
                            known[w] = of_term(w)
                        at, sums = known[w]
                        places.append(at)
                        values.append(sums)
                if places:
                    out[row] = np.bincount(np.concatenate(places), weights=np.concatenate(values), minlength=dim)
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.round(np.divide(out, lengths, out=out, where=lengths > 0), 6)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "vector"])

    return df.select(key, terms).mapInArrow(run, f"`{key}` {kind}, vector array<double>")
