"""Sharding by weighted rendezvous hashing.

Each record's stable key is hashed together with every shard's name; the shard of least
``-ln(u) / weight`` takes the record. A shard thus gets its weight's share, and when a
shard comes or goes only the records that it gains or loses move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import free_name, scanned_bytes

#: Bytes of scanned files for each partition that is written.
PIECE_BYTES = 128 << 20
SHARDS = {f"shard-{i:02d}": 2.0 if i < 4 else 1.0 for i in range(16)}


def record_key(docs: DataFrame) -> Column:
    """doc_id as text; for a null doc_id the text's digest, for a null text too the empty digest."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def rendezvous(key: Column, shards: dict[str, float]) -> Column:
    """The shard for ``key``; the draws are the top 52 bits of md5(key|shard), so that any system can repeat them."""
    if not shards or any(not w > 0 for w in shards.values()):
        raise ValueError("each shard needs a weight above 0")

    def cost(name: str, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / F.lit(float(weight))).alias("cost"), F.lit(name).alias("name"))

    return F.array_min(F.array(*[cost(n, w) for n, w in sorted(shards.items())]))["name"]


def pieces_of(shards: dict[str, float], pieces: int) -> dict[str, tuple[int, int]]:
    """(first partition, number of partitions) of each shard: about ``pieces`` for a shard of mean weight, one at least."""
    out, first, total = {}, 0, sum(shards.values())
    for name, weight in sorted(shards.items()):
        n = max(1, round(pieces * len(shards) * weight / total))
        out[name], first = (first, n), first + n
    return out


def shard(docs: DataFrame, shards: dict[str, float] = SHARDS, pieces: int | None = None) -> DataFrame:
    """``docs`` with the column ``shard``, each shard's records brought together in partitions of their own.

    A column of that name in ``docs`` is replaced. The key is :func:`record_key`, so rows with the
    same doc_id (repeated rows included) go to the same shard, and a row without doc_id goes where
    its text sends it. All rows stay, empty and null texts too. A shard has partitions by its weight, ``pieces`` if its weight
    is the mean, by default one for each ``PIECE_BYTES`` that the scanned files hold, four at least; within a shard rows are spread by
    their place, so that a key that very many rows share fills no single partition. The assignment doesn't depend on it.
    """
    if pieces is None:
        pieces = max(4, math.ceil(scanned_bytes(docs) / PIECE_BYTES / max(1, len(shards))))
    out = docs.withColumn("shard", rendezvous(record_key(docs), shards))
    cells = pieces_of(shards, pieces)
    first, n = (F.create_map(*[x for name, cell in cells.items() for x in (F.lit(name), F.lit(cell[i]))])[F.col("shard")] for i in (0, 1))
    own = free_name(out, "__piece")
    placed = out.withColumn(own, F.monotonically_increasing_id()).withColumn(own, (first + F.pmod(F.xxhash64(own), n)).cast("int"))
    return placed.repartitionById(sum(n for _, n in cells.values()), own).drop(own)
