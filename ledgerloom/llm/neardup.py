"""MinHash near-dedup with HyperMinHash sketches.

A sketch has 128 buckets. Each keeps, of the least shingle hash that fell into it, only the number of
leading zeros (6 bits) and the next 10 bits (the mantissa), 16 bits in all. Bands of four registers that
agree make two documents candidates; the Jaccard similarity estimated from the whole
sketches, corrected for registers that agree by chance, thins them out, and the rest are verified on their
sets of 64-bit shingle hashes. Documents with the same words, by 128 bits of their sequence, are one unit from the start. The groups are the connected components of the verified pairs.

Of a band's members, each is first compared with the least one alone, which is linear and joins most
copies of a family; then one member of each component so found is compared with those of every other component in
the band, which joins most families. In the bands that still hold several components every member is at last compared with every member of
the others, so that no two candidates in different groups go unverified. The second and the last comparison take place where the band's rows, with their sketches, have been brought
together, so that only pairs that look similar are ever written; a band of many rows is cut into blocks, a large component's own or
shared by small ones, and each two blocks that don't belong to one component are compared in a place of their own.

Least members, sizes and hubs are found by aggregations, which combine before they shuffle, and joined back, where adaptive execution splits hot keys; no
band, component or group of copies is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import textarrays as ta
from .fingerprints import bin_minima
from .workspace import free_name, mark, release, written

BUCKETS, MANTISSA, ROWS, SHINGLE, THRESHOLD = 128, 10, 4, 3, 0.5
#: Rows of a band that are compared in one place; the result doesn't depend on it.
BLOCK = 2048
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE_BITS = 57


def registers(minima: np.ndarray) -> np.ndarray:
    """16-bit registers of bucket minima; 0 for an empty bucket."""
    length = np.frexp(minima.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(_VALUE_BITS + 1 - length, 1, 63)
    down = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64)
    mantissa = ((minima >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    out[minima == _EMPTY] = 0
    return out


def band_keys(regs: np.ndarray, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that isn't empty.

    A band of one or two filled registers has too few bits to tell short documents apart; there the mantissa counts in full.
    """
    bands = regs.shape[1] // ROWS
    words = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), bands)
    filled = (regs.reshape(len(regs), bands, ROWS) > 0).sum(axis=2)
    sparse = (filled > 0) & (filled < 3)
    row, band = np.nonzero(sparse)
    words = words.copy()
    if len(row):
        whole = minima.reshape(len(regs), bands, ROWS)[row, band]
        value = np.zeros(len(row), np.uint64)
        for j in range(ROWS):
            value = ta.mix(value + whole[:, j] + np.uint64(j + 1))
        words[row, band] = value
    row, band = np.nonzero(filled)
    return row, ta.mix(words[row, band] + ta.mix((band + 1).astype(np.uint64)))


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two disjoint sets of n and m shingles expected to agree by chance."""
    i = np.arange(1, 64)
    high, low = 2.0 ** -(i - 1) / BUCKETS, np.where(i < 63, 2.0**-i, 0.0) / BUCKETS
    falls = lambda x: np.exp(x[:, None] * np.log1p(-low)) - np.exp(x[:, None] * np.log1p(-np.minimum(high, 1 - 1e-12)))
    return BUCKETS * (falls(n.astype(float)) * falls(m.astype(float))).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, buckets they rest on) of rows of registers, corrected for collisions."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.clip((same - expected_collisions(n, m)) / used, 0, 1), used


def identity(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """128 bits of each row's whole sequence of words, 0 for a row without words."""
    second = ta.mix(hashes * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D))
    return ta.fixed_binary(np.stack([ta.sequence_hash(hashes, counts), ta.sequence_hash(second, counts)], axis=1))


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, same, n, sketch, keys by row. same: the identity of the sequence of words."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("same", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(1)):
                hashes, n_words = ta.words(batch.column(1).slice(lo, hi - lo))
                shingles, counts = ta.shingles(hashes, n_words, SHINGLE)
                minima = bin_minima(shingles, counts, BUCKETS)
                regs = registers(minima)
                row, key = band_keys(regs, minima)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), identity(hashes, n_words), pa.array(counts), ta.fixed_binary(regs), keys], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """same and the ascending distinct shingle hashes of every row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(0)):
                hashes, n_words = ta.words(batch.column(0).slice(lo, hi - lo))
                shingles, counts = ta.shingles(hashes, n_words, SHINGLE)
                values, counts = ta.distinct_by_row(shingles, counts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                shingle_sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([identity(hashes, n_words), shingle_sets], names=["same", "shingles"])

    return docs.select("text").mapInArrow(run, "same binary, shingles array<long>")


def _promising(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity, give or take three standard deviations, reaches the threshold."""
    side = lambda x: units.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            regs = []
            for i in (4, 5):
                data, offsets = ta.string_parts(batch.column(i).cast(pa.large_binary()).view(pa.large_string()))
                regs.append(np.frombuffer(data.tobytes(), np.uint16).reshape(len(n), BUCKETS))
            jaccard, used = estimate(*regs, n, m)
            yield batch.select([0, 1]).filter(pa.array(jaccard + 3 * np.sqrt(0.25 / used) >= threshold))

    return both.mapInArrow(run, "a long, b long")


def similar_rows(group: np.ndarray, part: np.ndarray, own: np.ndarray, inner: np.ndarray, n: np.ndarray, regs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the same group and of different parts whose estimate, give or take three standard deviations, reaches the threshold.

    Rows lie group by group. Where ``inner`` is false, a group is two blocks, told apart by ``own``, and only pairs across them count.
    """
    filled = (regs > 0).sum(axis=1)
    found_a, found_b = [], []
    live, step = np.arange(len(group)), 0
    while True:
        step += 1
        live = live[live < len(group) - step]
        live = live[group[live] == group[live + step]]
        if not len(live):
            break
        chosen = live[(part[live] != part[live + step]) & (inner[live] | (own[live] != own[live + step]))]
        for lo in range(0, len(chosen), 16384):
            a = chosen[lo : lo + 16384]
            left = regs[a]
            same = ((left == regs[a + step]) & (left > 0)).sum(axis=1)
            least = np.maximum(np.maximum(filled[a], filled[a + step]), 1)  # at most the buckets that the estimate rests on
            a = a[same / least + 3 * np.sqrt(0.25 / least) >= threshold]
            if len(a):
                jaccard, used = estimate(regs[a], regs[a + step], n[a], n[a + step])
                a = a[jaccard + 3 * np.sqrt(0.25 / used) >= threshold]
                found_a.append(a), found_b.append(a + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _cells(parts: DataFrame, block: int) -> DataFrame:
    """key, i, j, part, own, uid: each row of ``parts`` (key, part, uid) in every cell (i, j), i <= j, of two blocks in which it may meet another part.

    A part of more than ``block`` rows of a key has blocks of its own, which don't meet each other; the other parts share blocks, by hash.
    """
    spread = lambda x, n: F.pmod(F.xxhash64(x), n).cast("int")
    of_part = parts.groupBy("key", "part").agg(F.count("*").alias("rows"))
    is_large = F.col("rows") > block
    of_key = of_part.groupBy("key").agg(F.sum(F.when(is_large, 0).otherwise(F.col("rows"))).alias("small"), F.sum(F.when(is_large, F.ceil(F.col("rows") / block)).otherwise(0)).cast("int").alias("of_large"))
    of_key = of_key.withColumn("shared", F.ceil(F.col("small") / block).cast("int")).select("key", "shared", (F.col("shared") + F.col("of_large")).alias("blocks"))
    # a key's large parts are at most its rows by ``block``
    large = of_part.filter(is_large).withColumn("wide", F.ceil(F.col("rows") / block).cast("int"))
    large = large.withColumn("first", F.sum("wide").over(W.partitionBy("key").orderBy("part")) - F.col("wide")).select("key", "part", "wide", F.col("first").cast("int"))
    rows = parts.join(of_key, "key").join(large, ["key", "part"], "left")
    rows = rows.withColumn("own", F.when(F.col("wide").isNull(), spread("part", F.greatest("shared", F.lit(1)))).otherwise(F.col("shared") + F.col("first") + spread("uid", F.col("wide"))))
    begin = F.col("shared") + F.col("first")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("wide").isNull() | (j < begin) | (j >= begin + F.col("wide")))
    return rows.select("key", "part", "uid", "own", F.inline(F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))))


def _promising_in_bands(parts: DataFrame, units: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b), a < b, of rows of the same key and different parts that look similar. ``parts``: key, part, uid."""
    sketches = units.select("uid", F.col("n").alias("size"), "sketch")
    rows = _cells(parts, block).join(sketches, "uid").select("key", "i", "j", "part", "own", "uid", "size", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def compared(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, i, j, part, own, uid, size, regs = columns
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            a, b = similar_rows(group, part, own, i == j, size, regs, threshold)
            pairs = np.unique(np.stack([np.minimum(uid[a], uid[b]), np.maximum(uid[a], uid[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(7)]
            data, _ = ta.string_parts(batch.column(7).cast(pa.large_binary()).view(pa.large_string()))
            columns.append(np.frombuffer(data.tobytes(), np.uint16).reshape(batch.num_rows, BUCKETS))
            key, i, j = columns[:3]
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            same = held and all(held[-1][k][-1] == columns[k][0] for k in range(3))
            cut = int(new[-1]) if len(new) else (0 if same or not held else None)
            if cut is None:  # a batch of one group, another than the one held
                cut = 0
                yield compared([np.concatenate(c) for c in zip(*held)])
                held = []
            elif cut:
                held.append([c[:cut] for c in columns])
                yield compared([np.concatenate(c) for c in zip(*held)])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield compared([np.concatenate(c) for c in zip(*held)])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    side = lambda x: sets.select(F.col("uid").alias(x), F.col("shingles").alias(f"s_{x}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(common >= threshold * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex but the least one of each component of the edges (a, b); roots are least vertices.

    Alternates large-star and small-star steps until nothing changes; each step's result is a written table, and the one before is deleted.
    """
    state, begun = None, mark()
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v <> root").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.filter("root > v").join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        nearest = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(nearest, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("root")), F.struct(F.col("root").alias("v"), F.col("m").alias("root")))).alias("e")).select("e.*").filter("v <> root").distinct()
        edges = written(small, "edges")
        release(edges.sparkSession, begun, (edges,))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "root"))).first()
        if now == state:
            return edges
        state = now


def _labels(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id and same of each row of ``docs``; same and root of the rows that are in a group with others)."""
    begun = mark()
    sketched = written(_sketched(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = written(sketched.select("row", "doc_id", "same"), "rows")
    units = sketched.filter("n > 0").groupBy("same").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "keys")])
    units = written(units.withColumn("uid", F.monotonically_increasing_id()), "units")
    keyed = units.select("uid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("uid").alias("leader"), F.count("*").alias("size")).filter("size > 1").drop("size")
    members = written(keyed.join(shared, "key"), "members")
    named = units.select("same", "uid").join(members.select("uid").distinct(), "uid", "left_semi")
    # grouped by the key of the join, so that the sets are moved once
    sets = written(_sets(docs).join(named, "same").groupBy("same").agg(F.first("uid").alias("uid"), F.first("shingles").alias("shingles")).drop("same"), "sets")

    stars = members.filter("uid <> leader").select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct()
    found = written(_verified(_promising(stars, units, threshold), sets, threshold), "pairs")
    roots = components(found)
    for every_member in (False, True):
        parts = members.join(roots, members["uid"] == roots["v"], "left").select("key", "uid", F.coalesce("root", "uid").alias("part"))
        several = parts.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("key")
        parts = parts.join(several, "key", "left_semi")
        if not every_member:
            parts = parts.groupBy("key", "part").agg(F.min("uid").alias("uid"))
        parts = written(parts, "parts")
        more = _verified(written(_promising_in_bands(parts, units, threshold), "more-pairs"), sets, threshold)
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = written(units.select("same", "uid").join(roots, units["uid"] == roots["v"], "left").select("same", F.coalesce("root", "uid").alias("root")), "roots")
    release(docs.sparkSession, begun, (rows, roots))
    return rows, roots


def _groups(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, same and root by row; root, size and least row of each group). Rows without words are the group of root -1."""
    rows, roots = _labels(docs, threshold)
    named = rows.join(roots.withColumnRenamed("same", "__same"), F.col("same") == F.col("__same"), "left").select("row", "doc_id", "same", F.coalesce("root", F.lit(-1)).alias("root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "row"))
    return named, named.groupBy("root").agg(F.count("*").alias("group_size"), least.alias("least"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id, group_size, keep: a row for each row of ``docs``.

    Rows whose word 3-shingles have a Jaccard similarity of at least ``threshold`` are in one group, and so are rows linked
    by a chain of such; rows with the same words are exact copies. group_id is the group's least doc_id, and keep is true for
    one row of each group, the one of least doc_id (nulls come last). Rows without words, null texts included, are copies of
    each other. Repeated rows are copies, so one of them stays. Other columns are not read.
    """
    named, groups = _groups(docs, threshold)
    groups = groups.select("root", "group_size", F.col("least.doc_id").alias("group_id"), F.col("least.row").alias("first"))
    return named.join(groups, "root").select("doc_id", "group_id", "group_size", (F.col("row") == F.col("first")).alias("keep"))


def remove_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps: one of each group.

    Null and empty texts, texts without words, repeated rows and ties are treated as there, so of all rows without words one stays. Exact copies are
    reduced to the one of least doc_id before any of them is moved.
    """
    _, groups = _groups(docs, threshold)
    own, key, place = (free_name(docs, c) for c in ("__same", "__row", "__place"))
    keepers = groups.select(F.col("least.same").alias(own))
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, identity(*ta.words(part.column(at)))], names=schema.names)

    at_place = docs.mapInArrow(run, schema).withColumn(place, F.monotonically_increasing_id())
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    first = at_place.groupBy(own).agg(F.min_by(whole, F.struct(F.col("doc_id").isNull(), "doc_id", place)).alias(key))
    return first.join(keepers, own, "left_semi").select(*[F.col(key)[c].alias(c) for c in docs.columns])
