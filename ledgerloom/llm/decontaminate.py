"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles, in powers of two. For a partition
of items of up to ``2**p`` shingles every document, however long, is cut into blocks of
``2**(p-2)`` shingles, and each five consecutive blocks are one window: an item's passage
always lies inside some window not much longer than itself. Blocks and windows begin anew with each document, so that
what it matches doesn't depend on its neighbours. A required containment in
a long document turns into a Jaccard similarity with a window that has a useful lower
bound. From that bound follows the number of MinHash values that a partition needs to find
a match with probability ``recall``. Items that share one MinHash value with a
window are candidates; each is verified by its exact shingle containment in the whole
document. An item of fewer words than a shingle is looked for as it is: a document that has its words one after another holds it.

The items' index goes to the executors while its estimated size is at most
``index_bytes``; then all is one scan of the documents. Beyond that the same MinHash values
are joined by Spark, see :func:`_joined`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textarrays as ta
from .workspace import free_name

SHINGLE, THRESHOLD, RECALL, INDEX_BYTES = 5, 0.5, 0.99, 64 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Partition:
    """Items of 2**(p-1)+1 to 2**p shingles."""

    p: int
    threshold: float
    recall: float

    @property
    def block(self) -> int:
        return max(1, 1 << max(0, self.p - 2))

    @property
    def width(self) -> int:
        """Blocks in a window."""
        return 5 if self.block > 1 else 1 << self.p

    @property
    def hashes(self) -> int:
        least = (1 << (self.p - 1)) + 1 if self.p else 1
        common = math.ceil(self.threshold * least)
        jaccard = common / (self.block * self.width + least - common)
        return 1 if jaccard >= 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - jaccard))


def hash_values(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k-th MinHash permutation of shingle hashes."""
    seed = ta.mix(np.array([2 * k + 1, 2 * k + 2], np.uint64))
    return (shingles ^ seed[0]) * (seed[1] | np.uint64(1))


def partition_windows(shingles: np.ndarray, counts: np.ndarray, parts: list[Partition]) -> Iterator[tuple[Partition, int, np.ndarray, np.ndarray]]:
    """(partition, k, window minima, row of each window): a window begins at every block of a row and ends with the row at the latest."""
    rows = np.flatnonzero(counts > 0)
    if not len(rows) or not parts:
        return
    parts = sorted(parts, key=lambda q: q.block)
    # where the pairs of blocks begin that make the blocks of the next size, and the row of each block, by size
    pairs: dict[int, np.ndarray] = {}
    row_of: dict[int, np.ndarray] = {}
    n, block = counts[rows], 1
    while True:
        row_of[block] = np.repeat(rows, n)
        if block >= parts[-1].block:
            break
        half, begin = -(-n // 2), np.cumsum(n) - n
        pairs[block] = np.repeat(begin, half) + 2 * (np.arange(int(half.sum())) - np.repeat(np.cumsum(half) - half, half))
        n, block = half, block * 2
    inside: dict[tuple[int, int], np.ndarray] = {}  # by block and step: whether the block so many further on is of the same row
    for k in range(max(q.hashes for q in parts)):
        minima, block = hash_values(shingles, k), 1
        for q in parts:
            while block < q.block:
                minima, block = np.minimum.reduceat(minima, pairs[block]), block * 2
            if k >= q.hashes:
                continue
            out, have, row = minima.copy(), 1, row_of[block]
            while have < q.width:
                step = min(have, q.width - have)
                if step < len(out):
                    if (block, step) not in inside:
                        inside[block, step] = row[step:] == row[:-step]
                    out[:-step] = np.where(inside[block, step], np.minimum(out[:-step], out[step:]), out[:-step])
                have += step
            yield q, k, out, row


class ItemIndex:
    """The items' distinct shingles and, by partition and k, their MinHash values."""

    def __init__(self, texts: list[str | None], shingle: int, threshold: float, recall: float):
        hashes, n_words = ta.words(pa.array(texts, pa.string()))
        every, counts = ta.shingles(hashes, n_words, shingle)
        counts_known = np.where(n_words >= shingle, counts, 0)
        short = (n_words > 0) & (n_words < shingle)
        # items shorter than a shingle, by their number of words: the hash of all their words, which is their only shingle of that many
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place = np.cumsum(counts) - counts
        for w in np.unique(n_words[short]):
            own = np.flatnonzero(n_words == w)
            order = np.argsort(every[place[own]], kind="stable")
            self.short[int(w)] = every[place[own]][order], own[order]
        every = every[np.repeat(n_words >= shingle, counts)]
        self.shingle, self.threshold = shingle, threshold
        level = np.ceil(np.log2(np.maximum(counts_known, 1))).astype(int)
        self.sets, self.sizes = ta.distinct_by_row(every, counts_known)
        self.ends = np.cumsum(self.sizes)
        self.parts = [Partition(int(p), threshold, recall) for p in np.unique(level[counts_known > 0])]
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.filters: dict[tuple[int, int], np.ndarray] = {}
        first = np.cumsum(counts_known) - counts_known
        for q in self.parts:
            own = np.flatnonzero((level == q.p) & (counts_known > 0))
            bits = max(12, int(len(own) * 16).bit_length())
            for k in range(q.hashes):
                values = hash_values(every, k)
                least = np.array([values[first[i] : first[i] + counts_known[i]].min() for i in own], np.uint64)
                order = np.argsort(least, kind="stable")
                self.tables[q.p, k] = least[order], own[order]
                seen = np.zeros(1 << bits, bool)
                seen[(least & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
                self.filters[q.p, k] = seen

    def signatures(self) -> list[tuple[int, int, int, int]]:
        """(p, k, value as a signed integer, item)."""
        return [(p, k, int(v), int(i)) for (p, k), (values, own) in self.tables.items() for v, i in zip(values.view(np.int64), own)]

    def matches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, containment) of every match in a string column."""
        hashes, n_words = ta.words(column)
        shingles, counts = ta.shingles(hashes, n_words, self.shingle)
        n_items = max(1, len(self.sizes))
        found, ends = [np.zeros(0, np.int64)], np.cumsum(counts)
        for q, k, minima, row in partition_windows(shingles, counts, self.parts):
            seen = self.filters[q.p, k]
            at = np.flatnonzero(seen[(minima & np.uint64(len(seen) - 1)).astype(np.int64)])
            if len(at):
                which, item = _equal(minima[at], *self.tables[q.p, k])
                found.append(np.unique(row[at[which]] * n_items + item))
        pairs = np.unique(np.concatenate(found))
        row, item = pairs // n_items, pairs % n_items
        share = np.zeros(len(pairs))
        for r in np.unique(row):
            text = shingles[ends[r] - counts[r] : ends[r]]
            for j in range(*np.searchsorted(row, [r, r + 1])):
                i = item[j]
                share[j] = np.isin(self.sets[self.ends[i] - self.sizes[i] : self.ends[i]], text).mean()
        keep = share >= self.threshold
        row, item, share = row[keep], item[keep], share[keep]
        for w, (values, own) in self.short.items():
            sequences, n = ta.shingles(hashes, n_words, w)
            which, named = _equal(sequences, values, own)
            pairs = np.unique(np.repeat(np.arange(len(n)), n)[which] * n_items + named)
            row, item, share = np.append(row, pairs // n_items), np.append(item, pairs % n_items), np.append(share, np.ones(len(pairs)))
        return row, item, share


def _equal(looked: np.ndarray, values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``looked``, item) of all equal values; ``values`` ascend."""
    lo, hi = np.searchsorted(values, looked, "left"), np.searchsorted(values, looked, "right")
    n = hi - lo
    return np.repeat(np.arange(len(looked)), n), own[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def _small(items: DataFrame, index_bytes: int) -> bool:
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return n * 600 + chars * 2 <= index_bytes


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, containment: a row for each row of ``docs`` and item of which at least ``threshold`` of the distinct shingles are in the text.

    Words are compared in lower case and without ASCII punctuation. An item of fewer than ``shingle``
    words matches where all its words stand one after another, with containment 1; so one of a single word matches every document that has the word. Empty and null items never match.
    Where the items' index would be larger than ``index_bytes`` the search is joined by Spark instead of broadcast; that doesn't change the result.
    Null or empty documents match nothing. Repeated rows give repeated rows, items of equal text
    match alike, a null id is reported as null. Other columns are not read.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("containment", T.DoubleType()),
    ])
    if not _small(items, index_bytes):
        pairs = _joined(docs, items, shingle, threshold, recall)
        named = items.select("item_id", _text_key("text").alias("__item"))
        return docs.select("doc_id", _text_key("text").alias("__doc")).join(pairs, "__doc").join(named, "__item").select("doc_id", "item_id", "containment")
    rows = items.select("item_id", "text").collect()
    ids = pa.array([r[0] for r in rows], type=_arrow(schema["item_id"].dataType))
    shared = docs.sparkSession.sparkContext.broadcast((ItemIndex([r[1] for r in rows], shingle, threshold, recall), ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, item_ids = shared.value
        for batch in batches:
            for lo, hi in ta.groups(batch.column(1)):
                row, item, share = index.matches(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), item_ids.take(pa.array(item)), pa.array(share)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which :func:`contaminated` finds no item; null and empty texts stay."""
    if not _small(items, index_bytes):
        pairs = _joined(docs, items, shingle, threshold, recall)
        own = free_name(docs, "__doc")
        return docs.join(pairs.select(F.col("__doc").alias(own)).distinct(), _text_key(docs["text"]) == F.col(own), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in items.select("text").collect()], shingle, threshold, recall))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ta.groups(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                clean = np.ones(hi - lo, bool)
                clean[shared.value.matches(part.column(at))[0]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _text_key(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _joined(docs: DataFrame, items: DataFrame, shingle: int, threshold: float, recall: float) -> DataFrame:
    """__doc, __item (hashes of the texts), containment: the same search where the items are many.

    Items' and windows' MinHash values meet in an equi-join; the candidates' shingles
    are then joined for the exact containment.
    """
    sides = {}
    for name, df in (("__doc", docs), ("__item", items)):
        sides[name] = df.filter(F.col("text").isNotNull()).select(_text_key("text").alias(name), "text").dropDuplicates([name])

    def sets(name: str, df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in ta.groups(batch.column(1)):
                    values, counts = ta.shingles(*(w := ta.words(batch.column(1).slice(lo, hi - lo))), shingle)
                    values, counts = values[np.repeat(w[1] >= shingle, counts)], np.where(w[1] >= shingle, counts, 0)
                    values, counts = ta.distinct_by_row(values, counts)
                    keys = batch.column(0).slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(hi - lo), counts))), pa.array(values.view(np.int64))], names=[name, "shingle"])

        return df.mapInArrow(run, f"{name} binary, shingle long")

    def values(name: str, df: DataFrame, whole: bool, parts: list[int]) -> DataFrame:
        """MinHash values: of whole items, or of all windows for the partitions there are."""
        own = [Partition(p, threshold, recall) for p in parts]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in ta.groups(batch.column(1)):
                    column, keys = batch.column(1).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo)
                    if whole:
                        rows = ItemIndex(column.to_pylist(), shingle, threshold, recall).signatures()
                        if rows:
                            p, k, v, i = map(list, zip(*rows))
                            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64()), keys.take(pa.array(i))], names=["p", "k", "value", name])
                        continue
                    shingles, counts = ta.shingles(*ta.words(column), shingle)
                    for q, k, value, row in partition_windows(shingles, counts, own):
                        new = np.ones(len(row), bool)
                        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
                        n = int(new.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q.p, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(value[new].view(np.int64)), keys.take(pa.array(row[new]))], names=["p", "k", "value", name])

        return df.mapInArrow(run, f"p int, k int, value long, {name} binary")

    def sequences(name: str, df: DataFrame, widths: list[int]) -> DataFrame:
        """Hashes of the ``w`` words from every word on, for the widths given; of items those of just ``w`` words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in ta.groups(batch.column(1)):
                    hashes, n_words = ta.words(batch.column(1).slice(lo, hi - lo))
                    keys = batch.column(0).slice(lo, hi - lo)
                    for w in widths:
                        of = np.where(n_words == w, n_words, 0) if name == "__item" else n_words
                        values, n = ta.shingles(hashes[np.repeat(of > 0, n_words)], of, w)
                        row = np.repeat(np.arange(hi - lo), n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), w, np.int32)), pa.array(values.view(np.int64)), keys.take(pa.array(row))], names=["p", "value", name])

        return df.mapInArrow(run, f"p int, value long, {name} binary")

    of_items = values("__item", sides["__item"], True, [])
    parts = sorted(r[0] for r in of_items.select("p").distinct().collect())
    of_docs = values("__doc", sides["__doc"], False, parts) if parts else docs.sparkSession.createDataFrame([], "p int, k int, value long, __doc binary")
    pairs = of_docs.join(of_items, ["p", "k", "value"]).select("__doc", "__item").distinct()
    item_sets = sets("__item", sides["__item"])
    sizes = item_sets.groupBy("__item").agg(F.count("*").alias("size"))
    doc_sets = sets("__doc", sides["__doc"].join(pairs, "__doc", "left_semi"))
    common = pairs.join(item_sets, "__item").join(doc_sets, ["__doc", "shingle"]).groupBy("__doc", "__item").agg(F.count("*").alias("common"))
    found = common.join(sizes, "__item").select("__doc", "__item", (F.col("common") / F.col("size")).alias("containment")).filter(F.col("containment") >= threshold)
    short = sequences("__item", sides["__item"], list(range(1, shingle)))
    widths = sorted(r[0] for r in short.select("p").distinct().collect())
    if widths:
        exact = sequences("__doc", sides["__doc"], widths).join(short, ["p", "value"]).select("__doc", "__item").distinct()
        found = found.unionByName(exact.withColumn("containment", F.lit(1.0)))
    return found
