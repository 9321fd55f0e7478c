"""Line dedup over batches with levelled sorted runs.

The digests of all lines seen are kept as runs: bucketed tables in the shared folder, each bucket sorted by digest.
A new batch is reduced to the first occurrence of each of its lines, merge-anti-joined with
the runs, bucket against bucket without moving the runs, and what is new becomes a run of
level 0. When a level has ``FANOUT`` runs they are merged into one run of the next level. Documents keep
the lines that were new, in order.

:class:`Runs` lasts: what a batch added is listed in a manifest beside the runs, and ``Runs(spark, folder)``
goes on from there, in the same session or a later one. :func:`deduped_lines` takes a whole table through fresh runs in a few batches.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .workspace import delete, mark, new_path, release, scanned_bytes, written

BATCHES, FANOUT, MIN_WORDS = 4, 3, 1
#: Bytes of scanned files for each bucket of the runs; 16 buckets at least.
BUCKET_BYTES = 64 << 20
#: White space that doesn't count at the ends of a line and parts its words.
WHITE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MANIFEST = "seq long, level int, path string, buckets int, entry int"


def digest_pair(line: Column) -> list[Column]:
    """128 bits of a line as two columns."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


class Runs:
    """The levelled runs in ``folder``, by default a new one in the shared folder.

    A batch's run and the manifest naming it are written before the runs that they replace are deleted, so that
    a job that dies leaves the state before or after the batch. One job at a time may add to a folder.
    ``buckets`` and ``fanout`` don't change any result; the buckets of runs already in the folder hold.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 16, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.folder = folder or new_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.seq = 0
        self._tables: dict[str, str] = {}
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            listed = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
            last = listed.agg(F.max("seq")).first()[0]
            # a manifest is as long as there are runs: FANOUT for each of the levels, whose number grows as the log of the batches
            for r in listed.filter(F.col("seq") == last).orderBy("entry").collect():
                self.seq, self.buckets = r["seq"], r["buckets"]
                while len(self.levels) <= r["level"]:
                    self.levels.append([])
                if r["path"]:
                    self.levels[r["level"]].append(r["path"])

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def table(self, path: str) -> DataFrame:
        if path not in self._tables:
            name = "line_runs_" + uuid.uuid4().hex[:16]
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT) USING parquet OPTIONS (path '{path}') CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS")
            self._tables[path] = name
        return self.spark.table(self._tables[path])

    def _forget(self, path: str) -> None:
        if name := self._tables.pop(path, None):
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, digests: DataFrame) -> str:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", "line_runs_" + uuid.uuid4().hex[:16]
        digests.select("h1", "h2").repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self._tables[path] = name
        return path

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` whose (h1, h2) no run holds."""
        for path in self.paths():
            digests = digests.join(self.table(path).hint("merge"), ["h1", "h2"], "left_anti")
        return digests

    def add(self, digests: DataFrame) -> None:
        """Make distinct, unseen digests a run, merge the levels that are full, and commit the new list of runs."""
        new, level, old = self._write(digests), 0, []
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                break
            full, self.levels[level] = self.levels[level], []
            merged = self.table(full[0])
            for path in full[1:]:
                merged = merged.unionByName(self.table(path))
            new, level = self._write(merged), level + 1
            old += full
        self.seq += 1
        rows = [(self.seq, level, path, self.buckets, i) for i, (level, path) in enumerate((n, p) for n, paths in enumerate(self.levels) for p in paths)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for path in old:
            self._forget(path)
            delete(self.spark, path)

    def take(self, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
        """:func:`deduped_lines` of one new batch against all batches before it, whose lines it adds to the runs."""
        return _deduped(docs, self, [], min_words)

    def drop(self) -> None:
        """Delete the runs and their folder."""
        for path in self.paths():
            self._forget(path)
        self.levels = []
        delete(self.spark, self.folder)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _deduped(docs: DataFrame, runs: Runs, cuts: list[float], min_words: int) -> DataFrame:
    spark = docs.sparkSession
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("__th"))
    lines = (
        numbered.select("doc_id", "__th", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        .withColumn("line", F.btrim("line", F.lit(WHITE))).filter("line <> ''")
    )
    if min_words > 1:
        lines = lines.filter(F.size(F.filter(F.split(F.translate("line", WHITE, " " * len(WHITE)), " "), lambda w: w != "")) >= min_words)
    lines = lines.select("doc_id", "__th", "at", *digest_pair(F.col("line")))
    order = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))) if cuts else F.lit(0.0)
    begun = mark()
    lines = written(lines.withColumn("batch", sum((F.when(order > c, 1).otherwise(0) for c in cuts), F.lit(0))), "lines")
    firsts = None
    for i in range(len(cuts) + 1):
        own = lines.filter(F.col("batch") == i)
        first = own.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id"), F.col("__th"), F.col("at"))).alias("first"))
        new = written(runs.unseen(first), "new-lines")
        runs.add(new)
        firsts = new if firsts is None else firsts.unionByName(new)
    kept = firsts.select("first.*").withColumnsRenamed({"doc_id": "k_id", "__th": "k_th", "at": "k_at"})
    # the places of the lines to take away, by document
    gone = lines.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("__th").eqNullSafe(F.col("k_th")) & (F.col("at") == F.col("k_at")), "left_anti")
    gone = written(gone.groupBy("doc_id", "__th").agg(F.collect_set("at").alias("gone")).withColumnsRenamed({"doc_id": "g_id", "__th": "g_th"}), "gone-lines")
    release(spark, begun, (gone,))
    joined = numbered.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("__th") == F.col("g_th")), "left")
    # the places that stay are found by hash, so that this is linear in a text's lines
    lost = F.coalesce(F.col("gone"), F.array().cast(T.ArrayType(T.IntegerType())))
    parts = joined.select("doc_id", "text", "gone", lines_of(F.col("text")).alias("__every"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__every") - 1), lost)
    rest = F.array_join(F.transform(stay, lambda i: F.get("__every", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(rest)
    return parts.select("doc_id", text.alias("text"), F.size("__every").cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_removed"))


def deduped_lines(docs: DataFrame, batches: int = BATCHES, min_words: int = MIN_WORDS, fanout: int = FANOUT, buckets: int | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_removed: a row for each row of ``docs``, its text without the lines that came before.

    Documents go by in the order of doc_id, nulls first, in ``batches`` of about equal ranges of doc_id; within one doc_id by
    the whole text. Lines are compared without white space (``WHITE``) at the ends; of equal lines the very first stays, within a document
    too. Empty lines and those of white space alone always stay, and with ``min_words`` above 1 lines of fewer words. A document that loses all its lines has
    the text ''. A null text is one empty line, so its text is ''. Rows that repeat doc_id and text count as one document and
    get the same text. A doc_id that is no number makes one batch of all; :meth:`Runs.take` takes batches of any kind of
    doc_id one after the other. Other columns are not read. The number of batches, fan-out and buckets don't change the result;
    by default there are as many buckets as the files scanned have ``BUCKET_BYTES``.
    """
    if buckets is None:
        buckets = max(16, math.ceil(scanned_bytes(docs) / BUCKET_BYTES))
    cuts: list[float] = []
    if batches > 1 and isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        order = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
        # cut points for about equal batches; the result doesn't depend on them
        cuts = sorted(set(docs.select(F.percentile_approx(order, [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    runs = Runs(docs.sparkSession, None, buckets, fanout)
    try:
        return _deduped(docs, runs, cuts, min_words)
    finally:
        runs.drop()
