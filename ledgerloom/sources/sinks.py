"""Tables as results: staged writes, upserts, deletions, fused JSON and audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.records import upserted


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def write_staged(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Replace the table at ``path``: written beside it first, and then renamed, so that a reader or a failed job never meets half a table."""
    spark = df.sparkSession
    fs, where, make = _file_system(spark, path)
    new, old = make(path.rstrip("/") + "__new"), make(path.rstrip("/") + "__old")
    fs.delete(new, True)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(where):
        fs.rename(where, old)
    if not fs.rename(new, where):
        fs.rename(old, where)
        raise OSError(f"the new table couldn't be moved to {path}")
    fs.delete(old, True)


def upsert(new: DataFrame, path: str, keys: list[str], keep: list[str] = ("created_at", "first_seen")) -> None:
    """Merge rows into the table at ``path`` by key; the columns ``keep`` of rows that exist stay. The table is made if there is none."""
    spark = new.sparkSession
    fs, where, _ = _file_system(spark, path)
    if not fs.exists(where):
        write_staged(new.dropDuplicates(keys), path)
        return
    write_staged(upserted(spark.read.parquet(path), new.dropDuplicates(keys), keys, keep), path)


def delete(path: str, doomed: DataFrame, keys: list[str]) -> None:
    """Take the rows with the keys of ``doomed`` out of the table at ``path``."""
    spark = doomed.sparkSession
    write_staged(spark.read.parquet(path).join(doomed.select(*keys).distinct(), keys, "left_anti"), path)


def fused(docs: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """key, payload: one JSON object a document, the columns of ``docs`` and, for each of ``parts``, its rows of that key as a list."""
    out = docs.select(key, F.struct(*docs.columns).alias("document"))
    for name, part in parts.items():
        rows = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in part.columns if c != key]))).alias(name))
        out = out.join(rows, key, "left")
    return out.select(key, F.to_json(F.struct("document", *parts)).alias("payload"))


def write_json(payloads: DataFrame, path: str) -> None:
    payloads.select("payload").write.mode("overwrite").text(path)


def audit_counts(**tables: DataFrame) -> DataFrame:
    """table, rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def bad_values(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """The rows in which a column holds none of the values allowed it; the check constraint of a table without any."""
    bad: Column = F.lit(False)
    for column, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(column).isin(*values), F.lit(True))
    return df.filter(bad)
