"""A folder that every executor can read, for tables that cut lineage.

The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is
unset, as in tests in local mode, one is made in the machine's temporary folder; on a
cluster an unset folder is an error, because a machine-local folder would be lost with
its executor.

An operator deletes its tables itself once nothing reads them any more; those that its lazy result still reads
stay until the caller, having stored the result, calls :func:`release`.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables written in this process that haven't been deleted, oldest first.
_live: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _live.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it lies; a missing one is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def mark() -> int:
    """The number of tables there are, for :func:`release`."""
    return len(_live)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables written since ``mark()`` gave ``since``, but for those that the frames in ``keep`` read.

    No frame that reads them can be used afterwards, nor any that is still to be computed from one.
    """
    read = "\n".join(f for df in keep for f in df.inputFiles())
    names = set(re.findall(r"[^/]+-[0-9a-f]{32}(?=/)", read))
    gone = [p for p in _live[since:] if p.rsplit("/", 1)[1] not in names]
    for path in gone:
        delete(spark, path)
        _live.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scanned_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads, by the optimizer's statistics; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0
