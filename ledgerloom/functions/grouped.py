"""Rows of one key together, a key at a time, in Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that is handed back.
_ROWS = 8192


def by_key(df: DataFrame, key: str, order: list[str], of_key: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """key and the columns of ``schema``: what ``of_key`` makes of the other columns of each key's rows, which come sorted by ``order``.

    The rows are moved once, by ``key``, and sorted within their partitions, so a worker holds the rows of one key and of one batch. Rows without a key are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rest = [c for c in df.columns if c != key]
    names = [key, *[c.strip().split()[0] for c in schema.split(",")]]
    moved = df.filter(df[key].isNotNull()).select(key, *rest).repartition(key).sortWithinPartitions(key, *order)
    target = df.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}").schema
    types = [f.dataType for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        out: list[tuple] = []
        group: list[tuple] = []
        last = None

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if k != last:
                    if group:
                        out.extend((last, *x) for x in of_key(group))
                        if len(out) >= _ROWS:
                            yield packed()
                    last, group = k, []
                group.append(row)
        if group:
            out.extend((last, *x) for x in of_key(group))
        if out:
            yield packed()

    return moved.mapInArrow(run, target)
