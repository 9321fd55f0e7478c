"""Row-keeping operators: best rows, merges, registries, clusters, nested payloads as rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best_rows(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """One row for each key: the one of the longest ``text``, of equally long ones the first by ``order``. One aggregation, no sort."""
    rank = F.struct(-F.length(F.coalesce(text, F.lit(""))), F.col(order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("__best")).select(*keys, "__best.*")


def without_empty_duplicates(df: DataFrame, name: str, text: str) -> DataFrame:
    """Rows with an empty ``text`` go if another row of that name has a text."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return df.withColumn("__most", F.max(size).over(W.partitionBy(name))).filter((size > 0) | (F.col("__most") == 0)).drop("__most")


def merged_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_first(df: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each combination of the ``signature`` columns."""
    rest = [c for c in df.columns if c not in signature]
    return df.groupBy(*signature).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(*signature, "__first.*").select(*df.columns)


def later_wins(*layers: DataFrame, key: str) -> DataFrame:
    """The union of ``layers``; of rows with the same key the one of the last layer."""
    marked = [f.withColumn("__layer", F.lit(i)) for i, f in enumerate(layers)]
    every = merged_sources(*marked)
    rest = [c for c in every.columns if c not in (key, "__layer")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "__layer").alias("__v")).select(key, "__v.*")


def without_subset_tables(tables: DataFrame) -> DataFrame:
    """``tables`` (doc_id, table_id, codes, rich) without the weak ones whose codes a rich table of the document has as well."""
    rich = tables.filter("rich").select(F.col("doc_id").alias("__doc"), F.col("codes").alias("__codes"))
    covered = (F.col("doc_id") == F.col("__doc")) & ~F.col("rich") & (F.size(F.array_except("codes", "__codes")) == 0)
    return tables.join(rich, covered, "left_anti")


def position_clusters(df: DataFrame, keys: list[str], x: str, gap: float) -> DataFrame:
    """keys, cluster (from 1), n, low, high, middle: runs of positions whose neighbours lie at most ``gap`` apart; middle is the median member."""
    order = W.partitionBy(*keys).orderBy(x)
    opened = df.select(*keys, x).withColumn("__new", F.coalesce((F.col(x) - F.lag(x).over(order) > gap).cast("int"), F.lit(1)))
    members = opened.withColumn("cluster", F.sum("__new").over(order))
    packed = members.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(x)).alias("m"))
    n = F.size("m")
    return packed.select(*keys, "cluster", n.alias("n"), F.element_at("m", 1).alias("low"), F.element_at("m", -1).alias("high"), F.element_at("m", F.floor(n / 2).cast("int") + 1).alias("middle"))


def stable_id(kind: Column, *parts: Column) -> Column:
    """``kind-`` and the first 24 hex digits of the SHA-1 of the parts joined by ``|``."""
    return F.concat(kind, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24))


def registry(seen: DataFrame) -> DataFrame:
    """entity_kind, natural_key, stable_id, first_run, last_run, runs of ``seen`` (run_id, entity_kind, natural_key)."""
    found = seen.groupBy("entity_kind", "natural_key").agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.countDistinct("run_id").alias("runs"))
    return found.withColumn("stable_id", stable_id(F.col("entity_kind"), F.col("entity_kind"), F.col("natural_key")))


def merged_registry(old: DataFrame, seen: DataFrame) -> DataFrame:
    """A registry brought up to date: the first run stays, the last run moves."""
    both = old.drop("runs").unionByName(registry(seen).drop("runs"))
    return both.groupBy("entity_kind", "natural_key").agg(F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"), F.min("stable_id").alias("stable_id"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys, or added; columns ``keep`` of rows that exist stay as they are."""
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("__old"))
    b = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("__new"))
    both = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("__new").isNull() | (F.lit(c in set(keep)) & F.col("__old").isNotNull()), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def page_sample(n: Column, most: int = 20, head: int = 4, tail: int = 4) -> Column:
    """Page numbers to look at: all of up to ``most`` pages, else the first, the last and evenly spaced ones between."""
    inner = most - head - tail
    # rounded half to even
    middle = F.transform(F.sequence(F.lit(1), F.lit(inner)), lambda i: (head + F.bround(i * (n - head - tail) / float(inner + 1))).cast("int"))
    long = F.concat(F.sequence(F.lit(1), F.lit(head)), middle, F.sequence(n - tail + 1, n))
    return F.when(n < 1, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array_sort(F.array_distinct(long)))


def _walk(path: str, parent: str | None, key: str, value, stop: frozenset[str], most: int) -> Iterator[tuple]:
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    exact = str(value) if kind == "number" and isinstance(value, int) and abs(value) > 1 << 53 else None  # more digits than a double holds
    yield path, parent, key, kind, value if kind == "string" else exact, float(value) if kind == "number" else None, value if kind == "boolean" else None
    if path in stop:
        return
    if kind == "object":
        for k, v in value.items():
            yield from _walk(f"{path}.{k}" if k.isidentifier() else f"{path}[{json.dumps(k, ensure_ascii=False)}]", path, k, v, stop, most)
    elif kind == "array" and not (len(value) > most and not any(isinstance(v, (dict, list)) for v in value)):
        for i, v in enumerate(value):
            yield from _walk(f"{path}[{i}]", path, str(i), v, stop, most)


def json_nodes(df: DataFrame, key: str, payload: str, stop: Iterable[str] = (), most: int = 64) -> DataFrame:
    """key, nth, path, parent, name, kind, text, number, truth: every node of a JSON document, in its order. text also has a whole number too long for a double.

    Paths begin with ``$``. Below the paths ``stop`` and in lists of more than ``most`` scalars nothing is expanded. A text
    that isn't JSON is one node of kind ``invalid``; null gives no rows.
    """
    kind, halt = df.schema[key].dataType.simpleString(), frozenset(stop)
    names = [key, "nth", "path", "parent", "name", "kind", "text", "number", "truth"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    nodes = _walk("$", None, "", json.loads(text), halt, most)
                except ValueError:
                    nodes = [("$", None, "", "invalid", text, None, None)]
                for nth, node in enumerate(nodes):
                    at.append(i), rows.append((nth, *node))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return df.select(key, payload).mapInArrow(run, f"`{key}` {kind}, nth int, path string, parent string, name string, kind string, text string, number double, truth boolean")


def cells(items: DataFrame, key: list[str], raw: str, named: dict[str, str]) -> DataFrame:
    """key, cell (from 0), value, role: the raw cells of each row; the role is that of the named column that the cell equals."""
    out = items.select(*key, *named.values(), F.posexplode(raw).alias("cell", "value"))
    role = F.lit("other")
    for r, c in reversed(list(named.items())):
        role = F.when(F.col("value") == F.col(c), r).otherwise(role)
    return out.select(*key, "cell", "value", role.alias("role"))
