"""Field extraction by configured rules.

A rule is (field, rule_id, pattern, group, many, flags): regular expressions with Python's meaning, so that offsets and
flags are those the rules were written for. A label rule is (field, labels, detector): the value that stands behind a label on a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx

RULES = [
    ("email", "email-1", tx.EMAIL, 0, True, "a"),
    ("phone", "phone-1", r"(?<![0-9])\+?[0-9][0-9 .()/\-]{8,18}[0-9](?![0-9])", 0, True, ""),
    ("amount", "amount-1", r"([0-9]+(?:[.,][0-9]{2}))\s*(?:€|EUR|\$|USD)", 1, True, "i"),
    ("first_name", "name-1", r"\b([A-Z][a-z]{3,})\b", 1, False, ""),
    ("iban", "iban-1", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b", 0, True, ""),
]
ROUTES = {"INVOICE": ["invoice"], "ORDER": ["order"], "CONTRACT": ["contract"]}
LABELS = [("system_note", ["system", "note"], None), ("contact", ["contact", "mail"], "email"), ("amount", ["total", "montant", "amount"], "amount")]


def matches(pages: DataFrame, rules: Iterable[tuple] = RULES, around: int = 40) -> DataFrame:
    """doc_id, field, rule_id, page_index, match_no (from 1 within a page), value, start, end, snippet.

    A rule that isn't ``many`` keeps the first match of each page. Empty matches are left out. Null texts have none.
    """
    rules = [tuple(r) for r in rules]
    kind = pages.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "field", "rule_id", "page_index", "match_no", "value", "start", "end", "snippet"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(f, r, re.compile(p, sum(getattr(re, x.upper()) for x in flags)), g, many) for f, r, p, g, many, flags in rules]
        for batch in batches:
            at, rows = [], []
            for i, (page, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for field, rule, pattern, group, many in compiled if text else ():
                    nth = 0
                    for m in pattern.finditer(text):
                        a, b = m.span(group)
                        if a < 0 or a == b:
                            continue
                        nth += 1
                        at.append(i), rows.append((field, rule, page, nth, text[a:b], a, b, text[max(0, a - around) : b + around]))
                        if not many:
                            break
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return pages.select("doc_id", "page_index", "text").mapInArrow(run, f"doc_id {kind}, field string, rule_id string, page_index int, match_no int, value string, start int, end int, snippet string")


def fields(docs: DataFrame, found: DataFrame, rules: Iterable[tuple] = RULES) -> DataFrame:
    """doc_id, field, n, first_value: every field of the rules for every document, matched or not. The documents aren't shuffled for the absent ones."""
    names = sorted({r[0] for r in rules})
    every = docs.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field"), F.lit(0).alias("one"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("int").alias("start"))
    hits = found.select("doc_id", "field", F.lit(1).alias("one"), "value", "page_index", "start")
    return every.unionByName(hits).groupBy("doc_id", "field").agg(F.sum("one").alias("n"), F.min_by("value", F.when(F.col("one") == 1, F.struct("page_index", "start"))).alias("first_value"))


def routed(decided: DataFrame, routes: dict[str, list[str]] = ROUTES, common: str = "common") -> DataFrame:
    """doc_id, ruleset: a document's rule sets by its type, and the common one; types that are unknown or blank have the common one alone."""
    table = F.create_map(*[x for t, sets in routes.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in sets]))])
    own = F.coalesce(F.try_element_at(table, F.upper(F.trim(F.coalesce("doc_type", F.lit(""))))), F.array().cast("array<string>"))
    return decided.select("doc_id", F.explode(F.array_append(own, F.lit(common))).alias("ruleset"))


def routed_matches(pages: DataFrame, decided: DataFrame, sets: dict[str, list[tuple]], routes: dict[str, list[str]] = ROUTES, common: str = "common", around: int = 40) -> DataFrame:
    """:func:`matches` of only those rules whose rule set a page's document is routed to, with the column ruleset.

    The routes become one array for each document type, so that the pages are joined once with the decisions and never with the rules. A rule that two of a document's sets hold matches for both.
    """
    known = F.create_map(*[x for t, names in routes.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in [*names, common]]))]) if routes else F.lit(None).cast("map<string,array<string>>")
    own = F.array_distinct(F.coalesce(F.try_element_at(known, F.coalesce(F.upper(F.trim("doc_type")), F.lit(""))), F.array(F.lit(common))))
    chosen = pages.select("doc_id", "page_index", "text").join(decided.select("doc_id", own.alias("__sets")), "doc_id", "left")
    out = None
    for name, rules in sets.items():
        # a scan of its own for each set, over the documents routed to it alone
        mine = chosen.filter(F.array_contains(F.coalesce("__sets", F.array(F.lit(common))), name))
        found = matches(mine.drop("__sets"), rules, around).withColumn("ruleset", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def merged_rules(spark: SparkSession, *layers: dict[str, str]) -> list[tuple[str, str]]:
    """Rule sets merged in order: a later one's rule replaces an earlier one of the same field. Configuration only."""
    out: dict[str, str] = {}
    for layer in layers:
        out |= layer
    return sorted(out.items())


def label_values(lines: DataFrame, labels: Iterable[tuple] = LABELS, ahead: int = 1) -> DataFrame:
    """doc_id, line, field, label, value from lines (doc_id, line, text).

    The first label, in the order of the rule, that stands in the line, case and accents aside; its value is what comes after a
    ``:``, ``=`` or dash, else after the label; if that is empty, the next ``ahead`` line. A detector takes its first find instead.
    """
    plain = F.lower(tx.strip_accents(F.coalesce("text", F.lit(""))))
    order = W.partitionBy("doc_id").orderBy("line")
    base = lines.withColumn("__plain", plain).withColumn("__next", F.lead("text", ahead).over(order) if ahead else F.lit(None).cast("string"))
    out = None
    for field, names, detector in labels:
        names = [n.lower() for n in names]
        which = F.coalesce(*[F.when(F.col("__plain").contains(n), n) for n in names])
        hit = base.withColumn("label", which).filter(F.col("label").isNotNull())
        after = F.substr("text", F.instr("__plain", F.col("label")) + F.length("label"))
        value = tx.trimmed_value(F.regexp_replace(after, r"^[^:=\n]{0,20}?\s*[:=–—]\s*", ""))
        value = F.when(value == "", tx.trimmed_value(F.coalesce("__next", F.lit("")))).otherwise(value)
        if detector:
            value = F.coalesce(F.try_element_at(tx.detected(F.lit(detector), value), F.lit(1)), value)
        rows = hit.select("doc_id", "line", F.lit(field).alias("field"), "label", value.alias("value")).filter("value <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out
