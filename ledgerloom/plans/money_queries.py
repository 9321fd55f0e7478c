"""Queries that verify line items against their arithmetic and documents against what they declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import MONEY
from ..operators import totals
from .common import query, table

#: Line items as an invoice reader would find them: the unit price cut to cents, some cells unread, some rows blank.
_ITEMS = """WITH items AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_index,
        CASE WHEN NOT blank AND l_partkey % 13 <> 0 THEN CAST(l_quantity AS DECIMAL(18,3)) END AS quantity,
        CASE WHEN NOT blank THEN CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,2)) END AS unit_price,
        CASE WHEN NOT blank AND l_partkey % 11 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_ht,
        CASE WHEN NOT blank AND l_partkey % 22 = 0 THEN CAST(floor(l_extendedprice * 120) / 100 AS DECIMAL(18,2)) END AS total_ttc,
        CASE WHEN NOT blank AND l_partkey % 33 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total
    FROM (SELECT *, l_orderkey % 29 = 0 AND l_linenumber = 1 AS blank FROM lineitem)),
    r AS (SELECT *, CAST(quantity * unit_price AS DECIMAL(18,2)) AS c, coalesce(total, total_ht, total_ttc) AS dcl FROM items),
    q AS (SELECT *, CASE WHEN c IS NULL THEN 'ignored_missing_qty_or_unit_price' WHEN dcl IS NULL THEN 'partial' WHEN abs(c - dcl) <= 0.02 THEN 'ok' ELSE 'mismatch' END AS row_status FROM r),
    rows_checked AS (SELECT *, CASE WHEN row_status = 'ok' THEN dcl ELSE c END AS e, CASE WHEN row_status = 'ok' THEN 'declared+computed' WHEN c IS NOT NULL THEN 'computed' END AS total_source FROM q)"""
#: What the orders declare, made from their lines, with other amounts beside the right ones: off by 0.05 for every seventh, silent for every eleventh, a subtotal of 0 for every thirteenth.
_DECLARED = """, base AS (SELECT doc_id, s, CAST(floor(CAST(s AS DOUBLE) * 20) / 100 AS DECIMAL(18,2)) AS t FROM (SELECT doc_id, CAST(coalesce(sum(e), 0) AS DECIMAL(18,2)) AS s FROM rows_checked GROUP BY 1)),
    declared AS (SELECT doc_id, CAST(CASE WHEN doc_id % 11 = 0 THEN [] WHEN doc_id % 13 = 0 THEN [0.00] WHEN doc_id % 5 = 0 THEN [s + 40, s, s - 30] ELSE [s] END AS DECIMAL(18,2)[]) AS total_ht,
        CAST(CASE WHEN doc_id % 4 = 0 THEN [s + t] ELSE [] END AS DECIMAL(18,2)[]) AS total_ttc, CAST(CASE WHEN doc_id % 11 = 0 THEN [] WHEN doc_id % 7 = 0 THEN [s + t + 0.05] ELSE [s + t, s - 1] END AS DECIMAL(18,2)[]) AS total,
        CAST(CASE WHEN doc_id % 9 = 0 THEN [s + t, 3.00] ELSE [] END AS DECIMAL(18,2)[]) AS amount_due, CAST(CASE WHEN doc_id % 3 = 0 THEN [t, t + 5] ELSE [] END AS DECIMAL(18,2)[]) AS tax FROM base)"""


def _nearest(target: str, amounts: str) -> str:
    return f"list_sort(list_transform({amounts}, lambda v: {{'gap': abs(v - {target}), 'v': v}}))[1].v"


def _check(a: str, b: str, some: str) -> str:
    raw = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN abs({a} - {b}) <= 0.02 THEN 'ok' ELSE 'mismatch' END WHEN {some} THEN 'partial' ELSE 'missing' END"
    return f"CASE WHEN calm AND {raw} IN ('mismatch', 'partial') THEN 'ok' ELSE {raw} END"


_CHECKED = f"""{_ITEMS}{_DECLARED},
    sums AS (SELECT doc_id, count(*) FILTER (row_status = 'ok') AS rows_ok, count(*) FILTER (row_status = 'mismatch') AS rows_mismatch, count(*) FILTER (row_status = 'partial') AS rows_partial, count(*) FILTER (row_status LIKE 'ignored%') AS rows_ignored,
        count(e) AS rows_with_total, CAST(sum(e) AS DECIMAL(18,2)) AS cs FROM rows_checked GROUP BY 1),
    j1 AS (SELECT s.*, d.*, CASE WHEN cs IS NOT NULL THEN {_nearest("cs", "CASE WHEN len(total_ht) > 0 THEN total_ht ELSE total END")} END AS ds, list_concat(list_concat(total_ttc, amount_due), total) AS totals FROM sums s LEFT JOIN (SELECT doc_id AS d_id, * EXCLUDE doc_id FROM declared) d ON s.doc_id = d_id),
    j2 AS (SELECT *, coalesce(nullif(ds, 0), cs) AS base FROM j1),
    j3 AS (SELECT *, CASE WHEN base IS NULL THEN list_max(totals) ELSE {_nearest("base", "CASE WHEN len(list_filter(totals, lambda v: v >= base)) > 0 THEN list_filter(totals, lambda v: v >= base) ELSE totals END")} END AS dt FROM j2),
    j4 AS (SELECT *, CAST(dt - base AS DECIMAL(18,2)) AS ct, CASE WHEN dt - base IS NULL THEN list_max(tax) ELSE {_nearest("(dt - base)", "tax")} END AS dx FROM j3),
    j5 AS (SELECT *, CAST(base + dx AS DECIMAL(18,2)) AS et, rows_ignored > 0 AND rows_with_total > 0 AND rows_mismatch = 0 AND rows_partial = 0 AS calm FROM j4),
    k AS (SELECT *, CASE WHEN rows_mismatch = 0 AND rows_with_total > 0 THEN 'ok' WHEN rows_mismatch > 0 THEN 'mismatch' ELSE 'partial' END AS rows_check, {_check("cs", "ds", "coalesce(cs, ds) IS NOT NULL")} AS subtotal_check,
        {_check("ct", "dx", "dx IS NOT NULL")} AS tax_check, {_check("et", "dt", "coalesce(et, dt) IS NOT NULL")} AS total_check FROM j5),
    documents_checked AS (SELECT *, CASE WHEN 'mismatch' IN (rows_check, subtotal_check, tax_check, total_check) THEN 'mismatch' WHEN rows_check = 'ok' AND subtotal_check = 'ok' AND tax_check = 'ok' AND total_check = 'ok' THEN 'ok' ELSE 'partial_ok' END AS verification_status FROM k)"""


def line_items(spark, d):
    """The line items of ``_ITEMS``."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    live = ~((F.col("l_orderkey") % 29 == 0) & (F.col("l_linenumber") == 1))
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    some = lambda when, value, kind=MONEY: F.when(live & when, value.cast(kind))
    return x.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_index"), some(part % 13 != 0, F.col("l_quantity"), "decimal(18,3)").alias("quantity"),
        some(F.lit(True), F.floor(price * 100 / F.col("l_quantity")) / 100).alias("unit_price"), some(part % 11 != 0, price).alias("total_ht"),
        some(part % 22 == 0, F.floor(price * 120) / 100).alias("total_ttc"), some(part % 33 == 0, price).alias("total"),
    )


def declared_totals(rows):
    """The amounts of ``_DECLARED``."""
    key, s, t = F.col("doc_id"), F.col("s"), F.col("t")
    base = rows.groupBy("doc_id").agg(F.coalesce(F.sum("effective_total"), F.lit(0)).cast(MONEY).alias("s")).withColumn("t", (F.floor(F.col("s").cast("double") * 20) / 100).cast(MONEY))
    amounts = lambda *xs: F.array(*xs).cast(f"array<{MONEY}>")
    return base.select(
        "doc_id", F.when(key % 11 == 0, amounts()).when(key % 13 == 0, amounts(F.lit(0))).when(key % 5 == 0, amounts(s + 40, s, s - 30)).otherwise(amounts(s)).alias("total_ht"), F.when(key % 4 == 0, amounts(s + t)).otherwise(amounts()).alias("total_ttc"),
        F.when(key % 11 == 0, amounts()).when(key % 7 == 0, amounts(s + t + F.lit("0.05").cast(MONEY))).otherwise(amounts(s + t, s - 1)).alias("total"), F.when(key % 9 == 0, amounts(s + t, F.lit(3))).otherwise(amounts()).alias("amount_due"), F.when(key % 3 == 0, amounts(t, t + 5)).otherwise(amounts()).alias("tax"),
    )


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("row_verify", f"{_ITEMS} SELECT doc_id, row_index, CAST(dcl AS DOUBLE) AS declared_total, CAST(c AS DOUBLE) AS computed_total, CAST(e AS DOUBLE) AS effective_total, CAST(dcl - c AS DOUBLE) AS difference, total_source, row_status FROM rows_checked")
def row_verify(spark, d):
    rows = totals.verify_rows(line_items(spark, d)).select("doc_id", "row_index", "declared_total", "computed_total", "effective_total", "difference", "total_source", "row_status")
    return _doubles(rows, "declared_total", "computed_total", "effective_total", "difference")


_FOUND = ("computed_subtotal", "declared_subtotal", "declared_total", "declared_tax", "expected_total")


@query("order_totals_verify", f"""{_CHECKED} SELECT doc_id, rows_ok, rows_mismatch, rows_partial, rows_ignored, rows_with_total, CAST(cs AS DOUBLE) AS computed_subtotal, CAST(ds AS DOUBLE) AS declared_subtotal, CAST(dt AS DOUBLE) AS declared_total, CAST(dx AS DOUBLE) AS declared_tax,
    CAST(et AS DOUBLE) AS expected_total, rows_check, subtotal_check, tax_check, total_check, verification_status FROM documents_checked""")
def order_totals_verify(spark, d):
    rows = totals.verify_rows(line_items(spark, d))
    return _doubles(totals.verify_documents(rows, declared_totals(rows)), *_FOUND)


@query("verify_rollup", f"{_CHECKED} SELECT verification_status, count(*) AS documents, CAST(sum(dt) AS DOUBLE) AS declared FROM documents_checked GROUP BY 1")
def verify_rollup(spark, d):
    rows = totals.verify_rows(line_items(spark, d))
    return _doubles(totals.rollup(totals.verify_documents(rows, declared_totals(rows))), "declared")


@query("verify_issues", f"""{_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_index) AS nth FROM rows_checked WHERE row_status = 'mismatch')
    SELECT doc_id, row_index, row_status, CAST(c AS DOUBLE) AS expected, CAST(dcl AS DOUBLE) AS found FROM n WHERE nth <= 100""")
def verify_issues(spark, d):
    return _doubles(totals.issues(totals.verify_rows(line_items(spark, d))), "expected", "found")


@query("dominant_table", """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS table_index, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, table_index) AS nth FROM c WHERE table_index > 0)
    SELECT doc_id, table_index FROM r WHERE nth = 1""")
def dominant_table(spark, d):
    return totals.dominant_table(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("table_index")))


@query("nearest_total_pick", """WITH c AS (SELECT l_orderkey AS doc_id, l_extendedprice AS amount, o_totalprice / 4 AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(amount - target), amount) AS nth FROM c) SELECT doc_id, amount AS picked FROM r WHERE nth = 1""")
def nearest_total_pick(spark, d):
    candidates = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("amount"))
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 4).alias("target"))
    return totals.nearest(candidates, target)
