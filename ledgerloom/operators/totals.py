"""Arithmetic verification of line items and of the totals that documents declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import MONEY, is_close


def _money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def verify_rows(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, row_index, quantity, unit_price, total_ht, total_ttc, total as decimals) with declared_total, computed_total,
    effective_total, total_source, difference and row_status.

    The declared total is the first there is of total, total_ht and total_ttc. A row without quantity or unit price is ignored; the others are ok if the declared total is
    within 0.02 of the computed one, partial without one, else mismatch. The effective total is the declared one if it is ok, else the computed one; an ignored row has none.
    """
    computed = _money(F.col("quantity") * F.col("unit_price"))
    declared = F.coalesce("total", "total_ht", "total_ttc")
    agree = is_close(computed, declared)
    status = F.when(computed.isNull(), "ignored_missing_qty_or_unit_price").when(declared.isNull(), "partial").when(agree, "ok").otherwise("mismatch")
    effective = F.when(F.coalesce(agree, F.lit(False)), declared).otherwise(computed)
    source = F.when(F.coalesce(agree, F.lit(False)), "declared+computed").when(computed.isNotNull(), "computed")
    return items.withColumns({"declared_total": declared, "computed_total": computed, "effective_total": effective, "total_source": source, "difference": (declared - computed).cast(MONEY), "row_status": status})


def pick_nearest(target: Column, amounts: Column) -> Column:
    """Of an array of amounts the nearest to the target, of equally near ones the smaller; null without a target."""
    return F.when(target.isNotNull(), F.array_min(F.transform(amounts, lambda v: F.struct(F.abs(v - target).alias("gap"), v.alias("v"))))["v"])


DECLARED = ("total_ht", "total_ttc", "total", "amount_due", "tax")


def verify_documents(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """doc_id, counts of row statuses, the subtotals, tax and totals computed and declared, the four checks and verification_status.

    ``declared``: doc_id and, as arrays of all amounts found for them, the columns ``DECLARED``. The declared subtotal is the total_ht, or without any the total,
    nearest to the sum of the rows; the declared total, of total_ttc, amount_due and total, the nearest to the subtotal from it upwards; the tax the nearest to
    their difference. Without a subtotal the largest ones count. A declared subtotal of 0 gives way to the computed one. Where rows were ignored and no row is wrong or partial, the
    sums cannot agree, so their mismatch counts as ok.
    """
    of = lambda s, name: F.count_if(F.col("row_status") == s).alias(name)
    sums = rows.groupBy("doc_id").agg(
        of("ok", "rows_ok"), of("mismatch", "rows_mismatch"), of("partial", "rows_partial"), of("ignored_missing_qty_or_unit_price", "rows_ignored"),
        F.count("effective_total").alias("rows_with_total"), F.sum("effective_total").cast(MONEY).alias("computed_subtotal"),
    )
    none = F.array().cast(f"array<{MONEY}>")
    d = sums.join(declared.select("doc_id", *DECLARED), "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in DECLARED})
    d = d.withColumn("declared_subtotal", pick_nearest(F.col("computed_subtotal"), F.when(F.size("total_ht") > 0, F.col("total_ht")).otherwise(F.col("total"))))
    zero = F.lit(0).cast(MONEY)
    d = d.withColumns({"__base": F.coalesce(F.nullif("declared_subtotal", zero), "computed_subtotal"), "__totals": F.concat("total_ttc", "amount_due", "total")})
    above = F.filter("__totals", lambda v: v >= F.col("__base"))
    d = d.withColumn("declared_total", F.when(F.col("__base").isNull(), F.array_max("__totals")).otherwise(pick_nearest(F.col("__base"), F.when(F.size(above) > 0, above).otherwise(F.col("__totals")))))
    gap = (F.col("declared_total") - F.col("__base")).cast(MONEY)
    d = d.withColumn("declared_tax", F.when(gap.isNull(), F.array_max("tax")).otherwise(pick_nearest(gap, F.col("tax"))))
    d = d.withColumns({"expected_total": (F.col("__base") + F.col("declared_tax")).cast(MONEY), "__tax": gap})
    calm = (F.col("rows_ignored") > 0) & (F.col("rows_with_total") > 0) & (F.col("rows_mismatch") == 0) & (F.col("rows_partial") == 0)

    def check(a: Column, b: Column, some: Column) -> Column:
        raw = F.when(is_close(a, b), "ok").when(a.isNotNull() & b.isNotNull(), "mismatch").when(some, "partial").otherwise("missing")
        return F.when(calm & raw.isin("mismatch", "partial"), "ok").otherwise(raw)

    known = lambda *cs: F.coalesce(*cs).isNotNull()
    d = d.withColumns({
        "rows_check": F.when((F.col("rows_mismatch") == 0) & (F.col("rows_with_total") > 0), "ok").when(F.col("rows_mismatch") > 0, "mismatch").otherwise("partial"),
        "subtotal_check": check(F.col("computed_subtotal"), F.col("declared_subtotal"), known("computed_subtotal", "declared_subtotal")),
        "tax_check": check(F.col("__tax"), F.col("declared_tax"), known("declared_tax")), "total_check": check(F.col("expected_total"), F.col("declared_total"), known("expected_total", "declared_total")),
    })
    checks = [F.col(c) for c in ("rows_check", "subtotal_check", "tax_check", "total_check")]
    bad, good = F.lit(False), F.lit(True)
    for c in checks:
        bad, good = bad | (c == "mismatch"), good & (c == "ok")
    return d.withColumn("verification_status", F.when(bad, "mismatch").when(good, "ok").otherwise("partial_ok")).drop("__base", "__totals", "__tax", *DECLARED)


def dominant_table(items: DataFrame) -> DataFrame:
    """doc_id, table_index: the table with the most of a document's rows, of equal ones the first; index 0 is no table."""
    counts = items.filter("table_index > 0").groupBy("doc_id", "table_index").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "table_index")).alias("m")).select("doc_id", "m.table_index")


def rollup(documents: DataFrame) -> DataFrame:
    """verification_status, documents, declared: how many documents came out how, and their declared totals."""
    return documents.groupBy("verification_status").agg(F.count("*").alias("documents"), F.sum("declared_total").alias("declared"))


def nearest(candidates: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, picked: of a document's candidate amounts the nearest to its target, of equally near ones the smaller."""
    both = candidates.join(target, "doc_id")
    return both.groupBy("doc_id").agg(F.min(F.struct(F.abs(F.col("amount") - F.col("target")).alias("gap"), F.col("amount"))).alias("m")).select("doc_id", F.col("m.amount").alias("picked"))


def issues(rows: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, row_index, row_status, expected, found: the rows that don't agree, ``most`` a document."""
    bad = rows.filter(F.col("row_status") == "mismatch")
    order = W.partitionBy("doc_id").orderBy("row_index")
    return bad.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("doc_id", "row_index", "row_status", F.col("computed_total").alias("expected"), F.col("declared_total").alias("found"))
