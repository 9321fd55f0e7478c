"""Tables and line items in page texts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as nb, text as tx

SYNONYMS = {
    "reference": ("reference", "ref", "code", "article code", "sku"),
    "product": ("designation", "description", "product", "article", "libelle", "item"),
    "quantity": ("quantity", "qty", "quantite", "qte"),
    "unit_price": ("unit price", "price", "prix unitaire", "pu", "p u", "prix"),
    "total_ht": ("total ht", "montant ht", "amount", "net amount"),
    "total_ttc": ("total ttc", "montant ttc", "gross amount"),
    "total": ("total", "montant", "line total"),
}
LEAST_HEADER = 0.82
_ANY_SYNONYM = r"\b(?:" + "|".join(sorted({s for names in SYNONYMS.values() for s in names}, key=len, reverse=True)) + r")\b"
_FOOTER = ("IBAN", "BIC", "SIRET", "PAGE", "THANK YOU", "MERCI", "CONDITIONS")


def split_cells(line: Column) -> Column:
    """Cells between ``|``, else tabs, else two blanks or more, else ``;``; a line without any is one cell."""
    line = F.coalesce(line, F.lit(""))
    cut = F.when(line.contains("|"), F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")).when(line.contains("\t"), F.split(line, "\t")).when(F.trim(line).rlike(r"\S {2,}\S"), F.split(F.trim(line), " {2,}")).when(line.contains(";"), F.split(line, ";")).otherwise(F.array(line))
    return F.transform(cut, lambda c: F.trim(c))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def header_score(t: Column, synonym: str) -> Column:
    """Of a cell in lower case without accents and marks: 1 for the synonym itself, 0.93 if it begins with it, 0.85 if it has it as words."""
    return F.when(t == synonym, 1.0).when(t.startswith(synonym + " "), 0.93).when(F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {synonym} "), 0.85).otherwise(0.0)


def header_role(cell: Column, least: float = LEAST_HEADER) -> Column:
    """The role of the best synonym, of equal ones the longest and then the first; null under ``least``."""
    plain = F.lower(F.trim(F.regexp_replace(tx.strip_accents(F.coalesce(cell, F.lit(""))), "[^A-Za-z0-9]+", " ")))

    def best(t: Column) -> Column:
        every = [F.struct((-header_score(t, s)).alias("score"), F.lit(-len(s)).alias("size"), F.lit(i).alias("at"), F.lit(role).alias("role")) for i, (role, names) in enumerate(SYNONYMS.items()) for s in names]
        return _once(F.array_min(F.array(*every)), lambda x: F.when(x["score"] <= -least, x["role"]))

    return F.when(plain.rlike(_ANY_SYNONYM), _once(plain, best))


def totals_key(line: Column) -> Column:
    """Which total a line states, the first of TTC, HT, stamp, due, tax, total, wherever in the line its words stand; null for other lines."""

    def first(t: Column) -> Column:
        has = lambda *words: t.rlike("|".join(w.replace(".", "[.]") for w in words))
        return (
            F.when(has("TOTAL TTC", "MONTANT A PAYER TTC") | (has("TTC") & has("TOTAL")), "total_ttc").when(has("TOTAL HT", "MONTANT HT", "SUBTOTAL", "SOUS TOTAL") | (has("HT") & has("TOTAL")), "total_ht")
            .when(has("TIMBRE", "STAMP"), "stamp").when(has("MONTANT A PAYER", "TOTAL A PAYER", "AMOUNT DUE", "TOTAL DUE"), "amount_due").when(has("TVA", "VAT", "TAX"), "tax").when(has("TOTAL", "MONTANT", "AMOUNT"), "total")
        )

    return _once(tx.table_normal(line), first)


#: What a label calls a total, in the order in which it is looked for.
TOTAL_LABELS = (
    ("total_ttc", ("MONTANT A PAYER TTC", "MONTANT TTC", "TOTAL A PAYER TTC", "TOTAL TTC")), ("total_ht", ("MONTANT HT", "SOUS TOTAL", "SUBTOTAL", "TOTAL H.T", "TOTAL HT")),
    ("amount_due", ("AMOUNT DUE", "MONTANT A PAYER", "TOTAL A PAYER", "TOTAL DUE")), ("stamp", ("STAMP", "TIMBRE")), ("tax", ("TAX", "TVA", "VAT")), ("total", ("AMOUNT", "MONTANT", "TOTAL")),
)


def label_key(label: Column) -> Column:
    """Which total a label names, by ``TOTAL_LABELS``; null if none."""
    return _once(tx.table_normal(label), lambda t: F.coalesce(*[F.when(t.rlike("|".join(n.replace(".", "[.]") for n in names)), key) for key, names in TOTAL_LABELS]))


def labelled_totals(lines: DataFrame) -> DataFrame:
    """doc_id, key, label, amount: the distinct labels and amounts of lines (doc_id, text) that end in an amount after a label."""
    label = F.trim(F.regexp_extract("text", r"^(.*?[A-Za-z.%)])\s*[:=]?\s*[-+]?[0-9][0-9 .,]*\s*(?:EUR|USD|DZD|€|\$)?\s*$", 1))
    found = lines.select("doc_id", label.alias("label"), nb.amount(F.col("text")).alias("amount")).filter("label <> '' AND amount IS NOT NULL")
    return found.withColumn("key", label_key(F.col("label"))).filter("key IS NOT NULL").select("doc_id", "key", "label", "amount").distinct()


def totals(lines: DataFrame) -> DataFrame:
    """doc_id, key, amounts: the distinct amounts of each kind of totals line, in the order of the lines (doc_id, page_index, line, text)."""
    found = lines.select("doc_id", "page_index", "line", totals_key(F.col("text")).alias("key"), nb.amount(F.col("text")).alias("amount")).filter("key IS NOT NULL AND amount IS NOT NULL")
    first = found.groupBy("doc_id", "key", "amount").agg(F.min(F.struct("page_index", "line")).alias("at"))
    return first.groupBy("doc_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "amount"))), lambda s: s["amount"]).alias("amounts"))


def columns_inferred(rows: DataFrame, cells: str) -> DataFrame:
    """doc_id, position (from 0), n, numeric, code, letters, kind of each column: numeric from 0.55 of its cells, code from 0.6, else text."""
    cell = F.col("cell")
    each = rows.select("doc_id", F.posexplode(cells).alias("position", "cell")).filter(F.trim("cell") != "")
    code, letters = tx.is_code_like(cell) & ~nb.is_numeric_like(cell), F.length(F.regexp_replace("cell", "[^A-Za-z]", "")) / F.length("cell")
    out = each.groupBy("doc_id", "position").agg(F.count("*").alias("n"), F.avg(nb.is_numeric_like(cell).cast("int")).alias("numeric"), F.avg(code.cast("int")).alias("code"), F.avg(letters).alias("letters"))
    return out.withColumn("kind", F.when(F.col("numeric") >= 0.55, "numeric").when(F.col("code") >= 0.6, "code").otherwise("text"))


def table_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with cells, header_roles (a header has two roles or more), totals_key and is_footer."""
    roles = F.transform("cells", lambda c: header_role(c))
    t = F.concat(F.lit(" "), tx.classifier_normal(F.col("text")), F.lit(" "))
    out = lines.withColumn("cells", split_cells(F.col("text")))
    header = _once(roles, lambda r: F.when(F.size(F.array_distinct(F.filter(r, lambda x: x.isNotNull()))) >= 2, r))
    likely = F.lower(tx.strip_accents("text")).rlike(_ANY_SYNONYM)
    return out.withColumns({"header_roles": F.when(likely, header), "totals_key": totals_key(F.col("text")), "is_footer": t.rlike(f" (?:{'|'.join(_FOOTER)}) ")})


def line_items(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, table_index, row_index, reference, product, quantity, unit_price, total_ht, total_ttc, total, raw_cells, confidence.

    A header line opens a table, a totals or footer line or two blank lines close it; rows of other widths close nothing but are passed over. The header of
    a row is the last one above it: a running maximum over the page's lines. A row needs a reference or product, a quantity and a unit price.
    """
    from pyspark.sql import Window as W

    marked = table_lines(lines)
    order = W.partitionBy("doc_id", "page_index").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    opens, blank = F.col("header_roles").isNotNull(), F.trim("text") == ""
    twice = blank & F.coalesce(F.lag(blank, 1).over(W.partitionBy("doc_id", "page_index").orderBy("line")), F.lit(False))
    shuts = F.col("totals_key").isNotNull() | F.col("is_footer") | F.col("__twice")
    marked = marked.withColumn("__twice", twice)
    marked = marked.withColumns({
        "__open": F.max(F.when(opens, F.struct("line", "header_roles"))).over(order), "__shut": F.max(F.when(shuts & ~opens, F.col("line"))).over(order),
        "table_index": F.count(F.when(opens, 1)).over(order),
    })
    inside = marked.filter(F.col("__open").isNotNull() & ~opens & ~blank & (F.coalesce("__shut", F.lit(-1)) < F.col("__open.line")) & (F.size("cells") == F.size("__open.header_roles")))
    named = inside.withColumn("__roles", F.transform("__open.header_roles", lambda r: F.coalesce(r, F.lit(""))))
    # the first column of each role; a cell that isn't there has no amount
    cell = lambda role: F.nullif(F.get("cells", F.array_position("__roles", F.lit(role)).cast("int") - 1), F.lit(""))
    read = lambda of, role: _once(cell(role), lambda c: F.when(c.isNotNull(), of(c)))
    found = F.struct(
        cell("reference").alias("reference"), cell("product").alias("product"), read(nb.quantity, "quantity").alias("quantity"), *[read(nb.amount, r).alias(r) for r in ("unit_price", "total_ht", "total_ttc", "total")],
    )
    complete = lambda r: (r["reference"].isNotNull() | r["product"].isNotNull()) & r["quantity"].isNotNull() & r["unit_price"].isNotNull()
    # outer, because a filter above would have every cell read once more below it
    out = named.select("doc_id", "page_index", "table_index", "line", F.inline_outer(F.filter(F.array(found), complete)), F.col("cells").alias("raw_cells")).filter("quantity IS NOT NULL")
    some = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    total = F.when(F.coalesce("total_ht", "total", "total_ttc").isNotNull(), 0.2).otherwise(0.0)
    confidence = F.round(some("reference", 0.15) + some("product", 0.25) + some("quantity", 0.2) + some("unit_price", 0.2) + total, 2)
    row = F.row_number().over(W.partitionBy("doc_id", "page_index", "table_index").orderBy("line"))
    return out.withColumn("confidence", confidence).withColumn("row_index", row).drop("line")



def dense_rows(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, line, product, quantity, unit_price, total from lines whose cells only single blanks part: text, quantity, price and perhaps a total at the end."""
    tail = r"^(.*?\S)\s+([0-9]+(?:[.,][0-9]{1,3})?)\s+([0-9]+[.,][0-9]{2})(?:\s+([0-9]+[.,][0-9]{2}))?\s*$"
    part = lambda i: F.regexp_extract("text", tail, i)
    found = lines.filter(F.col("text").rlike(tail) & ~F.col("text").rlike(r"\t|\||\S {2,}\S"))
    return found.select("doc_id", "page_index", "line", part(1).alias("product"), nb.quantity(part(2)).alias("quantity"), nb.amount(part(3)).alias("unit_price"), nb.amount(F.nullif(part(4), F.lit(""))).alias("total"))


def table_metrics(items: DataFrame) -> DataFrame:
    """doc_id, table_index, n_rows, numeric_rows, codes, rich: what the pruning of redundant tables goes by."""
    numeric = F.coalesce("total_ht", "total", "total_ttc").isNotNull()
    return items.groupBy("doc_id", "table_index").agg(F.count("*").alias("n_rows"), F.count_if(numeric).alias("numeric_rows"), F.array_sort(F.collect_set("reference")).alias("codes")).withColumn("rich", F.col("numeric_rows") >= 2)
