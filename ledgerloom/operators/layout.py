"""Lines, chunks and layout kinds of page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

NUMBERED = r"^\s*[0-9]{1,3}(?:\.[0-9]{1,3})*[.)]?\s+\S"
LETTERED = r"^\s*(?:[A-Z]|[IVXLC]{1,6})[.)]\s+\S"
TABLE_HINTS = ("qty", "quantity", "quantite", "price", "prix", "total", "montant", "reference", "designation", "description")
_ROLES = ("header", "data", "plain")


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, line (from 0), text, start: the lines of each page and where they begin in it."""
    cut = pages.select("doc_id", "page_index", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    order = W.partitionBy("doc_id", "page_index").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return cut.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)))


def noise_lines(page_lines: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """doc_id, key, pages: lines, digits as ``#``, on at least ``least`` pages and ``share`` of them; only for documents of ``least`` pages or more."""
    key = F.regexp_replace(F.lower(F.trim("text")), "[0-9]+", "#")
    keyed = page_lines.select("doc_id", "page_index", key.alias("key"))
    n_pages = keyed.groupBy("doc_id").agg(F.countDistinct("page_index").alias("n_pages")).filter(F.col("n_pages") >= least)
    counted = keyed.filter("key <> ''").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("pages"))
    return counted.join(n_pages, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * F.lit(share).cast("decimal(4,2)")))).select("doc_id", "key", "pages")


def nonspace(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def is_noise(text: Column) -> Column:
    """Nothing but punctuation, or page marks such as ``3 / 12`` and ``Page 3``."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.rlike("[a-z0-9à-ÿ؀-ۿ]") | t.rlike(r"^(?:page\s*)?[0-9]{1,4}(?:\s*(?:/|of|sur)\s*[0-9]{1,4})?$")


def is_sentence(text: Column, structured: Column | None = None) -> Column:
    """At least 12 characters besides white space and no noise; one character is enough for structured kinds."""
    least = F.lit(12) if structured is None else F.when(structured, 1).otherwise(12)
    return (nonspace(text) >= least) & ~is_noise(text)


def line_and_column(text: Column, offset: Column) -> Column:
    """Struct line, col, both from 1, of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))


def chunk_style(text: Column) -> Column:
    """sections from two numbered or three lettered headings on; else paragraphs if there are blank lines; else sentences."""
    at = F.split(F.coalesce(text, F.lit("")), "\n")
    numbered, lettered = F.size(F.filter(at, lambda x: x.rlike(NUMBERED))), F.size(F.filter(at, lambda x: x.rlike(LETTERED)))
    return F.when((numbered >= 2) | (lettered >= 3), "sections").when(F.coalesce(text, F.lit("")).rlike(r"\n[ \t]*\n"), "paragraphs").otherwise("sentences")


def chunks(text: Column) -> Column:
    """The chunks of a text, cut by its :func:`chunk_style`."""
    t = F.coalesce(text, F.lit(""))
    heading = r"\n(?=\s*(?:[0-9]{1,3}(?:\.[0-9]{1,3})*[.)]?|(?:[A-Z]|[IVXLC]{1,6})[.)])\s+\S)"
    style = chunk_style(text)
    cut = F.when(style == "sections", F.split(t, heading)).when(style == "paragraphs", F.split(t, r"\n[ \t]*\n\s*")).otherwise(F.split(t, r"(?<=[.!?:;\n])\s+"))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def gaps(line: Column, least: int = 6) -> Column:
    """The number of runs of ``least`` blanks or more inside the line."""
    return F.regexp_count(F.trim(line), F.lit(rf" {{{least},}}"))


def is_table_line(line: Column, least_gap: int = 6) -> Column:
    """Two tabs or more, two table words, or two wide gaps and a number."""
    low = F.lower(F.coalesce(line, F.lit("")))
    hints = sum((low.contains(h).cast("int") for h in TABLE_HINTS), F.lit(0))
    return (F.regexp_count(low, F.lit("\t")) >= 2) | (hints >= 2) | ((gaps(low, least_gap) >= 2) & low.rlike("[0-9]"))


def segments(line: Column, least_gap: int = 6) -> Column:
    """The parts of a line between tabs and wide gaps."""
    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), rf"\t| {{{least_gap},}}"), lambda x: F.trim(x)), lambda x: x != "")


def layout_kind(line: Column, least_gap: int = 6) -> Column:
    return F.when(is_table_line(line, least_gap), "table").when(F.size(segments(line, least_gap)) >= 2, "multicol").otherwise("plain")


def key_value(line: Column) -> Column:
    """``key   value`` with two blanks or more between as ``key: value``; other lines as they are."""
    return F.regexp_replace(line, r"^(\s*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9 .'/-]{0,40}?)\s*:?[ \t]{2,}(\S.*)$", "$1: $2")


def blocks(page_lines: DataFrame, least_gap: int = 6) -> DataFrame:
    """doc_id, page_index, block (from 1), kind, first_line, last_line, text: neighbouring lines of one kind; blank lines end plain blocks only."""
    order = W.partitionBy("doc_id", "page_index").orderBy("line")
    full = page_lines.withColumn("kind", layout_kind(F.col("text"), least_gap)).filter(F.trim("text") != "")
    parted = (F.lag("kind").over(order) != F.col("kind")) | ((F.col("kind") == "plain") & (F.col("line") - F.lag("line").over(order) > 1))
    marked = full.withColumn("block", F.sum(F.coalesce(parted.cast("int"), F.lit(1))).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return marked.groupBy("doc_id", "page_index", "block").agg(F.first("kind").alias("kind"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), text.alias("text"))


def language_runs(pieces: DataFrame, order_by: str, lang: str) -> DataFrame:
    """doc_id, run (from 1), lang, first, last, n: neighbouring pieces of one language."""
    order = W.partitionBy("doc_id").orderBy(order_by)
    marked = pieces.withColumn("run", F.sum(F.coalesce((F.lag(lang).over(order) != F.col(lang)).cast("int"), F.lit(1))).over(order))
    return marked.groupBy("doc_id", "run").agg(F.first(lang).alias("lang"), F.min(order_by).alias("first"), F.max(order_by).alias("last"), F.count("*").alias("n"))
