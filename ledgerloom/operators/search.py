"""Search records of documents, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx

MOST_WORDS, PAGE, TOKEN_BUDGET = 12_000, 2_000, 200_000


def search_documents(pages: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, pages, passages, words, full_text. pages by number; passages are the pages' sentences; words the distinct ones in order of
    appearance, ``most_words`` at most; full_text the pages with a blank line between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_index", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"])
    packed = pages.groupBy("doc_id").agg(ordered.alias("pages"))
    passages = F.flatten(F.transform("pages", tx.sentences))
    words = F.slice(F.array_distinct(F.flatten(F.transform("pages", tx.words))), 1, most_words)
    return packed.select("doc_id", "pages", passages.alias("passages"), words.alias("words"), F.array_join("pages", "\n\n").alias("full_text"))


def restored_pages(search_docs: DataFrame) -> DataFrame:
    """doc_id, page_index, text back from search records: the pages, else the passages, else the full text, else the words as one page."""
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c))
    some = lambda c: F.when(F.exists(c, lambda x: F.trim(x) != ""), F.col(c))
    pages = F.coalesce(some("pages"), one(F.array_join("passages", "\n")), one(F.col("full_text")), one(F.array_join("words", " ")), F.array().cast("array<string>"))
    return search_docs.select("doc_id", F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_index"), "text")


def by_ids(search_docs: DataFrame, ids: DataFrame) -> DataFrame:
    return search_docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def with_term(docs: DataFrame, text: str, term: str) -> DataFrame:
    """The rows that have ``term`` as a word, case aside."""
    return docs.filter(F.array_contains(tx.words(F.col(text)), term.lower()))


def with_phrase(docs: DataFrame, text: str, phrase: str) -> DataFrame:
    """The rows in which the phrase's words follow each other, whatever stands between words."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(tx.words(c), " "), F.lit(" "))
    return docs.filter(spaced(F.col(text)).contains(spaced(F.lit(phrase))))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The next ``size`` rows in the order of ``keys`` after the row with the values ``after``."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, after):
            beyond = beyond | (equal & (F.col(k) > v))
            equal = equal & (F.col(k) == v)
        df = df.filter(beyond)
    return df.orderBy(*keys).limit(size)


def token_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def within_budget(per_document: DataFrame, order: str, size: str, budget: int = TOKEN_BUDGET, fan: int = 1024) -> DataFrame:
    """``per_document`` with within: whether all up to this document, in the whole number ``order``, have at most ``budget`` tokens together.

    Sums go up level by level, ``fan`` ranges of the level below to one, until one range holds all, and come down as sums of all that lies before; no
    window takes in more than ``fan`` rows.
    """
    low, high = per_document.agg(F.min(order), F.max(order)).first()
    depth, span = 1, fan
    low, high = (0, 0) if low is None else (low, high)
    while high - low >= span:
        depth, span = depth + 1, span * fan
    cell = lambda level: F.floor((F.col(order) - low) / F.lit(fan**level)).cast("long")
    sums = [per_document.groupBy(cell(1).alias("c1")).agg(F.sum(size).alias("n1"))]
    for level in range(2, depth + 1):
        sums.append(sums[-1].groupBy(F.floor(F.col(f"c{level - 1}") / fan).cast("long").alias(f"c{level}")).agg(F.sum(f"n{level - 1}").alias(f"n{level}")))
    earlier = lambda by, c, n: F.coalesce(F.sum(n).over(W.partitionBy(by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sums[-1].select(F.col(f"c{depth}"), F.lit(0).alias(f"b{depth}"))
    for level in range(depth - 1, 0, -1):
        own = sums[level - 1].withColumn(f"c{level + 1}", F.floor(F.col(f"c{level}") / fan).cast("long"))
        before = own.join(before, f"c{level + 1}").select(f"c{level}", (F.col(f"b{level + 1}") + earlier(f"c{level + 1}", f"c{level}", f"n{level}")).alias(f"b{level}"))
    inner = F.sum(size).over(W.partitionBy("__c1").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    both = per_document.withColumn("__c1", cell(1)).join(before.select(F.col("c1").alias("__c1"), F.col("b1").alias("__b1")), "__c1")
    return both.withColumn("within", F.col("__b1") + inner <= budget).drop("__c1", "__b1")
