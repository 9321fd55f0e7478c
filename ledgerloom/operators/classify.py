"""Keyword-score classification of documents.

Rules are rows (doc_type, priority, bucket, keyword). A keyword's occurrences on a page, times its bucket's weight, times 1.2 on
the first page, cut to a whole number, add up to the type's score.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import classifier_normal

WEIGHTS = dict(strong=5, medium=2, weak=1, negative=-2, strong_negative=-5)
FIRST_PAGE, THRESHOLD, MARGIN, CONFUSION = 1.2, 6, 3, 5
RULES = [
    ("ENGLISH_PROSE", 3, "strong", "the"), ("ENGLISH_PROSE", 3, "medium", "with"), ("ENGLISH_PROSE", 3, "weak", "for"), ("ENGLISH_PROSE", 3, "negative", "les"), ("ENGLISH_PROSE", 3, "strong_negative", "und"),
    ("FRENCH_PROSE", 2, "strong", "les"), ("FRENCH_PROSE", 2, "medium", "pour"), ("FRENCH_PROSE", 2, "weak", "la"), ("FRENCH_PROSE", 2, "negative", "the"),
    ("GERMAN_PROSE", 2, "strong", "der"), ("GERMAN_PROSE", 2, "medium", "und"), ("GERMAN_PROSE", 2, "weak", "in"), ("GERMAN_PROSE", 2, "negative", "the"),
    ("SPANISH_PROSE", 1, "strong", "los"), ("SPANISH_PROSE", 1, "medium", "que"), ("SPANISH_PROSE", 1, "weak", "de"), ("SPANISH_PROSE", 1, "negative", "les"),
]


def rules_frame(spark: SparkSession, rules: Iterable[tuple] = RULES) -> DataFrame:
    """doc_type, priority, bucket, keyword in the form that texts are compared in; a few rows of configuration."""
    raw = spark.createDataFrame(list(rules), "doc_type string, priority int, bucket string, keyword string")
    return raw.withColumn("keyword", classifier_normal(F.col("keyword"))).filter("keyword <> ''")


def occurrences(normal: Column, keyword: Column) -> Column:
    """Whole-word occurrences; both sides are normalised, so a word is what stands between spaces."""
    return padded_occurrences(padded(normal), keyword)


def padded(normal: Column) -> Column:
    """A normalised text with two blanks between its words and one at either end."""
    return F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("  ")), F.lit(" "))


def padded_occurrences(padded: Column, keyword: Column) -> Column:
    needle = F.concat(F.lit(" "), F.replace(keyword, F.lit(" "), F.lit("  ")), F.lit(" "))
    return ((F.length(padded) - F.length(F.replace(padded, needle, F.lit("")))) / F.length(needle)).cast("int")


def keyword_hits(pages: DataFrame, rules: Iterable[tuple] = RULES, shared: bool = False) -> DataFrame:
    """doc_id, page_index, doc_type, priority, bucket, keyword, n, score for every keyword that occurs.

    The text is normalised and tokenised once a page; the rules are literals, so there is no join. ``shared``: what a page has is moved by document, a row a page, so that several
    results of the hits read the texts once.
    """
    rules = [(t, p, b, k) for t, p, b, k in rules]
    table = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.lit(p).alias("priority"), F.lit(b).alias("bucket"), classifier_normal(F.lit(k)).alias("keyword"), F.lit(WEIGHTS[b]).alias("weight")) for t, p, b, k in rules])
    normal = pages.select("doc_id", "page_index", padded(classifier_normal(F.col("text"))).alias("__padded"))
    hit = lambda r: F.struct(*[r[c].alias(c) for c in ("doc_type", "priority", "bucket", "keyword", "weight")], padded_occurrences(F.col("__padded"), r["keyword"]).alias("n"))
    counted = normal.select("doc_id", "page_index", F.filter(F.transform(table, hit), lambda r: r["n"] > 0).alias("hits"))
    counted = counted.repartition("doc_id") if shared else counted
    factor = F.when(F.col("page_index") == 1, FIRST_PAGE).otherwise(1.0)
    # outer, because below a plain generator the optimizer copies the whole expression into a filter
    found = counted.select("doc_id", "page_index", F.inline_outer("hits")).filter("n IS NOT NULL")
    return found.select("doc_id", "page_index", "doc_type", "priority", "bucket", "keyword", "n", (F.col("n") * F.col("weight") * factor).cast("int").alias("score"))


def scores(pages: DataFrame, rules: Iterable[tuple] = RULES) -> DataFrame:
    """doc_id, doc_type, priority, score summed over pages and keywords."""
    return scores_of(keyword_hits(pages, rules))


def scores_of(hits: DataFrame) -> DataFrame:
    """:func:`scores` of what :func:`keyword_hits` found."""
    return hits.groupBy("doc_id", "doc_type", "priority").agg(F.sum("score").alias("score"))


def with_confusion(scored: DataFrame, pages: DataFrame, confusions: dict[str, list[str]]) -> DataFrame:
    """Take 5 times the occurrences of other types' names off a type's score; 1.2 times that on first pages."""
    if not confusions:
        return scored
    rows = [(t, 0, "weak", other) for t, others in confusions.items() for other in others]
    factor = F.when(F.col("page_index") == 1, FIRST_PAGE).otherwise(1.0)
    malus = keyword_hits(pages, rows).groupBy("doc_id", "doc_type").agg(F.sum(F.col("n") * CONFUSION * factor).alias("malus"))
    return scored.join(malus, ["doc_id", "doc_type"], "left").withColumn("score", (F.col("score") - F.coalesce("malus", F.lit(0.0))).cast("int").cast("long")).drop("malus")


def types_of(rules: Iterable[tuple] = RULES) -> list[tuple[str, int]]:
    """(doc_type, priority) of every type that has a rule."""
    return sorted({(t, p) for t, p, *_ in rules})


def _ordered(docs: DataFrame, scored: DataFrame, types: list[tuple[str, int]]) -> DataFrame:
    """doc_id, ranks: all types with their score, 0 without a hit, by score, then priority, then name. One aggregation and one join by document."""
    one = lambda s, p, t: F.struct((-s).cast("long").alias("s"), (-p).cast("int").alias("p"), t.alias("doc_type"))
    own = scored.groupBy("doc_id").agg(F.collect_list(one(F.col("score"), F.col("priority"), F.col("doc_type"))).alias("own"))
    every = F.array(*[one(F.lit(0), F.lit(p), F.lit(t)) for t, p in types])
    met = F.coalesce(F.col("own"), F.array().cast("array<struct<s:bigint,p:int,doc_type:string>>"))
    missing = F.filter(every, lambda t: ~F.exists(met, lambda x: x["doc_type"] == t["doc_type"]))
    return docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.array_sort(F.concat(met, missing)).alias("ranks"))


def ranked(docs: DataFrame, scored: DataFrame, types: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, doc_type, priority, score, rank, is_winner: every type of every document, types without a hit with the score 0."""
    at = _ordered(docs, scored, types or types_of()).select("doc_id", F.posexplode("ranks").alias("at", "r"))
    return at.select("doc_id", "r.doc_type", (-F.col("r.p")).alias("priority"), (-F.col("r.s")).alias("score"), (F.col("at") + 1).alias("rank"), (F.col("at") == 0).alias("is_winner"))


def decisions(docs: DataFrame, scored: DataFrame, threshold: int = THRESHOLD, margin: int = MARGIN, types: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, doc_type, status, top_score, second_score, margin for every document.

    OK needs a score above 0, of at least the threshold and ``margin`` more than the second; everything else is UNCLASSIFIED and for REVIEW. Types without a hit
    take part with the score 0.
    """
    found = _ordered(docs, scored, types or types_of())
    top, second = -F.get("ranks", 0)["s"], F.coalesce(-F.get("ranks", 1)["s"], F.lit(0))
    ok = (top > 0) & (top >= threshold) & (top - second >= margin)
    return found.select("doc_id", F.when(ok, F.get("ranks", 0)["doc_type"]).otherwise("UNCLASSIFIED").alias("doc_type"), F.when(ok, "OK").otherwise("REVIEW").alias("status"), top.alias("top_score"), second.alias("second_score"), (top - second).alias("margin"))


def audit(pages: DataFrame, rules: Iterable[tuple] = RULES, most: int = 200) -> DataFrame:
    """doc_id, doc_type, bucket, keyword, n, score, rank: what made up each score, the weightiest first, ``most`` rows a document."""
    rows = keyword_hits(pages, rules).groupBy("doc_id", "doc_type", "bucket", "keyword").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    order = W.partitionBy("doc_id").orderBy(F.desc(F.abs("score")), F.desc("n"), "keyword", "bucket", "doc_type")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
