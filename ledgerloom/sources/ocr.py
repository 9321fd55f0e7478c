"""Word boxes of an OCR engine as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lines_of_words(words: DataFrame, key: str = "page_id") -> DataFrame:
    """key, line (from 1), text, confidence from words (key, text, left, top, width, height, conf).

    Words of negative confidence and blank ones go. A word whose top lies more than max(6, 0.55 median heights) below the word before it begins a line; the
    gap between words, over the median character width, gives the blanks.
    """
    real = words.filter((F.col("conf") >= 0) & (F.trim("text") != ""))
    page = real.groupBy(key).agg(F.percentile("height", 0.5).alias("h"), F.percentile(F.col("width") / F.greatest(F.length("text"), F.lit(1)), 0.5).alias("w"))
    down = W.partitionBy(key).orderBy("top", "left")
    placed = real.join(page, key).withColumn("fresh", F.coalesce((F.col("top") - F.lag("top").over(down) > F.greatest(F.lit(6.0), 0.55 * F.col("h"))).cast("int"), F.lit(1)))
    placed = placed.withColumn("line", F.sum("fresh").over(down))
    across = W.partitionBy(key, "line").orderBy("left", "top")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(across)
    blanks = F.when(gap.isNull(), 0).otherwise(F.greatest(F.lit(1), F.round(gap / F.greatest(F.col("w"), F.lit(1.0))).cast("int")))
    spaced = placed.withColumn("part", F.concat(F.repeat(F.lit(" "), blanks), F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "top", "part"))), lambda s: s["part"]), "")
    return spaced.groupBy(key, "line").agg(text.alias("text"), F.round(F.avg("conf"), 2).alias("confidence"))


def parsed_tsv(text: Column) -> Column:
    """An OCR engine's table of tab-separated words as an array of structs."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.size(F.split(r, "\t")) >= 12)
    cell = lambda r, i: F.get(F.split(r, "\t"), F.lit(i))
    whole = lambda r, i: cell(r, i).try_cast("int")
    parsed = F.transform(rows, lambda r: F.struct(whole(r, 6).alias("left"), whole(r, 7).alias("top"), whole(r, 8).alias("width"), whole(r, 9).alias("height"), cell(r, 10).try_cast("double").alias("conf"), cell(r, 11).alias("text")))
    return F.filter(parsed, lambda s: s["left"].isNotNull())


def otsu_threshold(histogram: DataFrame, key: str = "page_id") -> DataFrame:
    """key, threshold: the grey level (key, level, n) that parts dark from light with the greatest variance between; of equal ones the lowest."""
    upto = W.partitionBy(key).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    sums = histogram.select(key, "level", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0)), F.lit(2))).otherwise(0.0)
    return sums.groupBy(key).agg(F.min(F.struct((-between).alias("v"), F.col("level"))).alias("m")).select(key, F.col("m.level").alias("threshold"))
