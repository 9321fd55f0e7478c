"""Rows of one source brought together with those of another: lookups by id or name, best copies, sources of values, merged languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx

NOISE_POS = "ADV CC CCONJ CONJ DET DT EX IN INTJ MD PART PDT POS PRON PRP PRP$ PUNCT RB RBR RBS RP SCONJ SYM TO UH WDT WP WP$ ADP AUX".split()
IMAGE_SUFFIXES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def base_name(path: Column) -> Column:
    """The last part of a path or URL in lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", ""), r"([^/\\]*)$", 1))


def paths_by_name(rows: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """``rows`` with source_path, the least path of ``files`` (path) whose base name is the row's; null if there is none."""
    known = files.select(base_name(F.col("path")).alias("__name"), "path").groupBy("__name").agg(F.min("path").alias("source_path"))
    return rows.join(known, base_name(F.col(name)) == F.col("__name"), "left").drop("__name")


def document_ids(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (doc_id, filename) with resolved_id: their own doc_id, else that of the document of their file name, case aside; of several the least."""
    known = docs.groupBy(F.lower(F.trim("filename")).alias("__name")).agg(F.min("doc_id").alias("__id"))
    found = rows.join(known, F.lower(F.trim(rows["filename"])) == F.col("__name"), "left")
    return found.withColumn("resolved_id", F.coalesce(rows["doc_id"], "__id")).drop("__name", "__id")


def resolved_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """``links`` (source_id, source_name, target_id, target_name) with source and target resolved as by :func:`document_ids`; links to nothing and to the document itself go."""
    known = docs.groupBy(F.lower(F.trim("filename")).alias("name")).agg(F.min("doc_id").alias("id"))
    out = links
    for side in ("source", "target"):
        own = known.select(F.col("name").alias(f"__{side}"), F.col("id").alias(f"__{side}_id"))
        out = out.join(own, F.lower(F.trim(F.col(f"{side}_name"))) == F.col(f"__{side}"), "left").withColumn(side, F.coalesce(f"{side}_id", f"__{side}_id")).drop(f"__{side}", f"__{side}_id")
    return out.filter(F.col("source") != F.col("target"))


def semantic_terms(terms: DataFrame, allowed: DataFrame) -> DataFrame:
    """doc_id, chunk, terms: a sentence's terms that its allowed ones (doc_id, chunk, term) include; the allowed ones, sorted, if none is; all terms where nothing is allowed."""
    by_chunk = allowed.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_set("term")).alias("__allowed"))
    kept = F.filter("terms", lambda t: F.array_contains("__allowed", t))
    found = terms.join(by_chunk, ["doc_id", "chunk"], "left")
    return found.select("doc_id", "chunk", F.when(F.col("__allowed").isNull(), F.col("terms")).when(F.size(kept) > 0, kept).otherwise(F.col("__allowed")).alias("terms"))


def match_score(candidate: Column, text: Column) -> Column:
    """10 for equal texts and 7 for a contained candidate, a hundredth more for each of its characters; else up to 4 by the share of its words, of two letters and more, in the text."""
    parts = F.filter(F.split(candidate, " "), lambda p: F.length(p) >= 2)
    inside = F.size(F.filter(parts, lambda p: text.contains(p)))
    long = F.length(candidate) / 100.0
    return F.when(candidate == "", 0.0).when(candidate == text, 10.0 + long).when(text.contains(candidate), 7.0 + long).when(F.size(parts) > 0, inside / F.size(parts) * 4.0).otherwise(0.0)


def source_chunks(rows: DataFrame, chunks: DataFrame, layout: str = "table") -> DataFrame:
    """doc_id, page_index, row_index, chunk, score: where on its page each row comes from.

    ``rows``: doc_id, page_index, row_index, candidates (texts to look for). ``chunks``: doc_id, page_index, chunk, text, layout_kind. The best candidate's :func:`match_score` counts, 0.75 more
    in a chunk of the preferred layout; of equal chunks the first is taken, and none if no score is above 0.
    """
    plain = lambda c: F.trim(F.regexp_replace(tx.strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "))
    looked = rows.select("doc_id", "page_index", "row_index", F.transform("candidates", plain).alias("candidates"))
    held = chunks.select("doc_id", "page_index", "chunk", plain(F.col("text")).alias("plain"), F.when(F.col("layout_kind") == layout, 0.75).otherwise(0.0).alias("bonus"))
    both = looked.join(held, ["doc_id", "page_index"])
    score = F.round(F.coalesce(F.array_max(F.transform("candidates", lambda c: match_score(c, F.col("plain")))), F.lit(0.0)) + F.col("bonus"), 6)
    best = both.select("doc_id", "page_index", "row_index", "chunk", score.alias("score")).filter("score > 0")
    found = best.groupBy("doc_id", "page_index", "row_index").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk")).alias("m"))
    return found.select("doc_id", "page_index", "row_index", "m.chunk", (-F.col("m.s")).alias("score"))


def rows_with_audit(rows: DataFrame, audit: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """``rows`` whose null columns ``fill`` are taken from the audit row of the same keys, null keys as 0; of several audit rows the one of the greatest values counts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = audit.groupBy(*[zero(F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(fill)])).alias("__f"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (zero(rows[k]) == F.col(f"__k{i}"))
    return rows.join(own, on, "left").select(*[F.coalesce(rows[c], F.col(f"__f.__f{fill.index(c)}")).alias(c) if c in fill else rows[c] for c in rows.columns])


def is_grammar_noise(token: Column, lemma: Column, pos: Column) -> Column:
    """Tokens that make no topic: function words by their part of speech, and stop words."""
    p, plain = F.upper(F.trim(F.coalesce(pos, F.lit("")))), lambda c: tx.term_normal(F.coalesce(c, F.lit("")))
    stop = sorted(GRAMMAR_STOPWORDS)
    return p.isin(*NOISE_POS) | p.rlike("^(?:PRON|DET|ADV|CONJ|AUX|ADP)") | plain(token).isin(*stop) | plain(lemma).isin(*stop)


#: Function words of the two Latin languages, accents off.
GRAMMAR_STOPWORDS = frozenset(
    "_ a an and are as at au aux avec be been being but by ca car ce cela ces cet cette dans de des did do does donc dont du elle elles et for from had has have he her hers him his how i il ils in is it its je la le les leur leurs lui mais me mine moi moins my ni nous of on or ou our ours par plus pour que qui quoi se she sur te that the their theirs them these they this those to toi tres tu un une us vous was we were what when where which who whom whose why with you your yours".split()
)


def unblocked_topics(topics: DataFrame, tokens: DataFrame) -> DataFrame:
    """``topics`` (doc_id, term) without those of which a word is the token or lemma of grammar noise (doc_id, token, lemma, pos) in the same document."""
    noise = tokens.filter(is_grammar_noise(F.col("token"), F.col("lemma"), F.col("pos"))).select("doc_id", F.explode(F.array(tx.term_normal(F.col("token")), tx.term_normal(F.col("lemma")))).alias("__word")).filter("__word <> ''").distinct()
    words = topics.select("doc_id", "term", F.explode(F.split(tx.term_normal(F.col("term")), r"\s+")).alias("__word"))
    return topics.join(words.join(noise, ["doc_id", "__word"], "left_semi").select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")


def topics_from_chunks(chunk_topics: DataFrame, top: int = 12) -> DataFrame:
    """doc_id, rank, term, score, is_primary of documents without topics of their own: their chunks' scores added up, the ``top`` best; the first two are primary."""
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    summed = chunk_topics.groupBy("doc_id", "term").agg(F.round(F.sum("score"), 6).alias("score")).withColumn("rank", F.row_number().over(order))
    return summed.filter(F.col("rank") <= top).select("doc_id", "rank", "term", "score", (F.col("rank") <= 2).alias("is_primary"))


def merged_languages(*sources: DataFrame) -> DataFrame:
    """doc_id, languages, primary: by falling sum of weights, then by the source that named one first, then by name.

    Each source has doc_id, lang and weight; a weight below 1 counts as 1, a blank language as none.
    """
    union = None
    for at, df in enumerate(sources):
        one = df.filter(F.trim("lang") != "").select("doc_id", F.lower(F.trim("lang")).alias("lang"), F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long").alias("weight"), F.lit(at).alias("at"))
        union = one if union is None else union.unionByName(one)
    summed = union.groupBy("doc_id", "lang").agg(F.sum("weight").alias("n"), F.min("at").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "lang")))
    packed = summed.groupBy("doc_id").agg(ordered.alias("l"))
    return packed.select("doc_id", F.transform("l", lambda x: x["lang"]).alias("languages"), F.get("l", 0)["lang"].alias("primary"), F.transform("l", lambda x: -x["n"]).alias("counts"))


def best_documents(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``: content other than image_only first, then the most pages, then the longest text, then the first by ``nth``.

    Where a later row has fewer pages but more text than an earlier one, a fold over the rows in their order could keep either; here pages decide.
    """
    rank = F.struct((F.coalesce("content", F.lit("")) == "image_only").alias("image"), (-F.col("pages")).alias("pages"), (-F.length(F.coalesce("text", F.lit("")))).alias("text"), "nth")
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("__row")).select(key, "__row.*")


def best_extraction(rows: DataFrame, key: str, fields: str, order: str) -> DataFrame:
    """One row for each ``key``: the one of the most fields (a map), of equal ones the first."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct((-F.coalesce(F.size(fields), F.lit(0))).alias("n"), order)).alias("__row")).select(key, "__row.*")


def reindexed(rows: DataFrame, keys: list[str], table: str, row: str) -> DataFrame:
    """``rows`` with the tables of each key numbered from 1 and the rows of each table too, in their former order."""
    by_table = W.partitionBy(*keys).orderBy(table)
    return rows.withColumns({table: F.dense_rank().over(by_table), row: F.row_number().over(W.partitionBy(*keys, table).orderBy(row))})


def packed_pages(rows: DataFrame, key: list[str]) -> DataFrame:
    """keys, pages_text, page_count: page rows (page_index, page_text) packed by document in the order of the pages, nulls as ''."""
    packed = F.array_sort(F.collect_list(F.struct("page_index", F.coalesce("page_text", F.lit("")).alias("t"))))
    return rows.groupBy(*key).agg(packed.alias("p")).select(*key, F.transform("p", lambda x: x["t"]).alias("pages_text"), F.size("p").alias("page_count"))


def first_with_rows(*frames: DataFrame | None) -> DataFrame | None:
    """The first of the sources that exists and has a row; the last one that exists if none has."""
    there = [f for f in frames if f is not None]
    return next((f for f in there if not f.isEmpty()), there[-1] if there else None)


def synced(index: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``index`` with ``columns`` replaced by those of the results of the same key; rows without a result keep theirs."""
    new = results.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    both = index.join(new, F.col(key) == F.col("__key"), "left")
    return both.select(*[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c) if c in index.columns else F.lit(None)).alias(c) if c in columns else index[c] for c in [*index.columns, *[c for c in columns if c not in index.columns]]])


def quality_checks(verified: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, status, n_issues of the documents that a reader should look at: those with issues, and those neither ok nor partial_ok."""
    counts = issues.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    found = verified.select("doc_id", F.col("verification_status").alias("status")).join(counts, "doc_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)).cast("long"))
    return found.filter((F.col("n_issues") > 0) | ~F.col("status").isin("ok", "partial_ok"))


def with_marks(docs: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """``docs`` with n_marks, mark_kinds and has_marks of their visual marks (key, kind)."""
    own = marks.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_marks"), F.array_sort(F.collect_set("kind")).alias("mark_kinds"))
    none = F.array().cast("array<string>")
    return docs.join(own, F.col(key) == F.col("__key"), "left").drop("__key").withColumns({"n_marks": F.coalesce("n_marks", F.lit(0)).cast("long"), "mark_kinds": F.coalesce("mark_kinds", none)}).withColumn("has_marks", F.col("n_marks") > 0)


def document_summary(docs: DataFrame, key: str, averages: dict[str, tuple[DataFrame, str]], **parts: DataFrame) -> DataFrame:
    """key, for each of ``averages`` the mean of a column to six decimals, for each of ``parts`` its number of rows (null for none) and a has_ flag."""
    out = docs.select(key)
    for name, (df, column) in averages.items():
        out = out.join(df.groupBy(F.col(key).alias("__key")).agg(F.round(F.avg(column), 6).alias(name)), F.col(key) == F.col("__key"), "left").drop("__key")
    for name, df in parts.items():
        out = out.join(df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(f"n_{name}")), F.col(key) == F.col("__key"), "left").drop("__key").withColumn(f"has_{name}", F.col(f"n_{name}").isNotNull())
    return out


def token_starts(line: Column) -> Column:
    """Where the blank-separated tokens of a line begin, from 0."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.when(x != "", F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))
    return F.aggregate(F.split(F.replace(F.coalesce(line, F.lit("")), F.lit(" "), F.lit(" ")), " "), begin, step)["starts"]


def aligned_share(starts: Column, other: Column, tolerance: int = 3) -> Column:
    """The share of ``starts`` that lie within ``tolerance`` of one of ``other``; 0 if either is empty."""
    near = F.size(F.filter(starts, lambda a: F.exists(other, lambda b: F.abs(a - b) <= tolerance)))
    return F.when((F.size(starts) > 0) & (F.size(other) > 0), near / F.size(starts)).otherwise(0.0)


def neighbour_alignment(lines: DataFrame, tolerance: int = 3) -> DataFrame:
    """doc_id, page_index, line, n_tokens, before, after: how far each line's tokens stand under those of the lines beside it."""
    order = W.partitionBy("doc_id", "page_index").orderBy("line")
    at = lines.select("doc_id", "page_index", "line", token_starts(F.col("text")).alias("starts"))
    none = F.array().cast("array<int>")
    at = at.withColumns({"up": F.coalesce(F.lag("starts").over(order), none), "down": F.coalesce(F.lead("starts").over(order), none)})
    share = lambda c: F.round(aligned_share(F.col("starts"), F.col(c), tolerance), 6)
    return at.select("doc_id", "page_index", "line", F.size("starts").alias("n_tokens"), share("up").alias("before"), share("down").alias("after"))


def merged_blocks(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """doc_id, at, lines of the blocks (arrays of lines) of both; of blocks of a document with the same first line, last line and number of lines the first stays. Blank lines don't count, and a block needs two lines."""
    squeezed = F.filter(F.transform("lines", lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != "")
    both = primary.withColumn("__s", F.lit(0)).unionByName(secondary.withColumn("__s", F.lit(1))).withColumn("__l", squeezed).filter(F.size("__l") >= 2)
    signature = [F.get("__l", 0).alias("__a"), F.element_at("__l", -1).alias("__b"), F.size("__l").alias("__n")]
    first = both.groupBy("doc_id", *signature).agg(F.min_by(F.struct("at", "lines"), F.struct("__s", "at")).alias("r"))
    return first.select("doc_id", "r.at", "r.lines")


def without_sections(df: DataFrame, profile: str, prefixes: dict[str, str] = {"50ml": "ml50_", "100ml": "ml100_"}) -> DataFrame:  # noqa: B006
    """``df`` without the columns that belong to other profiles, by their prefix."""
    other = tuple(p for name, p in prefixes.items() if name != profile)
    return df.drop(*[c for c in df.columns if c.lower().startswith(other)])


def wants_ocr(path: Column, n_rows: Column, numeric_rows: Column, richest: Column) -> Column:
    """Whether a page's table should be read again from its image: an image file without rows, or with at most two numeric rows and no table of five rows."""
    image = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"\.([a-z]+)$", 1).isin(*IMAGE_SUFFIXES)
    return image & ((n_rows == 0) | ((numeric_rows <= 2) & (richest < 5)))


def bootstrap(spark: SparkSession, schemas: dict[str, str], database: str = "default", folder: str | None = None) -> list[str]:
    """Make the tables that aren't there yet and return their names; running it again changes nothing. ``schemas``: DDL column lists by table."""
    made = []
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in schemas.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            place = f" LOCATION '{folder}/{name}'" if folder else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{place}")
            made.append(name)
    return made
