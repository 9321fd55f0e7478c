"""Documents and what was found in them as relational tables. Every row has an id that its natural key alone decides, so that a second run meets the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .records import stable_id

Tables = dict[str, DataFrame]


def _id(kind: str, *parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return stable_id(F.lit(kind), F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def ingest_tables(docs: DataFrame, run: str) -> Tables:
    """runs, documents, document_texts of ``docs`` (doc_id, filename, text)."""
    document = _id("document", F.lit(run), "doc_id")
    rows = docs.select(document.alias("document_id"), F.lit(run).alias("run_id"), "doc_id", "filename", F.length(F.coalesce("text", F.lit(""))).alias("text_length"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"))
    texts = docs.filter(F.col("text").isNotNull()).select(_id("text", F.lit(run), "doc_id").alias("text_id"), document.alias("document_id"), F.md5("text").alias("text_md5"), F.regexp_count("text", F.lit("\n")).alias("line_breaks"))
    runs = rows.groupBy("run_id").agg(F.count("*").alias("documents"), F.count_if("has_text").alias("with_text"))
    return {"runs": runs, "documents": rows, "document_texts": texts}


def classification_tables(ranked: DataFrame, decided: DataFrame, hits: DataFrame, confusions: dict[str, list[str]] | None = None) -> Tables:
    """classification_scores, classification_audit, keyword_matches, anti_confusion_hits, anti_confusion_targets.

    ``ranked``, ``decided`` and ``hits`` are what :mod:`classify` makes of the documents; a type's hits on other types' names are its anti-confusion hits.
    """
    best = decided.select("doc_id", F.col("doc_type").alias("__won"))
    scores = ranked.join(best, "doc_id", "left").select(_id("cls-score", "doc_id", "doc_type").alias("score_id"), "doc_id", "doc_type", F.col("score").cast("double").alias("score"), F.col("rank").alias("score_rank"), F.coalesce(F.col("doc_type") == F.col("__won"), F.lit(False)).alias("is_winner"))
    by_keyword = hits.groupBy("doc_id", "doc_type", "bucket", "keyword").agg(F.sum("n").alias("match_count"), F.sum("score").cast("double").alias("weight"))
    totals = ranked.select("doc_id", "doc_type", F.lit("score_total").alias("metric_name"), F.lit("").alias("metric_text"), F.col("score").cast("double").alias("metric_number"))
    parts = by_keyword.select("doc_id", "doc_type", F.concat(F.lit("matched_keyword."), "bucket").alias("metric_name"), F.col("keyword").alias("metric_text"), F.col("weight").alias("metric_number"))
    audit = totals.unionByName(parts).withColumn("audit_id", _id("cls-audit", "doc_id", "doc_type", "metric_name", "metric_text"))
    words = by_keyword.withColumn("keyword_match_id", _id("cls-keyword", "doc_id", "doc_type", "bucket", "keyword"))
    pairs = [(t, o, i) for t, others in (confusions or {}).items() for i, o in enumerate(others, 1)]
    named = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.lit(o).alias("target_doc_type"), F.lit(i).alias("target_rank")) for t, o, i in pairs]) if pairs else F.array().cast("array<struct<doc_type:string,target_doc_type:string,target_rank:int>>")
    targets = decided.select("doc_id", F.col("doc_type").alias("__won"), F.inline(named)).filter(F.col("doc_type") == F.col("__won")).drop("__won").withColumn("target_id", _id("anti-target", "doc_id", "target_doc_type"))
    anti = hits.withColumn("__pair", F.explode(named)).filter((F.col("__pair.doc_type") == F.col("doc_type")) & (F.upper("__pair.target_doc_type") == F.upper("keyword")))
    anti = anti.groupBy("doc_id", "doc_type", F.col("__pair.target_doc_type").alias("target_doc_type")).agg(F.sum("n").alias("hit_count")).withColumn("hit_id", _id("anti-hit", "doc_id", "doc_type", "target_doc_type"))
    return {"classification_scores": scores, "classification_audit": audit, "keyword_matches": words, "anti_confusion_hits": anti, "anti_confusion_targets": targets}


def text_tables(sentences: DataFrame, words: Column, topics: DataFrame | None = None, vectors: DataFrame | None = None) -> Tables:
    """sentences, sentence_spans, tokens, topics, vectors and vector_values.

    ``sentences``: doc_id, page_index, chunk, text; ``words`` cuts a text into tokens. A span is where the sentence's characters lie among all of the page's sentences, one character between two.
    """
    from pyspark.sql import Window as W

    sentence = _id("sentence", "doc_id", "page_index", "chunk")
    rows = sentences.select(sentence.alias("sentence_id"), _id("page", "doc_id", "page_index").alias("page_id"), "doc_id", "page_index", "chunk", F.length("text").alias("char_count"), F.length(F.regexp_replace("text", r"\s", "")).alias("nonspace_count"))
    before = F.coalesce(F.sum(F.col("char_count") + 1).over(W.partitionBy("doc_id", "page_index").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = rows.select("sentence_id", "doc_id", "page_index", "chunk", before.alias("start")).join(rows.select("sentence_id", "char_count"), "sentence_id").select("sentence_id", "doc_id", "start", (F.col("start") + F.col("char_count")).alias("end"))
    # the id is made of a sentence, not of each of its words
    cut = sentences.select(sentence.alias("sentence_id"), "doc_id", words.alias("__words"))
    tokens = cut.select("sentence_id", "doc_id", F.posexplode_outer("__words").alias("tok_index", "token")).filter("tok_index IS NOT NULL").withColumn("token_id", _id("token", "sentence_id", "tok_index"))
    pages = rows.groupBy("page_id", "doc_id", "page_index").agg(F.count("*").alias("sentences"), F.sum("char_count").alias("chars"))
    out = {"pages": pages, "sentences": rows, "sentence_spans": spans, "tokens": tokens}
    if topics is not None:
        out["topics"] = topics.withColumn("topic_id", _id("topic", "doc_id", "term"))
    if vectors is not None:
        out["vectors"] = vectors.select(_id("vector", "doc_id").alias("vector_id"), "doc_id", F.size("vector").alias("dim"))
        out["vector_values"] = vectors.select(_id("vector", "doc_id").alias("vector_id"), F.posexplode("vector").alias("position", "value"))
    return out


def quality_tables(verified: DataFrame, rows: DataFrame, issues: DataFrame) -> Tables:
    """quality_checks (a row for each check of a document), row_audit, quality_issues, declared_totals (a row for each total that was found)."""
    names = ["rows_check", "subtotal_check", "tax_check", "total_check"]
    checks = verified.unpivot(["doc_id"], names, "check_name", "status").withColumn("check_name", F.regexp_replace("check_name", "_check$", "")).withColumn("check_id", _id("check", "doc_id", "check_name"))
    audit = rows.withColumn("row_audit_id", _id("row-audit", "doc_id", "row_index"))
    found = issues.withColumn("issue_id", _id("issue", "doc_id", "row_index"))
    declared = verified.select("doc_id", *[F.col(c).cast("double").alias(c.removeprefix("declared_")) for c in ("declared_subtotal", "declared_tax", "declared_total")]).unpivot(["doc_id"], ["subtotal", "tax", "total"], "field", "amount").filter("amount IS NOT NULL")
    return {"quality_checks": checks, "row_audit": audit, "quality_issues": found, "declared_totals": declared.withColumn("declared_id", _id("declared", "doc_id", "field"))}


def extraction_tables(fields: DataFrame, matches: DataFrame, bm25: DataFrame | None = None, entities: DataFrame | None = None) -> Tables:
    """extraction_fields, extraction_matches, bm25_chunks and relations: each two entities (doc_id, chunk, nth, text, type) that follow each other in a chunk."""
    from pyspark.sql import Window as W

    out = {
        "extraction_fields": fields.withColumn("field_id", _id("field", "doc_id", "field")).withColumn("status", F.when(F.col("n") > 0, "found").otherwise("missing")),
        "extraction_matches": matches.withColumn("match_id", _id("match", "doc_id", "page_index", "field", "rule_id", "match_no")),
    }
    if bm25 is not None:
        out["bm25_chunks"] = bm25.withColumn("bm25_id", _id("bm25", "doc_id", "chunk"))
    if entities is not None:
        order = W.partitionBy("doc_id", "chunk").orderBy("nth")
        pairs = entities.select("doc_id", "chunk", "nth", F.col("text").alias("subject"), F.col("type").alias("subject_type"), F.lead("text").over(order).alias("object"), F.lead("type").over(order).alias("object_type"))
        out["relations"] = pairs.filter("object IS NOT NULL").withColumn("relation_id", _id("relation", "doc_id", "chunk", "nth"))
    return out


def link_tables(links: DataFrame, shared: DataFrame, matches: DataFrame, whole: bool = False) -> Tables:
    """document_links, link_terms (a row for each shared term, the longest first), link_matches (a row for each sentence pair).

    ``links``: source, target, score and more; ``shared``: source, target, shared_terms; ``matches``: source, target, a, b, rank, score; ``whole``: these are of the links alone.
    """
    link = _id("link", "source", "target")
    kept = lambda rows: rows if whole else rows.join(links.select("source", "target"), ["source", "target"], "left_semi")
    ranked = F.array_sort(F.transform("shared_terms", lambda t: F.struct((-F.size(F.split(t, " "))).alias("w"), (-F.length(t)).alias("l"), t.alias("t"))))
    terms = kept(shared).select(link.alias("link_id"), "source", "target", F.posexplode(ranked).alias("at", "x")).select("link_id", "source", "target", (F.col("at") + 1).alias("term_rank"), F.col("x.t").alias("term"))
    return {"document_links": links.drop("link_id").withColumn("link_id", link), "link_terms": terms, "link_matches": kept(matches).withColumn("link_id", link).withColumn("match_id", _id("link-match", "source", "target", "a", "b"))}


PROCESSING = "warnings array<string>, logs array<string>, steps array<struct<name:string, status:string, seconds:double>>, fields map<string,string>"


def processing_tables(df: DataFrame, key: str, payload: str) -> Tables:
    """warnings, logs, steps, durations and business_fields from a JSON column of that shape; what doesn't parse or is missing has no rows."""
    parsed = df.select(F.col(key), F.from_json(payload, PROCESSING).alias("p"))
    lines = lambda c: parsed.select(key, F.posexplode(f"p.{c}").alias("at", "text")).filter(F.trim("text") != "").select(_id(c, key, "at").alias("row_id"), key, (F.col("at") + 1).alias("nth"), "text")
    steps = parsed.select(key, F.posexplode("p.steps").alias("at", "s")).select(_id("step", key, "at").alias("row_id"), key, (F.col("at") + 1).alias("nth"), "s.name", "s.status", "s.seconds")
    durations = steps.groupBy(key).agg(F.count("*").alias("steps"), F.round(F.sum("seconds"), 6).alias("seconds"), F.count_if(F.col("status") != "ok").alias("failed"))
    fields = parsed.select(key, F.explode("p.fields").alias("field", "value")).withColumn("row_id", _id("business", key, "field"))
    return {"warnings": lines("warnings"), "logs": lines("logs"), "steps": steps, "durations": durations, "business_fields": fields}


def review_tasks(decided: DataFrame, verified: DataFrame | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """doc_id, reason, priority, task_id: what a person has to look at. Unsure classifications first, then totals that don't agree, then documents without any extracted field."""
    tasks = decided.filter(F.col("status") == "REVIEW").select("doc_id", F.lit("classification").alias("reason"), F.lit(1).alias("priority"))
    if verified is not None:
        tasks = tasks.unionByName(verified.filter(F.col("verification_status") == "mismatch").select("doc_id", F.lit("totals").alias("reason"), F.lit(2).alias("priority")))
    if contacts is not None:
        tasks = tasks.unionByName(contacts.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n = 0").select("doc_id", F.lit("no_fields").alias("reason"), F.lit(3).alias("priority")))
    return tasks.withColumn("task_id", _id("review", "doc_id", "reason"))
