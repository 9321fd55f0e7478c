"""Queries of the relational tables: one for each family, with the ids that its natural keys make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, extract, ranking, relational, totals
from .common import SENTENCES, WORDS, pages_of, query, sentences_of, table
from .layout_queries import _EMAILS
from .money_queries import _CHECKED, declared_totals, line_items
from .text_queries import _BM25, _DECIDED, _HITS, _ITEMS as _TALKS, _LINKS, _PAIRS, _item_topics, _linking
from ..operators import linking


def _id(kind: str, *parts: str) -> str:
    return f"'{kind}-' || substr(sha1('{kind}|' || " + " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "), 1, 24)"


@query("rel_documents", f"SELECT {_id('document', chr(39) + 'run-1' + chr(39), 'doc_id')} AS document_id, 'run-1' AS run_id, doc_id, 'f' || doc_id AS filename, length(coalesce(text, '')) AS text_length, trim(coalesce(text, '')) <> '' AS has_text FROM documents")
def rel_documents(spark, d):
    return relational.ingest_tables(table(spark, d, "documents").withColumn("filename", F.concat(F.lit("f"), F.col("doc_id").cast("string"))), "run-1")["documents"]


@query("rel_document_texts", f"SELECT {_id('text', chr(39) + 'run-1' + chr(39), 'doc_id')} AS text_id, {_id('document', chr(39) + 'run-1' + chr(39), 'doc_id')} AS document_id, md5(text) AS text_md5, length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM documents WHERE text IS NOT NULL")
def rel_document_texts(spark, d):
    return relational.ingest_tables(table(spark, d, "documents").withColumn("filename", F.lit("f")), "run-1")["document_texts"]


def _classified(spark, d):
    docs = table(spark, d, "documents")
    hits = classify.keyword_hits(pages_of(docs), shared=True)
    scored = classify.scores_of(hits)
    return relational.classification_tables(classify.ranked(docs, scored), classify.decisions(docs, scored), hits, {"ENGLISH_PROSE": ["LES", "UND"], "FRENCH_PROSE": ["THE"]})


@query("rel_classification_scores", f"{_DECIDED} SELECT {_id('cls-score', 'r.doc_id', 'r.doc_type')} AS score_id, r.doc_id, r.doc_type, CAST(r.score AS DOUBLE) AS score, r.rank AS score_rank, r.doc_type = d.doc_type AS is_winner FROM ranks r JOIN decided d USING (doc_id)")
def rel_classification_scores(spark, d):
    return _classified(spark, d)["classification_scores"]


@query("rel_classification_audit", f"""WITH {_HITS}, k AS (SELECT doc_id, doc_type, bucket, keyword, CAST(sum(score) AS DOUBLE) AS w FROM hits GROUP BY ALL),
    a AS (SELECT doc_id, doc_type, 'score_total' AS metric_name, '' AS metric_text, CAST(score AS DOUBLE) AS metric_number FROM ranks UNION ALL SELECT doc_id, doc_type, 'matched_keyword.' || bucket, keyword, w FROM k) SELECT *, {_id('cls-audit', 'doc_id', 'doc_type', 'metric_name', 'metric_text')} AS audit_id FROM a""")
def rel_classification_audit(spark, d):
    return _classified(spark, d)["classification_audit"]


@query("rel_keyword_matches", f"WITH {_HITS} SELECT doc_id, doc_type, bucket, keyword, CAST(sum(n) AS BIGINT) AS match_count, CAST(sum(score) AS DOUBLE) AS weight, {_id('cls-keyword', 'doc_id', 'doc_type', 'bucket', 'keyword')} AS keyword_match_id FROM hits GROUP BY ALL")
def rel_keyword_matches(spark, d):
    return _classified(spark, d)["keyword_matches"]


_CONFUSED = "cf(doc_type, target_doc_type, target_rank) AS (VALUES ('ENGLISH_PROSE', 'LES', 1), ('ENGLISH_PROSE', 'UND', 2), ('FRENCH_PROSE', 'THE', 1))"


@query("rel_anti_confusion_hits", f"WITH {_HITS}, {_CONFUSED} SELECT doc_id, h.doc_type, target_doc_type, CAST(sum(n) AS BIGINT) AS hit_count, {_id('anti-hit', 'doc_id', 'h.doc_type', 'target_doc_type')} AS hit_id FROM hits h JOIN cf ON cf.doc_type = h.doc_type AND target_doc_type = keyword GROUP BY doc_id, h.doc_type, target_doc_type")
def rel_anti_confusion_hits(spark, d):
    return _classified(spark, d)["anti_confusion_hits"]


@query("rel_anti_confusion_targets", f"{_DECIDED}, {_CONFUSED} SELECT doc_id, doc_type, target_doc_type, target_rank, {_id('anti-target', 'doc_id', 'target_doc_type')} AS target_id FROM decided JOIN cf USING (doc_type)")
def rel_anti_confusion_targets(spark, d):
    return _classified(spark, d)["anti_confusion_targets"]


def _texts(spark, d):
    chunks = sentences_of(table(spark, d, "documents")).withColumn("page_index", F.lit(1))
    return relational.text_tables(chunks, tx.words(F.col("text")))


_SENT = f"WITH {SENTENCES}, s AS (SELECT {_id('sentence', 'doc_id', '1', 'chunk')} AS sentence_id, {_id('page', 'doc_id', '1')} AS page_id, doc_id, 1 AS page_index, chunk, length(text) AS char_count, length(regexp_replace(text, '\\s', '', 'g')) AS nonspace_count, text FROM sent)"


@query("rel_sentences", f"{_SENT} SELECT * EXCLUDE text FROM s")
def rel_sentences(spark, d):
    return _texts(spark, d)["sentences"]


@query("rel_pages", f"{_SENT} SELECT page_id, doc_id, page_index, count(*) AS sentences, CAST(sum(char_count) AS BIGINT) AS chars FROM s GROUP BY ALL")
def rel_pages(spark, d):
    return _texts(spark, d)["pages"]


@query("rel_sentence_spans", f'{_SENT}, b AS (SELECT *, coalesce(CAST(sum(char_count + 1) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM s) SELECT sentence_id, doc_id, start, start + char_count AS "end" FROM b')
def rel_sentence_spans(spark, d):
    return _texts(spark, d)["sentence_spans"]


@query("rel_tokens", f"{_SENT}, t AS (SELECT sentence_id, doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) - 1 AS tok_index FROM s) SELECT *, {_id('token', 'sentence_id', 'tok_index')} AS token_id FROM t")
def rel_tokens(spark, d):
    return _texts(spark, d)["tokens"]


@query("rel_topics", f"{_TALKS} SELECT *, {_id('topic', 'doc_id', 'term')} AS topic_id FROM topics")
def rel_topics(spark, d):
    items, topics = _item_topics(spark, d)
    return relational.text_tables(items.withColumn("page_index", F.lit(1)), tx.words(F.col("text")), topics)["topics"]


@query("rel_vector_values", f"SELECT {_id('vector', 'vec_id')} AS vector_id, unnest(range(len(embedding))) AS position, unnest(embedding) AS value FROM embeddings")
def rel_vector_values(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return relational.text_tables(sentences_of(table(spark, d, "documents")).withColumn("page_index", F.lit(1)), tx.words(F.col("text")), vectors=vectors)["vector_values"]


def _quality(spark, d):
    rows = totals.verify_rows(line_items(spark, d))
    return relational.quality_tables(totals.verify_documents(rows, declared_totals(rows)), rows, totals.issues(rows))


@query("rel_quality_checks", f"""{_CHECKED}, u AS (SELECT doc_id, unnest(['rows', 'subtotal', 'tax', 'total']) AS check_name, unnest([rows_check, subtotal_check, tax_check, total_check]) AS status FROM documents_checked) SELECT *, {_id('check', 'doc_id', 'check_name')} AS check_id FROM u""")
def rel_quality_checks(spark, d):
    return _quality(spark, d)["quality_checks"]


@query("rel_row_audit", f"{_CHECKED} SELECT doc_id, row_index, row_status, CAST(e AS DOUBLE) AS effective_total, {_id('row-audit', 'doc_id', 'row_index')} AS row_audit_id FROM rows_checked")
def rel_row_audit(spark, d):
    return _quality(spark, d)["row_audit"].select("doc_id", "row_index", "row_status", F.col("effective_total").cast("double").alias("effective_total"), "row_audit_id")


@query("rel_quality_issues", f"{_CHECKED} SELECT doc_id, row_index, row_status, CAST(c AS DOUBLE) AS expected, CAST(dcl AS DOUBLE) AS found, {_id('issue', 'doc_id', 'row_index')} AS issue_id FROM rows_checked WHERE row_status = 'mismatch' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_index) <= 100")
def rel_quality_issues(spark, d):
    return _quality(spark, d)["quality_issues"].withColumns({c: F.col(c).cast("double") for c in ("expected", "found")})


@query("rel_declared_totals", f"""{_CHECKED}, u AS (SELECT doc_id, unnest(['subtotal', 'tax', 'total']) AS field, unnest([CAST(ds AS DOUBLE), CAST(dx AS DOUBLE), CAST(dt AS DOUBLE)]) AS amount FROM documents_checked) SELECT *, {_id('declared', 'doc_id', 'field')} AS declared_id FROM u WHERE amount IS NOT NULL""")
def rel_declared_totals(spark, d):
    return _quality(spark, d)["declared_totals"]


@query("rel_extraction_fields", f"SELECT doc_id, 'email' AS field, len({_EMAILS}) AS n, {_EMAILS}[1] AS first_value, {_id('field', 'doc_id', chr(39) + 'email' + chr(39))} AS field_id, CASE WHEN len({_EMAILS}) > 0 THEN 'found' ELSE 'missing' END AS status FROM documents")
def rel_extraction_fields(spark, d):
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    found = extract.matches(pages_of(docs), rules)
    return relational.extraction_tables(extract.fields(docs, found, rules), found)["extraction_fields"]


@query("rel_extraction_matches", f"WITH e AS (SELECT doc_id, {_EMAILS} AS l FROM documents), m AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS match_no FROM e) SELECT doc_id, value, match_no, {_id('match', 'doc_id', '1', chr(39) + 'email' + chr(39), chr(39) + 'email-1' + chr(39), 'match_no')} AS match_id FROM m")
def rel_extraction_matches(spark, d):
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    found = extract.matches(pages_of(docs), rules)
    return relational.extraction_tables(extract.fields(docs, found, rules), found)["extraction_matches"].select("doc_id", "value", "match_no", "match_id")


@query("rel_bm25_chunks", f"{_BM25} SELECT doc_id, chunk, round(score, 6) AS score, {_id('bm25', 'doc_id', 'chunk')} AS bm25_id FROM s")
def rel_bm25_chunks(spark, d):
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    chunks = sentences_of(docs)
    first = chunks.filter("chunk = 0").select("doc_id", F.array_distinct(tx.words(F.col("text"))).alias("terms"))
    found = extract.matches(pages_of(docs), rules)
    scored = ranking.bm25(chunks, first).withColumn("score", F.round("score", 6))
    return relational.extraction_tables(extract.fields(docs, found, rules), found, scored)["bm25_chunks"]


@query("rel_relations", f"""WITH t AS (SELECT conv_id AS doc_id, turn AS chunk, unnest({WORDS}) AS text, generate_subscripts({WORDS}, 1) AS nth FROM conversations), e AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS type FROM t WHERE length(text) >= 9),
    r AS (SELECT doc_id, chunk, nth, text AS subject, type AS subject_type, lead(text) OVER w AS object, lead(type) OVER w AS object_type FROM e WINDOW w AS (PARTITION BY doc_id, chunk ORDER BY nth)) SELECT *, {_id('relation', 'doc_id', 'chunk', 'nth')} AS relation_id FROM r WHERE object IS NOT NULL""")
def rel_relations(spark, d):
    talk = table(spark, d, "conversations")
    words = talk.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.posexplode_outer(tx.words(F.col("text"))).alias("at", "text")).filter(F.length("text") >= 9)
    entities = words.select("doc_id", "chunk", (F.col("at") + 1).alias("nth"), "text", F.when(F.length("text") % 2 == 0, "A").otherwise("B").alias("type"))
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    found = extract.matches(pages_of(docs), rules)
    return relational.extraction_tables(extract.fields(docs, found, rules), found, entities=entities)["relations"]


def _linked(spark, d):
    about = _linking(spark, d)[1:]
    return relational.link_tables(linking.all_links(*about), linking.all_link_terms(*about), linking.all_link_matches(*about), whole=True)


@query("rel_document_links", f"{_TALKS}, {_LINKS} SELECT source, target, score, {_id('link', 'source', 'target')} AS link_id FROM links")
def rel_document_links(spark, d):
    return _linked(spark, d)["document_links"].select("source", "target", "score", "link_id")


@query("rel_link_terms", f"""{_TALKS}, {_PAIRS}, {_LINKS}, x AS (SELECT source, target, unnest(shared_terms) AS term FROM pairs SEMI JOIN links USING (source, target))
    SELECT {_id('link', 'source', 'target')} AS link_id, source, target, row_number() OVER (PARTITION BY source, target ORDER BY len(string_split(term, ' ')) DESC, length(term) DESC, term) AS term_rank, term FROM x""")
def rel_link_terms(spark, d):
    return _linked(spark, d)["link_terms"]


@query("rel_link_matches", f"{_TALKS}, {_LINKS} SELECT source, target, a, b, rank, score, {_id('link', 'source', 'target')} AS link_id, {_id('link-match', 'source', 'target', 'a', 'b')} AS match_id FROM matches SEMI JOIN links USING (source, target)")
def rel_link_matches(spark, d):
    return _linked(spark, d)["link_matches"].select("source", "target", "a", "b", "rank", "score", "link_id", "match_id")


def _processing(spark, d):
    """Events as what a job logs: a JSON object each."""
    e = table(spark, d, "events")
    step = lambda name, seconds: F.struct(name.alias("name"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("ok").alias("status"), seconds.alias("seconds"))
    payload = F.to_json(F.struct(
        F.when(F.col("event_id") % 5 == 0, F.array(F.col("event_type"), F.lit(" "))).alias("warnings"), F.array(F.concat(F.lit("did "), F.col("event_type"))).alias("logs"),
        F.array(step(F.col("event_type"), F.lit(1.5)), step(F.lit("end"), (F.col("event_id") % 10).cast("double"))).alias("steps"), F.create_map(F.lit("kind"), F.col("event_type")).alias("fields"),
    ))
    return relational.processing_tables(e.select("event_id", F.when(F.col("event_id") % 11 == 0, "{bad").otherwise(payload).alias("p")), "event_id", "p")


_GOOD = "FROM events WHERE event_id % 11 <> 0"


@query("rel_warnings", f"SELECT {_id('warnings', 'event_id', '0')} AS row_id, event_id, 1 AS nth, event_type AS text {_GOOD} AND event_id % 5 = 0 AND trim(event_type) <> ''")
def rel_warnings(spark, d):
    return _processing(spark, d)["warnings"]


@query("rel_logs", f"SELECT {_id('logs', 'event_id', '0')} AS row_id, event_id, 1 AS nth, 'did ' || event_type AS text {_GOOD} AND event_type IS NOT NULL")
def rel_logs(spark, d):
    return _processing(spark, d)["logs"]


@query("rel_steps", f"""WITH s AS (SELECT event_id, unnest([1, 2]) AS nth, unnest([event_type, 'end']) AS name, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, unnest([1.5, CAST(event_id % 10 AS DOUBLE)]) AS seconds {_GOOD}) SELECT {_id('step', 'event_id', 'nth - 1')} AS row_id, * FROM s""")
def rel_steps(spark, d):
    return _processing(spark, d)["steps"]


@query("rel_durations", f"SELECT event_id, 2 AS steps, 1.5 + event_id % 10 AS seconds, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS failed {_GOOD}")
def rel_durations(spark, d):
    return _processing(spark, d)["durations"]


@query("rel_business_fields", f"SELECT event_id, 'kind' AS field, event_type AS value, {_id('business', 'event_id', chr(39) + 'kind' + chr(39))} AS row_id {_GOOD}")
def rel_business_fields(spark, d):
    return _processing(spark, d)["business_fields"]


@query("rel_review_tasks", f"""{_DECIDED}, t AS (SELECT doc_id, 'classification' AS reason, 1 AS priority FROM decided WHERE status = 'REVIEW' UNION ALL SELECT doc_id, 'no_fields', 3 FROM documents WHERE len({_EMAILS}) = 0) SELECT *, {_id('review', 'doc_id', 'reason')} AS task_id FROM t""")
def rel_review_tasks(spark, d):
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    found = extract.fields(docs, extract.matches(pages_of(docs), rules), rules)
    return relational.review_tasks(classify.decisions(docs, classify.scores(pages_of(docs))), contacts=found)
