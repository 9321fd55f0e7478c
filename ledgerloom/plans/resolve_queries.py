"""Queries that bring rows of different sources together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, extract, linking, resolve, totals
from .common import INFORMATIVE, PLAIN_WORDS, WORDS, in_list, pages_of, query, table
from .money_queries import _CHECKED, _ITEMS, declared_totals, line_items
from .text_queries import _DECIDED, _GRAMMAR, _ITEMS as _TALKS, _LAYOUT, _TERMS, _item_topics

_ID = "CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey % 500 END"


def _named_docs(spark, d):
    """Documents with made-up file names, some of which two documents share."""
    key = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("File "), (key % 400).cast("string"), F.lit(".PDF")).alias("filename"))


_NAMED = "docs AS (SELECT doc_id, 'File ' || (doc_id % 400) || '.PDF' AS filename FROM documents), known AS (SELECT lower(trim(filename)) AS name, min(doc_id) AS id FROM docs GROUP BY 1)"


@query("resolved_document_ids", f"WITH {_NAMED}, r AS (SELECT l_orderkey, l_linenumber, {_ID} AS doc_id, 'file ' || (l_partkey % 450) || '.pdf' AS filename FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(doc_id, id) AS resolved_id FROM r LEFT JOIN known ON name = filename")
def resolved_document_ids(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey") % 500).alias("doc_id"), F.concat(F.lit("file "), (F.col("l_partkey") % 450).cast("string"), F.lit(".pdf")).alias("filename"))
    return resolve.document_ids(rows, _named_docs(spark, d)).select("l_orderkey", "l_linenumber", "resolved_id")


@query("resolved_links", f"""WITH {_NAMED}, l AS (SELECT l_orderkey, l_linenumber, {_ID} AS source_id, 'file ' || (l_partkey % 450) || '.pdf' AS source_name, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS target_id, 'File ' || (l_suppkey % 450) || '.pdf' AS target_name FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, coalesce(source_id, a.id) AS source, coalesce(target_id, b.id) AS target FROM l LEFT JOIN known a ON a.name = lower(source_name) LEFT JOIN known b ON b.name = lower(target_name)) SELECT * FROM r WHERE source <> target""")
def resolved_links(spark, d):
    name = lambda c, word: F.concat(F.lit(word), (F.col(c) % 450).cast("string"), F.lit(".pdf"))
    links = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey") % 500).alias("source_id"), name("l_partkey", "file ").alias("source_name"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("target_id"), name("l_suppkey", "File ").alias("target_name"),
    )
    return resolve.resolved_links(links, _named_docs(spark, d)).select("l_orderkey", "l_linenumber", "source", "target")


@query("paths_by_name", r"""WITH f AS (SELECT lower(regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1)) AS name, min(url) AS source_path FROM pages GROUP BY 1), r AS (SELECT page_id, upper(regexp_extract(url, '([^/]*)$', 1)) AS filename FROM pages)
    SELECT page_id, source_path FROM r LEFT JOIN f ON name = lower(regexp_extract(regexp_replace(coalesce(filename, ''), '[/\\]+$', ''), '([^/\\]*)$', 1))""")
def paths_by_name(spark, d):
    pages = table(spark, d, "pages")
    rows = pages.select("page_id", F.upper(F.regexp_extract("url", "([^/]*)$", 1)).alias("filename"))
    return resolve.paths_by_name(rows, "filename", pages.select(F.col("url").alias("path"))).select("page_id", "source_path")


@query("semantic_terms", f"""WITH t AS (SELECT conv_id AS doc_id, turn AS chunk, {PLAIN_WORDS} AS terms FROM conversations), w AS (SELECT DISTINCT doc_id, chunk, unnest(terms) AS term FROM t), a AS (SELECT doc_id, chunk, list_sort(list(term)) AS allowed FROM w WHERE chunk % 3 > 0 AND length(term) % 5 = doc_id % 5 GROUP BY ALL)
    SELECT doc_id, chunk, CASE WHEN allowed IS NULL THEN terms WHEN len(list_filter(terms, lambda x: list_contains(allowed, x))) > 0 THEN list_filter(terms, lambda x: list_contains(allowed, x)) ELSE allowed END AS terms FROM t LEFT JOIN a USING (doc_id, chunk)""")
def semantic_terms(spark, d):
    terms = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), tx.plain_words(F.col("text")).alias("terms"))
    allowed = terms.select("doc_id", "chunk", F.explode("terms").alias("term")).filter((F.col("chunk") % 3 > 0) & (F.length("term") % 5 == F.col("doc_id") % 5))
    return resolve.semantic_terms(terms, allowed)


@query("source_chunks", r"""WITH c AS (SELECT conv_id AS doc_id, turn AS chunk, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS plain, CASE WHEN role = 'assistant' THEN 0.75 ELSE 0.0 END AS bonus FROM conversations),
    r AS (SELECT doc_id, chunk AS row_index, unnest([plain, substr(plain, 1, 30), substr(plain, 20, 60)]) AS cand FROM c WHERE chunk % 2 = 0),
    q AS (SELECT doc_id, row_index, trim(regexp_replace(lower(cand), '\s+', ' ', 'g')) AS cand FROM r), s AS (SELECT q.doc_id, row_index, c.chunk, bonus, CASE WHEN cand = '' THEN 0.0 WHEN cand = plain THEN 10.0 + length(cand) / 100.0 WHEN contains(plain, cand) THEN 7.0 + length(cand) / 100.0
        WHEN len(list_filter(string_split(cand, ' '), lambda p: length(p) >= 2)) > 0 THEN len(list_filter(string_split(cand, ' '), lambda p: length(p) >= 2 AND contains(plain, p))) / len(list_filter(string_split(cand, ' '), lambda p: length(p) >= 2)) * 4.0 ELSE 0.0 END AS score FROM q JOIN c ON c.doc_id = q.doc_id),
    m AS (SELECT doc_id, row_index, chunk, round(CAST(max(score) + any_value(bonus) AS DOUBLE), 6) AS score FROM s GROUP BY ALL) SELECT doc_id, 1 AS page_index, row_index, chunk, score FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, row_index ORDER BY score DESC, chunk) = 1""")
def source_chunks(spark, d):
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_index"), F.col("turn").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == "assistant", "table").otherwise("plain").alias("layout_kind"))
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = talk.filter("chunk % 2 = 0").select("doc_id", "page_index", F.col("chunk").alias("row_index"), F.array(plain, F.substring(plain, 1, 30), F.substring(plain, 20, 60)).alias("candidates"))
    return resolve.source_chunks(rows, talk)


@query("rows_with_audit", f"""{_ITEMS}, a AS (SELECT doc_id, row_index, c, row_status FROM rows_checked QUALIFY row_number() OVER (PARTITION BY doc_id, row_index ORDER BY c DESC NULLS LAST, row_status DESC) = 1)
    SELECT r.doc_id, r.row_index, CAST(CASE WHEN r.row_index % 2 = 0 THEN 1.00 ELSE a.c END AS DOUBLE) AS computed_total, CASE WHEN r.row_index % 3 = 0 THEN 'checked' ELSE a.row_status END AS row_status FROM rows_checked r JOIN a USING (doc_id, row_index)""")
def rows_with_audit(spark, d):
    audit = totals.verify_rows(line_items(spark, d))
    rows = audit.select("doc_id", "row_index", F.when(F.col("row_index") % 2 == 0, F.lit(1).cast("decimal(18,2)")).alias("computed_total"), F.when(F.col("row_index") % 3 == 0, "checked").alias("row_status"))
    return resolve.rows_with_audit(rows, audit, ["doc_id", "row_index"], ["computed_total", "row_status"]).withColumn("computed_total", F.col("computed_total").cast("double"))


_TAGGED = f"tk AS (SELECT doc_id, t AS token, CASE WHEN t LIKE '%ly' THEN 'ADVP' WHEN length(t) % 7 = 0 THEN 'MD' ELSE 'NN' END AS pos FROM (SELECT doc_id, unnest({WORDS}) AS t FROM talks))"


def _tagged(items):
    words = items.select("doc_id", F.explode_outer(tx.words(F.col("text"))).alias("token")).filter("token IS NOT NULL")
    return words.withColumns({"lemma": F.col("token"), "pos": F.when(F.col("token").endswith("ly"), "ADVP").when(F.length("token") % 7 == 0, "MD").otherwise("NN")})


@query("unblocked_topics", f"""{_TALKS}, {_TAGGED}, norm AS (SELECT doc_id, translate(lower(token), '{tx._ACCENTED}', '{tx._PLAIN}') AS w, pos FROM tk), noise AS (SELECT DISTINCT doc_id, w FROM norm WHERE pos <> 'NN' OR w IN ({in_list(resolve.GRAMMAR_STOPWORDS)})),
    blocked AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, term, unnest(string_split(term, ' ')) AS w FROM topics) SEMI JOIN noise USING (doc_id, w)) SELECT doc_id, rank, term, score FROM topics ANTI JOIN blocked USING (doc_id, term)""")
def unblocked_topics(spark, d):
    items, topics = _item_topics(spark, d)
    return resolve.unblocked_topics(topics, _tagged(items)).select("doc_id", "rank", "term", "score")


@query("topics_from_chunks", f"""WITH talks AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1), {_TERMS.replace('documents', 'talks')}, w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df, sum(tf) OVER (PARTITION BY doc_id, chunk) AS total FROM by_chunk),
    sc AS (SELECT doc_id, chunk, term, round(CAST(tf / total * ln(1 + (c + 1) / df) * CASE WHEN length(term) > 42 THEN 0.7 WHEN contains(term, ' ') THEN 1.2 ELSE 1.0 END AS DOUBLE), 6) AS score FROM w JOIN c USING (doc_id)),
    top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY score DESC, term) <= 3), s AS (SELECT doc_id, term, round(sum(score), 6) AS score FROM top GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term, score, rank <= 2 AS is_primary FROM s QUALIFY rank <= 12""")
def topics_from_chunks(spark, d):
    from ..operators import ranking

    return resolve.topics_from_chunks(ranking.chunk_topics(_item_topics(spark, d)[0]))


@query("merged_languages", f"""WITH s AS (SELECT doc_id, lang, 2 AS w, 0 AS seq FROM documents UNION ALL SELECT doc_id, {_GRAMMAR}, 1, 1 FROM documents UNION ALL SELECT doc_id, {_LAYOUT}, 0, 2 FROM documents),
    c AS (SELECT doc_id, lower(trim(lang)) AS lang, CAST(sum(greatest(w, 1)) AS BIGINT) AS n, min(seq) AS seq FROM s WHERE trim(lang) <> '' GROUP BY ALL)
    SELECT doc_id, list(lang ORDER BY n DESC, seq, lang) AS languages, first(lang ORDER BY n DESC, seq, lang) AS "primary", list(n ORDER BY n DESC, seq, lang) AS counts FROM c GROUP BY 1""")
def merged_languages(spark, d):
    docs = table(spark, d, "documents")
    one = lambda lang, w: docs.select("doc_id", lang.alias("lang"), F.lit(w).alias("weight"))
    return resolve.merged_languages(one(F.col("lang"), 2), one(tx.language_of_grammar(F.col("text")), 1), one(tx.language_of_layout(F.col("text")), 0))


_COPIES = "c AS (SELECT doc_id % 60 AS key, doc_id AS nth, CASE WHEN doc_id % 3 = 0 THEN 'image_only' ELSE 'text' END AS content, doc_id % 4 AS pages, text FROM documents)"


@query("best_documents", f"WITH {_COPIES} SELECT key, nth, content, pages FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY CAST(content = 'image_only' AS INT), pages DESC, length(coalesce(text, '')) DESC, nth) = 1")
def best_documents(spark, d):
    key = F.col("doc_id")
    rows = table(spark, d, "documents").select((key % 60).alias("key"), key.alias("nth"), F.when(key % 3 == 0, "image_only").otherwise("text").alias("content"), (key % 4).alias("pages"), "text")
    return resolve.best_documents(rows, "key").select("key", "nth", "content", "pages")


@query("best_extraction", "WITH c AS (SELECT user_id AS key, event_id AS nth, event_id % 5 AS n FROM events) SELECT key, nth, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, nth) = 1")
def best_extraction(spark, d):
    n = F.col("event_id") % 5
    fields = F.map_from_arrays(F.slice(F.array(*[F.lit(f"f{i}") for i in range(4)]), F.lit(1), n.cast("int")), F.slice(F.array(*[F.lit("v")] * 4), F.lit(1), n.cast("int")))
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("nth"), fields.alias("fields"))
    return resolve.best_extraction(rows, "key", "fields", "nth").select("key", "nth", F.size("fields").cast("long").alias("n"))


@query("reindexed_tables", """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS row_index, l_suppkey % 4 AS table_index, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS nth FROM lineitem)
    SELECT doc_id, row_index AS was, dense_rank() OVER (PARTITION BY doc_id ORDER BY table_index) AS table_index, row_number() OVER (PARTITION BY doc_id, table_index ORDER BY row_index) AS row_index FROM l""")
def reindexed_tables(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("was"), (F.col("l_suppkey") % 4).alias("table_index"), (F.col("l_linenumber") * 10).alias("row_index"))
    return resolve.reindexed(rows, ["doc_id"], "table_index", "row_index")


@query("packed_pages", "SELECT conv_id AS doc_id, list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) AS pages_text, count(*) AS page_count FROM conversations GROUP BY 1")
def packed_pages(spark, d):
    return resolve.packed_pages(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.col("text").alias("page_text")), ["doc_id"])


@query("page_text_sources", "SELECT doc_id, md5(coalesce(a, b)) AS present, md5(coalesce(nullif(trim(a), ''), b)) AS filled FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ' ' ELSE lang END AS a, text AS b FROM documents)")
def page_text_sources(spark, d):
    key = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(key % 3 == 1, " ").when(key % 3 == 2, F.col("lang")).alias("a"), F.col("text").alias("b"))
    return rows.select("doc_id", F.md5(tx.first_present("a", "b")).alias("present"), F.md5(tx.first_filled("a", "b")).alias("filled"))


@query("synced_results", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS BIGINT) ELSE d.n_chars END AS n_chars, l.toxic AS toxic, d.lang FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels ORDER BY doc_id, quality, toxic) l ON d.doc_id = l.doc_id")
def synced_results(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("m")).select("doc_id", F.col("m.quality").cast("long").alias("n_chars"), "m.toxic")
    return resolve.synced(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), labels, "doc_id", ["n_chars", "toxic"])


@query("totals_quality_checks", f"""{_CHECKED}, i AS (SELECT doc_id, count(*) AS n FROM rows_checked WHERE row_status = 'mismatch' GROUP BY 1), qc AS (SELECT k.doc_id, verification_status AS status, coalesce(n, 0) AS n_issues FROM documents_checked k LEFT JOIN i ON i.doc_id = k.doc_id)
    SELECT * FROM qc WHERE n_issues > 0 OR status NOT IN ('ok', 'partial_ok')""")
def totals_quality_checks(spark, d):
    rows = totals.verify_rows(line_items(spark, d))
    return resolve.quality_checks(totals.verify_documents(rows, declared_totals(rows)), totals.issues(rows, 1 << 30))


@query("visual_marks_attached", "WITH m AS (SELECT user_id, count(*) AS n_marks, list_sort(list(DISTINCT event_type)) AS mark_kinds FROM events WHERE event_id % 4 = 0 GROUP BY 1) SELECT c_custkey AS user_id, coalesce(n_marks, 0) AS n_marks, coalesce(mark_kinds, []) AS mark_kinds, n_marks IS NOT NULL AS has_marks FROM customer LEFT JOIN m ON user_id = c_custkey")
def visual_marks_attached(spark, d):
    marks = table(spark, d, "events").filter("event_id % 4 = 0").select("user_id", F.col("event_type").alias("kind"))
    return resolve.with_marks(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", marks)


@query("document_summary", """WITH i AS (SELECT l_orderkey AS k, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1), x AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey AS doc_id, discount, i.n AS n_items, i.n IS NOT NULL AS has_items, x.n AS n_errors, x.n IS NOT NULL AS has_errors FROM orders LEFT JOIN i ON i.k = o_orderkey LEFT JOIN x ON x.k = o_orderkey""")
def document_summary(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    items = lines.filter("l_quantity > 25")
    return resolve.document_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), "doc_id", {"discount": (items, "l_discount")}, items=items, errors=lines.filter("l_returnflag = 'R'"))


@query("neighbour_alignment", """WITH w AS (SELECT conv_id AS doc_id, turn AS line, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w), s AS (SELECT doc_id, line, list(pos ORDER BY i) FILTER (x <> '') AS st FROM p GROUP BY ALL),
    n AS (SELECT doc_id, line, coalesce(st, []) AS st, coalesce(lag(st) OVER v, []) AS up, coalesce(lead(st) OVER v, []) AS down FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, 1 AS page_index, line, len(st) AS n_tokens, CASE WHEN len(st) > 0 AND len(up) > 0 THEN round(len(list_filter(st, lambda a: len(list_filter(up, lambda b: abs(a - b) <= 3)) > 0)) / len(st), 6) ELSE 0.0 END AS "before",
        CASE WHEN len(st) > 0 AND len(down) > 0 THEN round(len(list_filter(st, lambda a: len(list_filter(down, lambda b: abs(a - b) <= 3)) > 0)) / len(st), 6) ELSE 0.0 END AS "after" FROM n""")
def neighbour_alignment(spark, d):
    lines = table(spark, d, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_index"), F.col("turn").alias("line"), "text")
    return resolve.neighbour_alignment(lines)


@query("merged_blocks", """WITH b AS (SELECT source AS doc_id, doc_id AS place, 0 AS s, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
    u AS (SELECT * FROM b UNION ALL SELECT doc_id, place + 1000000, 1, l FROM b WHERE place % 2 = 0) SELECT doc_id, place AS "at", len(l) AS n FROM u WHERE len(l) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, l[1], l[-1], len(l) ORDER BY s, place) = 1""")
def merged_blocks(spark, d):
    one = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("at"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    merged = resolve.merged_blocks(one, one.filter("at % 2 = 0").withColumn("at", F.col("at") + 1_000_000))
    return merged.select("doc_id", "at", F.size(F.filter("lines", lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).alias("n"))


@query("profile_purge", "SELECT doc_id, lang AS ml50_topics FROM documents")
def profile_purge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("ml50_topics"), F.col("source").alias("ml100_topics"))
    return resolve.without_sections(docs, "50ml")


@query("ocr_fallback", """SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND (n = 0 OR (numeric_rows <= 2 AND richest < 5)) AS wanted FROM (SELECT o_orderkey, o_custkey % 3 AS n, o_custkey % 6 AS numeric_rows, o_orderkey % 9 AS richest FROM orders)""")
def ocr_fallback(spark, d):
    path = F.when(F.col("o_orderkey") % 2 == 0, "scan.TIFF").otherwise("text.pdf")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), resolve.wants_ocr(path, F.col("o_custkey") % 3, F.col("o_custkey") % 6, F.col("o_orderkey") % 9).alias("wanted"))


_SETS = {"en": [("email", "email-1", tx.EMAIL, 0, True, "a")], "common": [("year", "year-1", r"\b(?:19|20)[0-9]{2}\b", 0, True, "a")]}


@query("routed_matches", rf"""{_DECIDED}, r AS (SELECT doc_id, unnest(CASE WHEN doc_type = 'ENGLISH_PROSE' THEN ['en', 'common'] ELSE ['common'] END) AS ruleset FROM decided), t AS (SELECT r.doc_id, ruleset, coalesce(text, '') AS t FROM r JOIN documents d ON d.doc_id = r.doc_id),
    m AS (SELECT doc_id, ruleset, CASE ruleset WHEN 'en' THEN regexp_extract_all(t, '[\w.%+\-]+@[A-Za-z\d.\-]+\.[A-Za-z]{{2,}}') ELSE regexp_extract_all(t, '\b(?:19|20)[0-9]{{2}}\b') END AS l FROM t)
    SELECT doc_id, ruleset, unnest(l) AS value, generate_subscripts(l, 1) AS match_no FROM m""")
def routed_matches(spark, d):
    docs = table(spark, d, "documents")
    decided = classify.decisions(docs, classify.scores(pages_of(docs)))
    return extract.routed_matches(pages_of(docs), decided, _SETS, {"ENGLISH_PROSE": ["en"]}).select("doc_id", "ruleset", "value", "match_no")


@query("topics_or_common", f"""{_TALKS}, half AS (SELECT * FROM topics WHERE doc_id % 2 = 0 AND (contains(term, ' ') OR {INFORMATIVE.replace('(t ', '(term ').replace('length(t)', 'length(term)').replace(' t IN', ' term IN').replace('replace(t,', 'replace(term,')})),
    st AS (SELECT DISTINCT doc_id, chunk, unnest(list_filter({PLAIN_WORDS}, lambda t: {INFORMATIVE})) AS term FROM sent), cm AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS score FROM st ANTI JOIN half USING (doc_id) GROUP BY ALL),
    u AS (SELECT doc_id, term, score FROM half UNION ALL SELECT doc_id, term, score FROM cm) SELECT doc_id, term, score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 14""")
def topics_or_common(spark, d):
    items, topics = _item_topics(spark, d)
    return linking.topics_or_common(topics.filter("doc_id % 2 = 0"), linking.sentence_terms(items))


@query("compact_keywords", """SELECT p_partkey AS id, p_brand AS keyword, CAST(p_size AS BIGINT) AS count, CAST(p_size - 25 AS DOUBLE) AS score, 'weak' AS bucket FROM part UNION ALL SELECT p_partkey + 10000000, trim(p_name), NULL, NULL, NULL FROM part""")
def compact_keywords(spark, d):
    part = table(spark, d, "part")
    written = part.select(F.col("p_partkey").alias("id"), tx.compact_keyword_text(F.col("p_brand"), F.col("p_size"), F.col("p_size") - 25, F.lit("weak")).alias("t"))
    both = written.unionByName(part.select((F.col("p_partkey") + 10_000_000).alias("id"), F.col("p_name").alias("t")))
    return both.select("id", tx.compact_keyword(F.col("t")).alias("k")).select("id", "k.*")


@query("labelled_totals", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'total_ttc' WHEN 1 THEN 'amount_due' WHEN 2 THEN 'tax' ELSE 'total' END AS key,
    CASE o_orderkey % 4 WHEN 0 THEN 'Total TTC' WHEN 1 THEN 'Montant a payer' WHEN 2 THEN 'TVA' ELSE 'Montant' END AS label, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders""")
def labelled_totals(spark, d):
    from ..operators import tables

    label = F.element_at(F.array(*[F.lit(x) for x in ("Total TTC", "Montant a payer", "TVA", "Montant")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(label, F.lit(" : "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" EUR")).alias("text"))
    return tables.labelled_totals(lines).withColumn("amount", F.col("amount").cast("double"))
