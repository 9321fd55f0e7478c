"""Queries of layout and extraction."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as tx
from ..operators import classify, extract, layout, table_blocks
from .common import SENTENCES, pages_of, query, sentences_of, table
from .text_queries import _DECIDED, _GRAMMAR

_LINES = "ln AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def _lines(spark, d):
    return layout.lines(pages_of(table(spark, d, "documents")))


@query("line_offsets", f"WITH {_LINES} SELECT doc_id, line, length(text) AS n, coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM ln")
def line_offsets(spark, d):
    return _lines(spark, d).select("doc_id", "line", F.length("text").alias("n"), "start")


@query("noise_lines", f"""WITH {_LINES}, k AS (SELECT source AS doc, doc_id, regexp_replace(lower(trim(ln.text)), '[0-9]+', '#', 'g') AS key FROM ln JOIN documents USING (doc_id)), p AS (SELECT doc, count(DISTINCT doc_id) AS n FROM k GROUP BY 1),
    c AS (SELECT doc, key, count(DISTINCT doc_id) AS pages FROM k WHERE key <> '' GROUP BY ALL) SELECT doc AS doc_id, md5(key) AS key, pages FROM c JOIN p USING (doc) WHERE n >= 3 AND pages >= greatest(3, ceil(n * 0.05))""")
def noise_lines(spark, d):
    docs = table(spark, d, "documents")
    cut = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return layout.noise_lines(cut, share=0.05).withColumn("key", F.md5("key"))


@query("paragraph_split", """WITH s AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^\\s*[0-9]{1,3}(?:\\.[0-9]{1,3})*[.)]?\\s+\\S'))) AS a, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^\\s*(?:[A-Z]|[IVXLC]{1,6})[.)]\\s+\\S'))) AS b, regexp_matches(coalesce(text, ''), '\\n[ \\t]*\\n') AS c FROM documents)
    SELECT doc_id, CASE WHEN a >= 2 OR b >= 3 THEN 'sections' WHEN c THEN 'paragraphs' ELSE 'sentences' END AS style FROM s""")
def paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", layout.chunk_style(F.col("text")).alias("style"))


_STYLE = """CASE WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*[0-9]{1,3}(?:\\.[0-9]{1,3})*[.)]?\\s+\\S'))) >= 2 OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:[A-Z]|[IVXLC]{1,6})[.)]\\s+\\S'))) >= 3 THEN 'sections'
    WHEN regexp_matches(t, '\\n[ \\t]*\\n') THEN 'paragraphs' ELSE 'sentences' END"""


@query("universal_chunks", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), y AS (SELECT *, {_STYLE} AS style FROM t),
    c AS (SELECT doc_id, list_filter(list_transform(CASE style WHEN 'sections' THEN string_split(regexp_replace(t, '\\n(\\s*(?:[0-9]{{1,3}}(?:\\.[0-9]{{1,3}})*[.)]?|(?:[A-Z]|[IVXLC]{{1,6}})[.)])\\s+\\S)', chr(1) || '\\1', 'g'), chr(1))
        WHEN 'paragraphs' THEN regexp_split_to_array(t, '\\n[ \\t]*\\n\\s*') ELSE string_split(regexp_replace(t, '([.!?:;\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)) END, lambda x: trim(x)), lambda x: x <> '') AS l FROM y),
    s AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS chunk FROM c), n AS (SELECT *, lower(trim(text)) AS t, length(regexp_replace(text, '\\s', '', 'g')) AS nonspace FROM s)
    SELECT doc_id, chunk, md5(text) AS chunk_md5, nonspace, nonspace >= 12 AND NOT (NOT regexp_matches(t, '[a-z0-9à-ÿ؀-ۿ]') OR regexp_matches(t, '^(?:page\\s*)?[0-9]{{1,4}}(?:\\s*(?:/|of|sur)\\s*[0-9]{{1,4}})?$')) AS is_sentence FROM n""")
def universal_chunks(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(layout.chunks(F.col("text"))).alias("chunk", "text"))
    return cut.select("doc_id", "chunk", F.md5("text").alias("chunk_md5"), layout.nonspace(F.col("text")).alias("nonspace"), layout.is_sentence(F.col("text")).alias("is_sentence"))


@query("noise_chunks", f"""WITH {SENTENCES}, t AS (SELECT doc_id, chunk, lower(trim(text)) AS t, length(regexp_replace(text, '\\s', '', 'g')) AS nonspace FROM sent),
    n AS (SELECT *, NOT regexp_matches(t, '[a-z0-9à-ÿ؀-ۿ]') OR regexp_matches(t, '^(?:page\\s*)?[0-9]{{1,4}}(?:\\s*(?:/|of|sur)\\s*[0-9]{{1,4}})?$') AS is_noise FROM t) SELECT doc_id, chunk, nonspace, is_noise, nonspace >= 12 AND NOT is_noise AS is_sentence FROM n""")
def noise_chunks(spark, d):
    c = F.col("text")
    return sentences_of(table(spark, d, "documents")).select("doc_id", "chunk", layout.nonspace(c).alias("nonspace"), layout.is_noise(c).alias("is_noise"), layout.is_sentence(c).alias("is_sentence"))


@query("layout_blocks", f"""WITH {_LINES}, h AS (SELECT *, {' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in layout.TABLE_HINTS)} AS hints, len(regexp_extract_all(trim(text), ' {{6,}}')) AS gaps,
        len(list_filter(string_split_regex(text, '\\t| {{6,}}'), lambda x: trim(x) <> '')) AS parts FROM ln WHERE trim(text) <> ''),
    k AS (SELECT doc_id, line, CASE WHEN len(regexp_extract_all(text, '\\t')) >= 2 OR hints >= 2 OR (gaps >= 2 AND regexp_matches(text, '[0-9]')) THEN 'table' WHEN parts >= 2 THEN 'multicol' ELSE 'plain' END AS kind FROM h),
    g AS (SELECT *, coalesce(lag(kind) OVER w <> kind OR (kind = 'plain' AND line - lag(line) OVER w > 1), true) AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    b AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS block FROM g) SELECT doc_id, block, any_value(kind) AS kind, min(line) AS first_line, max(line) AS last_line FROM b GROUP BY doc_id, block""")
def layout_blocks(spark, d):
    return layout.blocks(_lines(spark, d)).select("doc_id", "block", "kind", "first_line", "last_line")


@query("language_runs", f"""WITH {_LINES}, p AS (SELECT doc_id, line, {_GRAMMAR} AS lang FROM ln WHERE trim(text) <> ''), g AS (SELECT *, lag(lang) OVER (PARTITION BY doc_id ORDER BY line) IS DISTINCT FROM lang AS fresh FROM p),
    r AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS run FROM g) SELECT doc_id, run, any_value(lang) AS lang, min(line) AS "first", max(line) AS "last", count(*) AS n FROM r GROUP BY doc_id, run""")
def language_runs(spark, d):
    pieces = _lines(spark, d).filter(F.trim("text") != "").select("doc_id", "line", tx.language_of_grammar(F.col("text")).alias("lang"))
    return layout.language_runs(pieces, "line", "lang")


@query("extract_rules_long")
def extract_rules_long(spark, d):
    return extract.matches(pages_of(table(spark, d, "documents")))


_EMAILS = r"regexp_extract_all(coalesce(text, ''), '[\w.%+\-]+@[A-Za-z\d.\-]+\.[A-Za-z]{2,}')"


@query("extract_emails", f"WITH e AS (SELECT doc_id, {_EMAILS} AS l FROM documents) SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS match_no FROM e")
def extract_emails(spark, d):
    return extract.matches(pages_of(table(spark, d, "documents")), extract.RULES[:1]).select("doc_id", "value", "match_no")


@query("extract_missing_fields", f"SELECT doc_id, 'email' AS field, len({_EMAILS}) AS n, {_EMAILS}[1] AS first_value FROM documents")
def extract_missing_fields(spark, d):
    docs, rules = table(spark, d, "documents"), extract.RULES[:1]
    return extract.fields(docs, extract.matches(pages_of(docs), rules), rules)


@query("route_rulesets", f"{_DECIDED} SELECT doc_id, unnest(CASE doc_type WHEN 'ENGLISH_PROSE' THEN ['en', 'prose', 'common'] WHEN 'FRENCH_PROSE' THEN ['fr', 'prose', 'common'] WHEN 'GERMAN_PROSE' THEN ['prose', 'common'] ELSE ['common'] END) AS ruleset FROM decided")
def route_rulesets(spark, d):
    docs = table(spark, d, "documents")
    decided = classify.decisions(docs, classify.scores(pages_of(docs)))
    return extract.routed(decided, {"ENGLISH_PROSE": ["en", "prose"], "FRENCH_PROSE": ["fr", "prose"], "GERMAN_PROSE": ["prose"]})


@query("label_value")
def label_value(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.concat_ws(": ", "role", "text").alias("text"))
    return extract.label_values(turns)


@query("key_values", "SELECT conv_id, turn, role || ': ' || trim(text) AS line FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\n|^\\s*$')")
def key_values(spark, d):
    turns = table(spark, d, "conversations").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"\n|^\s*$"))
    return turns.select("conv_id", "turn", layout.key_value(F.concat_ws("   ", "role", F.trim("text"))).alias("line"))


@query("html_to_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text FROM pages")
def html_to_text(spark, d):
    from ..sources.files import html_text

    return table(spark, d, "pages").select("page_id", F.md5(html_text(F.col("html"))).alias("text"))


def _invoices(spark, d):
    """Orders as pages of text: a heading, a table with aligned columns, a total."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    items = table(spark, d, "lineitem").withColumn("nth", F.row_number().over(order))
    row = F.concat(F.rpad(F.concat(F.lit("P-"), "l_partkey"), 14, " "), F.rpad(F.col("l_quantity").cast("int").cast("string"), 10, " "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    packed = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", row.alias("row")))).alias("rows"))
    head = F.concat(F.rpad(F.lit("Reference"), 14, " "), F.rpad(F.lit("Qty"), 10, " "), F.lit("Price"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("Order "), "l_orderkey"), F.lit(""), head), F.transform("rows", lambda r: r["row"]), F.array(F.lit("Total HT 1.00"))), "\n")
    return packed.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_index"), text.alias("text"))


@query("table_rows", """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS nth, ['P-' || l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)] AS cells FROM lineitem),
    u AS (SELECT DISTINCT doc_id, 0 AS nth, ['Reference', 'Qty', 'Price'] AS cells FROM r UNION ALL SELECT * FROM r) SELECT doc_id, 1 AS page_index, 1 AS block, nth + 1 AS "row", nth + 2 AS line, cells FROM u""")
def table_rows(spark, d):
    return table_blocks.table_rows(_invoices(spark, d)).filter("block = 1")


@query("line_tabularity", r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM l)
    SELECT doc_id, 1 AS page_index, line, len(regexp_extract_all(t, '\S+')) AS n_tokens FROM n""")
def line_tabularity(spark, d):
    return table_blocks.line_scores(pages_of(table(spark, d, "documents"))).select("doc_id", "page_index", "line", "n_tokens")
