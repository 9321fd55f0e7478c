"""Queries of the text functions, classification, ranking and linking."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as tx
from ..operators import classify, linking, ranking
from .common import ACCENTS, CANDIDATE, INFORMATIVE, NORMAL, PLAIN_WORDS, SENTENCES, WORDS, in_list, pages_of, query, sentences_of, table

_RULES = ", ".join(f"('{t}', {p}, '{b}', '{k.upper()}', {classify.WEIGHTS[b]})" for t, p, b, k in classify.RULES)
_HITS = f"""rules(doc_type, priority, bucket, keyword, weight) AS (VALUES {_RULES}),
    normal AS (SELECT doc_id, ' ' || replace({NORMAL}, ' ', '  ') || ' ' AS t FROM documents),
    counted AS (SELECT doc_id, rules.*, (length(t) - length(replace(t, ' ' || keyword || ' ', ''))) // (length(keyword) + 2) AS n FROM normal, rules),
    hits AS (SELECT *, CAST(trunc(n * weight * CAST(1.2 AS DOUBLE)) AS BIGINT) AS score FROM counted WHERE n > 0),
    met AS (SELECT doc_id, doc_type, CAST(sum(score) AS BIGINT) AS s FROM hits GROUP BY ALL),
    scores AS (SELECT doc_id, doc_type, priority, coalesce(s, 0) AS score FROM documents CROSS JOIN (SELECT DISTINCT doc_type, priority FROM rules) LEFT JOIN met USING (doc_id, doc_type)),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority DESC, doc_type) AS rank FROM scores)"""


@query("classify_scores", f"WITH {_HITS} SELECT doc_id, doc_type, score, rank, rank = 1 AS is_winner FROM ranks")
def classify_scores(spark, d):
    docs = table(spark, d, "documents")
    return classify.ranked(docs, classify.scores(pages_of(docs))).select("doc_id", "doc_type", "score", "rank", "is_winner")


_DECIDED = f"""WITH {_HITS}, top AS (SELECT doc_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b, max(CASE WHEN rank = 1 THEN doc_type END) AS t FROM ranks GROUP BY 1),
    paired AS (SELECT d.doc_id, coalesce(a, 0) AS top_score, coalesce(b, 0) AS second_score, t FROM documents d LEFT JOIN top USING (doc_id)),
    sure AS (SELECT *, top_score > 0 AND top_score >= 6 AND top_score - second_score >= 3 AS ok FROM paired),
    decided AS (SELECT doc_id, CASE WHEN ok THEN t ELSE 'UNCLASSIFIED' END AS doc_type, CASE WHEN ok THEN 'OK' ELSE 'REVIEW' END AS status, top_score, second_score, top_score - second_score AS margin FROM sure)"""


@query("classify_documents", f"{_DECIDED} SELECT * FROM decided")
def classify_documents(spark, d):
    docs = table(spark, d, "documents")
    return classify.decisions(docs, classify.scores(pages_of(docs)))


@query("classify_audit", f"WITH {_HITS} SELECT doc_id, doc_type, bucket, keyword, n, score, row_number() OVER (PARTITION BY doc_id ORDER BY abs(score) DESC, n DESC, keyword, bucket, doc_type) AS rank FROM hits QUALIFY rank <= 200")
def classify_audit(spark, d):
    return classify.audit(pages_of(table(spark, d, "documents")))


@query("join_classification", f"{_DECIDED} SELECT source, doc_type, status, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN decided USING (doc_id) GROUP BY ALL")
def join_classification(spark, d):
    docs = table(spark, d, "documents")
    found = classify.decisions(docs, classify.scores(pages_of(docs)))
    both = docs.select("doc_id", "source", "n_chars").join(found, "doc_id", "left").withColumns({"doc_type": F.coalesce("doc_type", F.lit("UNCLASSIFIED")), "status": F.coalesce("status", F.lit("REVIEW"))})
    return both.groupBy("source", "doc_type", "status").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


_LATIN = "regexp_extract_all(lower(substr({0}, 1, 8000)), '[A-Za-zÀ-ÖØ-öø-ÿ]+')"
_ARABIC = "len(regexp_extract_all({0}, '[؀-ۿݐ-ݿࢠ-ࣿ]'))"


def _hint(text: str, hints) -> str:
    return f"len(list_filter({_LATIN.format(text)}, lambda w: w IN ({in_list(hints)})))"


_T, _TRIMMED = "coalesce(text, '')", "trim(coalesce(text, ''))"
_LAYOUT = f"""CASE WHEN ({_ARABIC.format(_T)} >= 6 AND {_ARABIC.format(_T)} >= 0.02 * length({_T})) OR ({_ARABIC.format(_T)} > 0 AND NOT regexp_matches({_T}, '[A-Za-zÀ-ÖØ-öø-ÿ]')) THEN 'ar'
    WHEN len({_LATIN.format(_T)}) > 0 AND {_hint(_T, tx.HINTS['fr'])} + CASE WHEN regexp_matches(lower({_T}), '[èéêëàùçôîï]') THEN 1 ELSE 0 END >= {_hint(_T, tx.HINTS['en'])} THEN 'fr' ELSE 'en' END"""
_GRAMMAR = f"""CASE WHEN {_ARABIC.format(_TRIMMED)} > 0 THEN 'ar'
    WHEN {_hint(_TRIMMED, tx.GRAMMAR_HINTS['fr'])} + CASE WHEN regexp_matches(lower({_TRIMMED}), '[éèêàùçôîï]') THEN 2 ELSE 0 END > {_hint(_TRIMMED, tx.GRAMMAR_HINTS['en'])} THEN 'fr' ELSE 'en' END"""


@query("language_detect", f"SELECT doc_id, lang, {_LAYOUT} AS layout_lang, {_GRAMMAR} AS grammar_lang FROM documents")
def language_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", tx.language_of_layout(F.col("text")).alias("layout_lang"), tx.language_of_grammar(F.col("text")).alias("grammar_lang"))


@query("language_histogram", f"""WITH l AS (SELECT source, {_GRAMMAR} AS found FROM documents), c AS (SELECT source, found, count(*) AS n FROM l GROUP BY ALL)
    SELECT source, found, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, found) AS rank FROM c""")
def language_histogram(spark, d):
    counts = table(spark, d, "documents").groupBy("source", tx.language_of_grammar(F.col("text")).alias("found")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "found")))


@query("normalise_text", f"SELECT doc_id, md5({NORMAL}) AS normal, md5(lower(translate(trim(coalesce(text, '')), {ACCENTS}))) AS term, length({NORMAL}) AS n FROM documents")
def normalise_text(spark, d):
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = tx.classifier_normal(text)
    return table(spark, d, "documents").select("doc_id", F.md5(normal).alias("normal"), F.md5(F.lower(tx.strip_accents(F.trim(text)))).alias("term"), F.length(normal).alias("n"))


@query("word_counts", f"SELECT doc_id, len({WORDS}) AS n_words, len(list_distinct({WORDS})) AS n_distinct FROM documents")
def word_counts(spark, d):
    found = tx.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n_words"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query("top_words", f"WITH w AS (SELECT unnest({WORDS}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 200")
def top_words(spark, d):
    return table(spark, d, "documents").select(F.explode_outer(tx.words(F.col("text"))).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200)


@query("informative_terms", f"WITH w AS (SELECT doc_id, unnest({PLAIN_WORDS}) AS t FROM documents) SELECT doc_id, count(*) FILTER ({INFORMATIVE}) AS informative, count(*) FILTER ({CANDIDATE}) AS candidates FROM w GROUP BY 1")
def informative_terms(spark, d):
    return ranking.term_counts(table(spark, d, "documents"))


@query("bigrams", f"""WITH w AS (SELECT doc_id, list_filter({PLAIN_WORDS}, lambda t: {INFORMATIVE}) AS l FROM documents), p AS (SELECT unnest(list_transform(list_zip(l[1:len(l) - 1], l[2:len(l)]), lambda z: z[1] || ' ' || z[2])) AS term FROM w WHERE len(l) > 1)
    SELECT term, count(*) AS n FROM p GROUP BY 1""")
def bigrams(spark, d):
    kept = F.filter(tx.plain_words(F.col("text")), tx.is_informative)
    pairs = lambda k: F.slice(tx.with_bigrams(k), F.size(k) + 1, F.greatest(F.size(k) - 1, F.lit(0)))
    terms = table(spark, d, "documents").select(F.explode_outer(F.element_at(F.transform(F.array(kept), pairs), 1)).alias("term")).filter("term IS NOT NULL")
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query("char_ngrams", """WITH w AS (SELECT DISTINCT '<' || c_mktsegment || '>' AS m FROM customer WHERE c_mktsegment IS NOT NULL), g AS (SELECT m, n, unnest(list_transform(generate_series(1, length(m) - n + 1), lambda i: substr(m, i, n))) AS gram FROM w, (VALUES (3), (4), (5)) AS s(n) WHERE length(m) >= n)
    SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def char_ngrams(spark, d):
    names = table(spark, d, "customer").select("c_mktsegment").dropna().distinct()
    return names.select(F.explode(tx.char_ngrams(F.col("c_mktsegment"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("sentence_split", f"WITH {SENTENCES} SELECT doc_id, chunk, md5(text) AS sentence, length(text) AS n_chars FROM sent")
def sentence_split(spark, d):
    return sentences_of(table(spark, d, "documents")).select("doc_id", "chunk", F.md5("text").alias("sentence"), F.length("text").alias("n_chars"))


@query("excerpts", "SELECT doc_id, CASE WHEN length(text) > 220 THEN rtrim(substr(text, 1, 217)) || '...' ELSE text END AS excerpt, CASE WHEN length(text) > 400 THEN rtrim(substr(text, 1, 397)) || '...' ELSE text END AS preview FROM documents")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clipped(F.col("text")).alias("excerpt"), tx.clipped(F.col("text"), 400).alias("preview"))


_EMAIL = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '([\w.%+\-]+@[A-Za-z\d.\-]+\.[A-Za-z]{2,})', 1), lambda e: lower(regexp_replace(e, '\.+$', ''))))"
_URL = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '((?:www\.|https?://)[^\s<>\"'')\]]+)', 1), lambda e: lower(regexp_replace(e, '[.,;:]+$', ''))))"
_PHONE = r"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '([+]?[0-9][0-9 .()/\-]*[0-9])', 1), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 10 AND 15), lambda r: CASE WHEN r[1] = '+' THEN '+' ELSE '' END || regexp_replace(r, '[^0-9]', '', 'g')))"


@query("detect_contacts", f"SELECT doc_id, list_sort({_EMAIL}) AS emails, list_sort({_URL}) AS urls, list_sort({_PHONE}) AS phones FROM documents")
def detect_contacts(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_sort(tx.emails(text)).alias("emails"), F.array_sort(tx.urls(text)).alias("urls"), F.array_sort(tx.phones(text)).alias("phones"))


_PLAIN = f"translate(lower(coalesce(text, '')), {ACCENTS})"
_CURRENCY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_PLAIN}, ' + repr(n) + ')' for n in names)} THEN '{code}'" for code, names in tx.CURRENCIES) + " END"


@query("detect_currency", f"SELECT doc_id, {_CURRENCY} AS currency FROM documents")
def detect_currency(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.currency(F.col("text")).alias("currency"))


_DATES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '[\\s,;()\\[\\]{{}}<>]+'), lambda w: trim(w, ' .,:;')), lambda w: regexp_matches(w, '{tx.DAY_FIRST}') OR regexp_matches(w, '{tx.YEAR_FIRST}'))[1] AS d FROM t),
    p AS (SELECT *, regexp_split_to_array(d, '[/.\\-]') AS l, regexp_matches(d, '{tx.DAY_FIRST}') AS dmy FROM f)
    SELECT doc_id, CASE WHEN d IS NOT NULL AND dmy THEN printf('%02d/%02d/%s', CAST(l[1] AS INT), CAST(l[2] AS INT), l[3]) WHEN d IS NOT NULL THEN printf('%s-%02d-%02d', l[1], CAST(l[2] AS INT), CAST(l[3] AS INT))
        ELSE coalesce(nullif(regexp_extract(t, '{tx.WORD_DATE[0]}'), ''), nullif(regexp_extract(t, '{tx.WORD_DATE[1]}'), '')) END AS found FROM p"""


@query("detect_dates", _DATES)
def detect_dates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_date(F.col("text")).alias("found"))


@query("detect_amount", r"""WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\s+') AS l FROM documents)), n AS (SELECT *, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n FROM w),
    b AS (SELECT doc_id, arg_min(t, i - n * 1000000) AS amount FROM n WHERE n >= 2 GROUP BY 1) SELECT doc_id, amount FROM documents LEFT JOIN b USING (doc_id)""")
def detect_amount(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.densest_amount(F.col("text")).alias("amount"))


@query("identifiers", "SELECT c_custkey AS id, regexp_replace(upper(c_name), '[^A-Z0-9]+', '', 'g') AS normal, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]+', '', 'g'), 'supplier' FROM supplier")
def identifiers(spark, d):
    one = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("id"), tx.identifier_normal(F.col(n)).alias("normal"), F.lit(t).alias("kind"))
    return one("customer", "c_custkey", "c_name").unionByName(one("supplier", "s_suppkey", "s_name"))


def _first_sentence_terms(chunks):
    return chunks.filter("chunk = 0").select("doc_id", F.array_distinct(tx.words(F.col("text"))).alias("terms"))


_BM25 = f"""WITH {SENTENCES}, t AS (SELECT doc_id, chunk, {WORDS} AS w FROM sent), about AS (SELECT doc_id, count(*) AS n_chunks, greatest(avg(len(w)), 1.0) AS avgdl FROM t GROUP BY 1),
    q AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM t WHERE chunk = 0), x AS (SELECT doc_id, chunk, len(w) AS dl, unnest(w) AS term FROM t),
    tf AS (SELECT doc_id, chunk, dl, term, count(*) AS tf FROM x GROUP BY ALL), h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf SEMI JOIN q USING (doc_id, term)),
    s AS (SELECT doc_id, chunk, sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score FROM h JOIN about USING (doc_id) GROUP BY ALL)"""


@query("bm25_chunks", f"{_BM25} SELECT doc_id, chunk, round(score, 6) AS score FROM s")
def bm25_chunks(spark, d):
    chunks = sentences_of(table(spark, d, "documents"))
    return ranking.bm25(chunks, _first_sentence_terms(chunks)).withColumn("score", F.round("score", 6))


@query("bm25_summary", f"""{_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, chunk) AS rank FROM s)
    SELECT doc_id, count(*) AS chunks_hit, round(max(score), 6) AS best_score, round(avg(score) FILTER (rank <= 3), 6) AS avg_top3_score, list(chunk ORDER BY rank) FILTER (rank <= 8) AS top_chunks FROM r GROUP BY 1""")
def bm25_summary(spark, d):
    chunks = sentences_of(table(spark, d, "documents"))
    return ranking.bm25_summary(chunks, _first_sentence_terms(chunks)).withColumns({c: F.round(c, 6) for c in ("best_score", "avg_top3_score")})


_TERMS = f"""{SENTENCES}, k AS (SELECT doc_id, chunk, list_filter({PLAIN_WORDS}, lambda t: {CANDIDATE}) AS l FROM sent),
    o AS (SELECT doc_id, chunk, unnest(l) AS term FROM k UNION ALL SELECT doc_id, chunk, unnest(list_transform(list_zip(l[1:len(l) - 1], l[2:len(l)]), lambda z: z[1] || ' ' || z[2])) FROM k WHERE len(l) > 1),
    c AS (SELECT doc_id, count(*) AS c FROM sent GROUP BY 1), by_chunk AS (SELECT doc_id, chunk, term, count(*) AS tf FROM o GROUP BY ALL)"""
_QUALITY = "CASE WHEN length(term) > 42 THEN 0.7 WHEN contains(term, ' ') THEN 1.2 ELSE 1.0 END"
_TOPICS = f"""{_TERMS}, dt AS (SELECT doc_id, term, sum(tf) AS tf, count(*) AS df FROM by_chunk GROUP BY ALL),
    sc AS (SELECT doc_id, term, round(CAST(tf * ln(1 + (c + 1) / df) * {_QUALITY} AS DOUBLE), 6) AS score FROM dt JOIN c USING (doc_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM sc)"""
_PRUNED = f"""{_TOPICS}, near AS (SELECT * FROM rk WHERE rank <= 36), pw AS (SELECT doc_id, rank, unnest(string_split(term, ' ')) AS w FROM near WHERE contains(term, ' ')),
    kept AS (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM near n WHERE contains(term, ' ') OR NOT EXISTS (SELECT 1 FROM pw WHERE pw.doc_id = n.doc_id AND pw.rank < n.rank AND pw.w = n.term)),
    topics AS (SELECT doc_id, rank, term, score FROM kept WHERE rank <= 12)"""


@query("document_topics", f"WITH {_TOPICS} SELECT doc_id, rank, term, score FROM rk WHERE rank <= 12")
def document_topics(spark, d):
    return ranking.document_topics(sentences_of(table(spark, d, "documents")), prune=False)


@query("document_topics_pruned", f"WITH {_PRUNED} SELECT * FROM topics")
def document_topics_pruned(spark, d):
    return ranking.document_topics(sentences_of(table(spark, d, "documents")))


@query("chunk_topics", f"""WITH {_TERMS}, w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df, sum(tf) OVER (PARTITION BY doc_id, chunk) AS total FROM by_chunk),
    sc AS (SELECT doc_id, chunk, term, round(CAST(tf / total * ln(1 + (c + 1) / df) * {_QUALITY} AS DOUBLE), 6) AS score FROM w JOIN c USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 3""")
def chunk_topics(spark, d):
    return ranking.chunk_topics(sentences_of(table(spark, d, "documents"))).select("doc_id", "chunk", "term", "score", "rank")


_ITEMS = f"WITH talks AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1), {_PRUNED.replace('documents', 'talks')}"


def _item_topics(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))), lambda s: s["text"])
    talks = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns, "\n").alias("text"))
    items = sentences_of(talks)
    return items, ranking.document_topics(items)


_PAIRS = "pairs AS (SELECT a.doc_id AS source, b.doc_id AS target, list_sort(list(DISTINCT a.term)) AS shared_terms, count(DISTINCT a.term) AS n_shared FROM topics a JOIN topics b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)"


@query("link_shared_terms", f"{_ITEMS}, {_PAIRS} SELECT * FROM pairs")
def link_shared_terms(spark, d):
    return linking.pair_candidates(_item_topics(spark, d)[1])


_SIGNALS = f"""long AS (SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, unnest({PLAIN_WORDS}) AS t FROM sent) WHERE length(t) >= 12 AND {INFORMATIVE}),
    sg AS (SELECT doc_id, term, bool_or(is_topic) AS is_topic FROM (SELECT doc_id, term, true AS is_topic FROM topics UNION ALL SELECT doc_id, term, false FROM long) GROUP BY ALL),
    sp AS (SELECT a.doc_id AS source, b.doc_id AS target, count(*) FILTER (a.is_topic AND b.is_topic) AS n_shared, count(*) AS n_signals FROM sg a JOIN sg b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)"""
_MATCHES = f"""{_SIGNALS}, st AS (SELECT DISTINCT doc_id, chunk, unnest(list_filter({PLAIN_WORDS}, lambda t: {INFORMATIVE})) AS term FROM sent), sz AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chunk) AS n FROM st),
    pd AS (SELECT doc_id, count(DISTINCT chunk) AS s FROM sz GROUP BY 1), dfs AS (SELECT doc_id, term, df, coalesce(is_topic, false) AS t, is_topic IS NOT NULL AS g FROM (SELECT doc_id, term, count(*) AS df FROM sz GROUP BY ALL) LEFT JOIN sg USING (doc_id, term)),
    mm AS (SELECT source, target, a.chunk AS a, b.chunk AS b, a.n AS na, b.n AS nb, a.term AS term, CAST(da.t AND db.t AS INT) AS t, CAST(da.g AND db.g AS INT) AS g,
        round(CAST(ln(1 + (pa.s + pb.s + 1) / (da.df + db.df)) + 0.85 * CAST(da.t AND db.t AS INT) + 0.55 * CAST(da.g AND db.g AS INT) + least(0.35, greatest(0.0, (length(a.term) - 4) * 0.03)) AS DOUBLE), 9) AS w
        FROM sp JOIN sz a ON a.doc_id = source JOIN sz b ON b.doc_id = target AND b.term = a.term
        JOIN dfs da ON da.doc_id = source AND da.term = a.term JOIN dfs db ON db.doc_id = target AND db.term = a.term JOIN pd pa ON pa.doc_id = source JOIN pd pb ON pb.doc_id = target),
    mt AS (SELECT *, row_number() OVER (PARTITION BY source, target, a, b ORDER BY w DESC, term) AS nth FROM mm WHERE w >= 0.85 QUALIFY nth <= 8),
    mq AS (SELECT source, target, a, b, count(*) AS n_common, CAST(sum(t) AS BIGINT) AS n_topics, sum(g) AS n_signals, sum(w) / (na + nb + 1) AS base FROM mt GROUP BY source, target, a, b, na, nb),
    ms AS (SELECT source, target, a, b, n_common, n_topics, round(CAST(base * (1 + least(0.45, 0.17 * n_topics)) * (1 + least(0.35, 0.12 * n_signals)) AS DOUBLE), 6) AS score FROM mq WHERE n_common > 1 OR n_topics + n_signals > 0),
    matches AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, a, b) AS rank FROM ms WHERE score >= 0.1 QUALIFY rank <= 14)"""


def _signals(items, topics):
    """Topics and, in place of a classification's keywords, words of twelve letters and more."""
    long = items.select("doc_id", F.explode_outer(F.array_distinct(tx.plain_words(F.col("text")))).alias("term")).filter(F.length("term") >= 12).distinct()
    return linking.signal_terms(topics, long)


@query("signal_pairs", f"{_ITEMS}, {_SIGNALS} SELECT * FROM sp")
def signal_pairs(spark, d):
    return linking.signal_pairs(_signals(*_item_topics(spark, d)))


def _linking(spark, d):
    """The sentences, their signals and their terms."""
    items, topics = _item_topics(spark, d)
    return items, _signals(items, topics), linking.sentence_terms(items)


@query("sentence_matches", f"{_ITEMS}, {_MATCHES} SELECT * FROM matches")
def sentence_matches(spark, d):
    return linking.all_matches(*_linking(spark, d)[1:])


_LINKS = f"""{_MATCHES}, tn AS (SELECT doc_id, count(*) FILTER (is_topic) AS t, count(*) AS g FROM sg GROUP BY 1), bm AS (SELECT source, target, max(score) AS s FROM matches GROUP BY ALL),
    lk AS (SELECT source, target, n_shared, n_shared / greatest(least(x.t, y.t), 1) AS t, n_signals / greatest(least(x.g, y.g), 1) AS g, coalesce(s, 0.0) AS sentence_score FROM sp LEFT JOIN bm USING (source, target) JOIN tn x ON x.doc_id = source JOIN tn y ON y.doc_id = target),
    lw AS (SELECT source, target, n_shared, round(t, 6) AS topic_score, sentence_score, round(g, 6) AS signal_score, round(CAST(0.45 * t + 0.35 * sentence_score + 0.2 * g AS DOUBLE), 6) AS score FROM lk),
    links AS (SELECT * FROM lw WHERE score >= 0.15 AND (n_shared > 0 OR signal_score >= 0.2 OR sentence_score >= 0.24))"""


@query("document_links", f"{_ITEMS}, {_LINKS} SELECT *, 'link-' || row_number() OVER (ORDER BY score DESC, source, target) AS link_id FROM links")
def document_links(spark, d):
    return linking.numbered(linking.all_links(*_linking(spark, d)[1:]))


@query("link_topic_examples", f"""{_ITEMS}, {_LINKS}, ex AS (SELECT st.*, row_number() OVER (PARTITION BY doc_id, term ORDER BY chunk) AS nth FROM st SEMI JOIN topics USING (doc_id, term) QUALIFY nth <= 2),
    sh AS (SELECT source, target, a.term AS term FROM links JOIN topics a ON a.doc_id = source JOIN topics b ON b.doc_id = target AND b.term = a.term),
    sides AS (SELECT *, 'source' AS side, source AS doc_id FROM sh UNION ALL SELECT *, 'target', target FROM sh)
    SELECT source, target, term, side, nth, chunk, CASE WHEN length(trim(text)) > 220 THEN rtrim(substr(trim(text), 1, 217)) || '...' ELSE trim(text) END AS excerpt FROM sides JOIN ex USING (doc_id, term) JOIN sent USING (doc_id, chunk)""")
def link_topic_examples(spark, d):
    items, signals, terms = _linking(spark, d)
    return linking.all_topic_examples(signals, items, terms)


@query("chunk_candidates", """WITH c AS (SELECT label AS doc_id, vec_id AS chunk, vec_id % 4 AS n_shared_topics, vec_id % 9 AS n_shared_terms, vec_id % 11 AS n_topics, vec_id % 37 AS n_tokens FROM embeddings),
    p AS (SELECT *, round(CAST(3.0 * n_shared_topics + 1.3 * n_shared_terms + 0.4 * least(n_topics, 8) + least(1.2, n_tokens / 20.0) AS DOUBLE), 6) AS priority FROM c)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, n_tokens DESC, chunk) AS rank FROM p QUALIFY rank <= 40""")
def chunk_candidates(spark, d):
    vec = F.col("vec_id")
    chunks = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), vec.alias("chunk"), *[(vec % n).alias(c) for c, n in (("n_shared_topics", 4), ("n_shared_terms", 9), ("n_topics", 11), ("n_tokens", 37))])
    return linking.chunk_candidates(chunks, linking.VECTOR_PROFILES["100ml"]["chunks"])
