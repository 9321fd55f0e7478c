"""What the second round of findings held against the queries."""

import re

import pytest

from ledgerloom.operators import ranking


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(1, 0, "Red foxes hunt red mice"), (1, 1, "red foxes sleep"), (2, 0, "Grey wolves"), (2, 1, None), (None, 0, "lost foxes")], "doc_id int, chunk int, text string")


def test_topics_and_passages_move_chunks_once(spark, chunks):
    queries = spark.createDataFrame([(1, ["foxes"]), (2, ["wolves", None])], "doc_id int, terms array<string>")
    found = [ranking.chunk_topics(chunks), ranking.document_topics(chunks), ranking.document_topics(chunks, prune=False), ranking.bm25(chunks, queries), ranking.bm25_summary(chunks, queries)]
    assert all(exchanges(df) <= 1 for df in found)
    assert {(r["doc_id"], r["chunk"]) for r in found[3].collect()} == {(1, 0), (1, 1), (2, 0)}
    assert {r["doc_id"] for r in found[0].collect()} == {1, 2}


def test_chunks_of_repeated_documents_count_like_sql(spark):
    twice = spark.createDataFrame([(1, 0, "foxes"), (1, 0, "foxes"), (1, 1, "mice")], "doc_id int, chunk int, text string")
    # C counts rows: ln(1 + (3 + 1) / 1)
    assert {(r["chunk"], r["term"], r["score"]) for r in ranking.chunk_topics(twice).collect()} == {(0, "foxes", 1.609438), (1, "mice", 1.609438)}


def test_labels_are_repaired_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from ledgerloom.functions import grammar as gr, text as tx

    words = "ab abc abcd " * 6000
    rows = spark.createDataFrame([(words,)], "text string")
    labels = F.transform(tx.words(F.col("text")), lambda w: F.when(F.length(w) % 3 == 0, "I-A").when(F.length(w) % 3 == 1, "I-B").otherwise("O"))
    begun = time.time()
    found = rows.select(gr.bio_repaired(labels).alias("l")).first()["l"]
    assert found == ["O", "B-A", "B-B"] * 6000
    assert time.time() - begun < 20


def test_unit_vectors_of_odd_rows(spark, tmp_path):
    import importlib

    from . import compare

    entry = importlib.import_module("__spark_entry__")
    odd = [None, [], [None], [3.0, None, 4.0], [0.0, 0.0], [0.0, None], [float("nan"), 1.0], [1e-30, 2e-30], [3e38, 3e38], [float("inf"), 1.0], [-0.0], [0.5, 1.5, 2.5]]
    spark.createDataFrame(list(enumerate(odd)), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert compare.difference(entry.queries()["unit_vectors"](spark, str(tmp_path)), compare.connection(tmp_path), entry.oracle_sql()["unit_vectors"]) is None


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    import importlib

    from . import compare

    entry = importlib.import_module("__spark_entry__")
    spark.createDataFrame([(0, [1.0, -1e-7, 1e-7, -0.0, 0.0]), (1, [-0.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    theirs = sorted(compare.connection(tmp_path).execute(entry.oracle_sql()["unit_vectors"]).fetchall())
    assert str(theirs) == str(sorted(tuple(r) for r in entry.queries()["unit_vectors"](spark, str(tmp_path)).collect())) and "-0.0" in str(theirs)


def test_nearest_vectors_are_no_rows_of_pairs(spark):
    import random

    from ledgerloom.functions.vectors import cosine
    from ledgerloom.operators import linking
    from pyspark.sql import functions as F

    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8 if i % 9 else 5)], i % 3, i % 4, i % 5) for i in range(240)] + [(300, None, 1, 1, 1), (301, [], 1, 1, 1), (302, [0.0] * 8, 1, 1, 1), (303, [1.0] * 8, None, 1, 1)]
    x = spark.createDataFrame(rows, "id int, vector array<double>, label int, topic int, n int")
    found = linking.similar_vectors(x, x, ["label"], 0.25, top=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    every = x.alias("l").join(x.alias("r"), F.expr("l.label = r.label AND l.id < r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(cosine(F.col("l.vector"), F.col("r.vector")), 6).alias("cosine")).filter("cosine >= 0.25").collect()
    theirs = set()
    for a in {r["a"] for r in every}:
        own = sorted((r for r in every if r["a"] == a), key=lambda r: (-r["cosine"], r["b"]))
        theirs |= {(a, r["b"], r["cosine"], k) for k, r in enumerate(own[:5], 1)}
    assert {tuple(r) for r in found.collect()} == theirs
    assert linking.chunk_matches(x, x, ["label"], 0.3, 0.3).schema["a"].dataType.simpleString() == "int"


def test_long_lines_are_read_in_linear_time():
    import time

    from ledgerloom.operators import table_blocks as tb

    raw = "word " * 40_000
    begun = time.process_time()
    one, other = tb.Line(raw), tb.Line(raw + "end")
    assert one.score(None, other) == 0.2 * 8 + 1.4 - 1.3 and len(one.segments) == 1 and one.segments[0][0] == raw.strip()
    assert time.process_time() - begun < 10
    # numbers don't tell which words a line has
    assert tb.Line("Ref 17 Qty").strong == tb._hits("REF 17 QTY", tb.STRONG) == 2


def test_batches_of_texts_are_cut_by_their_terms():
    import pyarrow as pa

    from ledgerloom.functions import vectors

    words = [["a"] * n for n in (150_000, 150_000, 3, 0)] + [None, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words, pa.list_(pa.string()))], names=["k", "w"])
    pieces = list(vectors._pieces(iter([batch])))
    assert [p.num_rows for p in pieces] == [1, 5] and [k for p in pieces for k in p.column(0).to_pylist()] == list(range(6))


def test_tokens_are_counted_before_they_move(spark):
    import importlib

    entry = importlib.import_module("__spark_entry__")
    plan = entry.queries()["tokens_regroup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_count" in plan


def test_what_a_word_is_in_python_and_in_expressions(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import text as tx

    words = ["the", "eur", "abc", "1234", "a1b2", "12ab3", "__ab", "a_b", "été", "dzd", "x" * 48, "x" * 49, "corpus", "ءةغ", "12345678a", "_", "____", "ab12"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.is_informative(F.col("w")), tx.is_topic_candidate(F.col("w"))).collect()
    assert [tuple(r) for r in rows] == [(w, ranking._is_informative(w), ranking._is_candidate(w)) for w in words]


def test_tokens_are_brought_to_lower_case_once(spark):
    from ledgerloom.functions import grammar as gr
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([("I saw it.",)], "text string").select(gr.pos(gr.en_tokens(F.col("text")), "en").alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") <= 3


def test_pairs_of_documents_are_not_moved(spark):
    import importlib

    queries = importlib.import_module("__spark_entry__").queries()
    for name in ("document_links", "rel_document_links", "link_topic_examples", "rel_link_matches", "rel_link_terms", "sentence_matches", "signal_pairs", "link_shared_terms"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\((source|target)#", plan) and "Join [source" not in plan, name


@pytest.fixture(scope="module")
def talks():
    """Ids of signals (doc, term, is_topic) and of terms (doc, chunk, term) of some random documents, one of them large, some without sentences."""
    import random

    draw = random.Random(5)
    words = [f"word{i}" for i in range(30)] + ["été", "x" * 60]
    signals = [(f"d{d}", w, draw.random() < 0.5) for d in range(40) for w in draw.sample(words, 4)] + [("a", None, True), (None, "word1", True), ("lone", "nothing else", True)]
    terms = [(f"d{d}", c, w) for d in range(37) for c in range(60 if d == 3 else 4) for w in draw.sample(words, draw.choice([1, 2, 3, 12, 20]))]
    return signals, terms + [(None, 0, "word1"), ("e", 0, "word2")]


def test_pairs_in_blocks_against_joins(spark, talks):
    from pyspark.sql import functions as F

    from ledgerloom.operators import linking

    signals, terms = spark.createDataFrame(talks[0], "doc_id string, term string, is_topic boolean"), spark.createDataFrame(talks[1], "doc_id string, chunk int, term string")
    same = lambda mine, theirs: sorted(map(str, mine.select(sorted(mine.columns)).collect())) == sorted(map(str, theirs.select(sorted(mine.columns)).collect())) and mine.count() > 0
    side = lambda x: signals.select(F.col("doc_id").alias(x), "term", F.col("is_topic").alias(f"t_{x}"))
    pairs = side("source").join(side("target"), "term").filter("source < target").groupBy("source", "target").agg(F.count_if(F.col("t_source") & F.col("t_target")).alias("n_shared"), F.count("*").alias("n_signals")).cache()
    topics = signals.filter("is_topic")
    shared = topics.select(F.col("doc_id").alias("source"), "term").join(topics.select(F.col("doc_id").alias("target"), "term"), "term").filter("source < target").groupBy("source", "target").agg(F.array_sort(F.collect_set("term")).alias("shared_terms")).cache()
    matches = linking.sentence_matches(pairs, terms, signals).cache()
    links = linking.link_scores(pairs, matches, signals).cache()
    kept = links.select("source", "target")
    assert same(linking.signal_pairs(signals), pairs)
    assert same(linking.pair_candidates(topics), shared.withColumn("n_shared", F.size("shared_terms")))
    assert same(linking.all_matches(signals, terms), matches)
    assert same(linking.all_links(signals, terms), links) and links.count() < pairs.count()
    assert same(linking.all_link_matches(signals, terms), matches.join(kept, ["source", "target"], "left_semi"))
    assert same(linking.all_link_terms(signals, terms), shared.join(kept, ["source", "target"], "left_semi"))
    texts = terms.select("doc_id", "chunk", F.concat(F.lit(" said "), "doc_id", "chunk").alias("text")).distinct()
    assert same(linking.all_topic_examples(signals, texts, terms), linking.topic_examples(links, topics, texts, terms))


def test_blocks_of_pairs_are_cut_without_a_change(monkeypatch, talks):
    import pyarrow as pa

    from ledgerloom.functions import doc_pairs
    from ledgerloom.operators import linking

    assert [g for g in range(15) if doc_pairs._meets_itself(g)] == [0, 2, 5, 9, 14]
    ids = sorted({d for d, t, _ in talks[0] if d and t})
    docs = pa.RecordBatch.from_pylist(
        [{"doc_id": i, "signals": [{"term": t, "is_topic": x} for d, t, x in talks[0] if d == i and t], "terms": [{"chunk": c, "term": t} for d, c, t in talks[1] if d == i] or None} for i in ids],
        pa.schema([("doc_id", pa.string()), ("signals", pa.list_(pa.struct([("term", pa.string()), ("is_topic", pa.bool_())]))), ("terms", pa.list_(pa.struct([("chunk", pa.int32()), ("term", pa.string())])))]),
    )

    def every():
        return [sorted(str(r) for b in doc_pairs._Group(docs, own, what, linking._LEAST).run() for r in b.to_pylist()) for own in (len(ids), 15) for what in ("matches", "links")]

    whole = every()
    monkeypatch.setattr(doc_pairs, "ROWS", 7)
    monkeypatch.setattr(doc_pairs, "CELLS", 9)
    assert every() == whole and all(whole)


def test_cells_of_line_items_are_read_once(spark):
    from ledgerloom.functions import numbers as nb
    from ledgerloom.operators import tables
    from pyspark.sql import functions as F

    texts = ["Reference | Qty | Unit price | Total HT", "P-1 | 2 | 3,50 | 7.00", "P-2 | x | 1 | 1", " | 1 | 2 | 3", "P-3 | 1 234 | 5 | "]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, page_index int, line int, text string")
    items = tables.line_items(lines)
    filters = [x for x in items._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.match(r"\W*Filter ", x)]
    assert filters and not any("decimal(24,6)" in x for x in filters)
    assert [(r["reference"], str(r["quantity"]), str(r["unit_price"]), str(r["total_ht"]), r["row_index"]) for r in items.collect()] == [("P-1", "2.000", "3.50", "7.00", 1)]
    plain = ["12", "0012.5", "12.345", "999999999999999.99", "-3", "1,5", "", None, "P-12", "12 EUR"]
    found = spark.createDataFrame([(t,) for t in plain], "t string").select(nb.amount(F.col("t")).cast("string"), nb.quantity(F.col("t")).cast("string")).collect()
    assert [r[0] for r in found] == ["12.00", "12.50", "12.35", "999999999999999.99", "-3.00", "1.50", None, None, None, "12.00"]
    assert [r[1] for r in found][:4] == ["12.000", "12.500", "12.345", "999999999999999.990"]


def test_ids_of_sentences_are_made_once_a_sentence(spark):
    import importlib

    plan = importlib.import_module("__spark_entry__").queries()["rel_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha1" in plan[plan.index("Generate") :]


def test_audit_of_classes_reads_texts_once(spark):
    import importlib

    plan = importlib.import_module("__spark_entry__").queries()["rel_classification_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    shared = [x for x in plan.optimizedPlan().toString().split("\n") if "RepartitionByExpression [doc_id" in x]
    assert len(shared) == 2
