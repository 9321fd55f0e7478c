"""Operators that the driver's tables don't exercise, on small rows of their own."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grammar as gr, numbers as nb, text as tx, vectors
from ledgerloom.operators import classify, extract, layout, ranking, records, search, tables, totals, visual
from ledgerloom.pipeline import PROFILES, Pipeline
from ledgerloom.sources import files, ocr, sinks
from ledgerloom.streaming import events


def one(spark, value, column):
    """What an expression makes of one string."""
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("1 234,56", 1234.56), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,234", 1234), ("12,5", 12.5), ("٣٤,٥٠", 34.5), ("12/05/2024", None), ("AB123", None), ("TOTAL TTC 10", 10), ("", None), (None, None), ("abc", None), ("-3.10 EUR", -3.1)])
def test_amounts(spark, raw, want):
    got = one(spark, raw, nb.amount)
    assert (float(got) if got is not None else None) == want


def test_money_reads_a_comma_as_the_decimal_mark(spark):
    assert float(one(spark, "1,234", nb.money)) == 1.23 and float(one(spark, "1.005", nb.money)) == 1.01 and one(spark, "", nb.money) is None


@pytest.mark.parametrize(("raw", "want"), [("3", 3), ("2,125", 2.125), ("2.1234", 2.123), ("x", None), (None, None)])
def test_quantities(spark, raw, want):
    got = one(spark, raw, nb.quantity)
    assert (float(got) if got is not None else None) == want


def test_text_functions(spark):
    assert one(spark, "  Facture N° 12 — Été ", tx.classifier_normal) == "FACTURE N 12 ETE"
    assert one(spark, "cat", tx.char_ngrams) == ["<ca", "cat", "at>", "<cat", "cat>", "<cat>"]
    assert one(spark, "A b. C d! e", tx.sentences) == ["A b.", "C d!", "e"] and one(spark, None, tx.sentences) == []
    assert one(spark, "call +33 (0)6 12 34 56 78 now 123", tx.phones) == ["+330612345678"]
    assert one(spark, "le 12/05/2024 ou 2024-01-02", tx.first_date) == "12/05/2024" and one(spark, "99/99/2024", tx.first_date) is None
    assert one(spark, "مرحبا بالعالم", tx.language_of_layout) == "ar" and one(spark, "xyz", tx.language_of_layout) == "fr" and one(spark, "xyz", tx.language_of_grammar) == "en"


def test_classification_truncates_each_keyword(spark):
    rules = [("A", 2, "weak", "paid"), ("B", 1, "weak", "due"), ("B", 1, "negative", "never"), ("C", 3, "strong", "two words")]
    pages = spark.createDataFrame([(1, 1, "paid due due never"), (1, 2, "Paid, paid! two-words"), (2, 1, None)], "doc_id long, page_index int, text string")
    got = {r["doc_type"]: r["score"] for r in classify.scores(pages, rules).collect()}
    assert got == {"A": 1 + 2, "B": 2 - 2, "C": 5}
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    decided = {r["doc_id"]: (r["doc_type"], r["status"]) for r in classify.decisions(docs, classify.scores(pages, rules)).collect()}
    assert decided == {1: ("UNCLASSIFIED", "REVIEW"), 2: ("UNCLASSIFIED", "REVIEW")}
    malus = {r["doc_type"]: r["score"] for r in classify.with_confusion(classify.scores(pages, rules), pages, {"C": ["paid"]}).collect()}
    assert malus["C"] == int(5 - (5 * 1.2 + 5 * 2))


def test_hashed_vectors_and_cosine(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "doc_id long, terms array<string>")
    got = {r[0]: r[1] for r in vectors.hashed_vectors(df, "doc_id", "terms", 64).collect()}
    assert len(got[1]) == 64 and abs(np.linalg.norm(got[1]) - 1) < 1e-5 and not any(got[2]) and not any(got[3])
    pair = spark.createDataFrame([([1.0, 0.0, 9.0], [1.0, 1.0]), ([], [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in pair.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


# files


def office(kind):
    out = io.BytesIO()
    w, s, a = "urn:w", "urn:s", "urn:a"
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            z.writestr("word/document.xml", f'<w:d xmlns:w="{w}"><w:p><w:r><w:t>One</w:t><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:d>')
        elif kind == "xlsx":
            z.writestr("xl/workbook.xml", "<x/>")
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Name</t></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<x xmlns="{s}"><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></x>')
        elif kind == "pptx":
            z.writestr("ppt/presentation.xml", "<x/>")
            for i in (2, 10, 1):
                z.writestr(f"ppt/slides/slide{i}.xml", f'<x xmlns:a="{a}"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></x>')
        elif kind == "odt":
            z.writestr("mimetype", files.MIME["odt"])
            z.writestr("content.xml", '<x xmlns:t="urn:t"><t:p>a<t:s t:c="3"/>b</t:p><t:p>c</t:p></x>')
        elif kind == "epub":
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("a.xhtml", "<p>Chapter</p><b>x</b>")
    return out.getvalue()


def test_file_types_and_texts(spark):
    rows = [(f"/{k}.{k}", office(k)) for k in ("docx", "xlsx", "pptx", "odt", "epub")]
    rows += [("/p.pdf", b"%PDF-1.7 x"), ("/i.png", b"\x89PNG\r\n\x1a\n"), ("/j.jpg", b"\xff\xd8\xff\xe0"), ("/t.tif", b"II*\x00zz"), ("/w.webp", b"RIFF1234WEBP"), ("/o.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("/broken.zip", b"PK\x03\x04zzzz")]
    rows += [("/u.txt", "né\n".encode()), ("/m.txt", b"\xef\xbb\xbfmarked"), ("/l.txt", "né".encode("latin-1")), ("/h.html", b"<p>a</p><br>b<i>c</i>"), ("/e.txt", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    kinds = {r["path"]: r["ext"] for r in files.sniffed(df).collect()}
    assert [kinds[f"/{k}.{k}"] for k in ("docx", "xlsx", "pptx", "odt", "epub")] == ["docx", "xlsx", "pptx", "odt", "epub"]
    assert [kinds[p] for p in ("/p.pdf", "/i.png", "/j.jpg", "/t.tif", "/w.webp", "/o.doc", "/broken.zip", "/u.txt")] == ["pdf", "png", "jpg", "tiff", "webp", "ole", "zip", None]
    texts = {r["path"]: r for r in files.extracted(df, {"pdf": lambda content: ["from a reader"]}).collect()}
    assert texts["/docx.docx"]["pages_text"] == ["One", "Two\tx"] and texts["/xlsx.xlsx"]["pages_text"] == ["Name\t\t5\n\tin"] and texts["/pptx.pptx"]["pages_text"] == ["Slide 1", "Slide 2", "Slide 10"]
    assert texts["/odt.odt"]["pages_text"] == ["a   b\nc"] and texts["/epub.epub"]["pages_text"][0].startswith("Chapter") and texts["/p.pdf"]["pages_text"] == ["from a reader"]
    assert [texts[p]["pages_text"][0] for p in ("/u.txt", "/m.txt", "/l.txt", "/e.txt")] == ["né\n", "marked", "né", ""] and texts["/h.html"]["pages_text"] == ["a\n\nb c"]
    assert texts["/broken.zip"]["extraction"] == "none" and len(texts) == len(rows)
    flags = spark.createDataFrame([("xlsx", False), ("pdf", False), ("pdf", True), (None, False), ("ole", False)], "ext string, t boolean")
    assert [r[0] for r in flags.select(files.content_kind(F.col("ext"), F.col("t"))).collect()] == ["text", "image_only", "text", "unsupported", "unsupported"]


def test_missing_files_and_pointers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("version https://lfs\noid sha256:%s\nsize 3\n" % __import__("hashlib").sha256(b"abc").hexdigest())
    (tmp_path / "b.bin").write_bytes(b"abc")
    found = files.read_files(spark, [str(tmp_path)])
    wanted = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "zzz")], "path string")
    assert [r["path"].rsplit("/", 1)[1] for r in files.missing_paths(wanted, found).collect()] == ["zzz"]
    assert [r["target"].rsplit("/", 1)[1] for r in files.resolved_pointers(files.lfs_pointers(found), found).collect()] == ["b.bin"]


def test_padded_pages(spark):
    df = spark.createDataFrame([(["a"], 3), (["a", "b"], 1), (["a"], None), ([], 2)], "p array<string>, n int")
    assert [r[0] for r in df.select(files.padded_pages(F.col("p"), F.col("n"))).collect()] == [["a", "", ""], ["a"], ["a"], ["", ""]]


def test_ocr_lines(spark):
    words = [(1, "Hello", 0, 10, 50, 10, 90.0), (1, "world", 80, 12, 50, 10, 80.0), (1, "below", 0, 40, 50, 10, 70.0), (1, "noise", 0, 40, 50, 10, -1.0), (1, " ", 0, 90, 5, 5, 50.0)]
    got = ocr.lines_of_words(spark.createDataFrame(words, "page_id int, text string, left int, top int, width int, height int, conf double")).orderBy("line").collect()
    assert [r["text"] for r in got] == ["Hello   world", "below"] and got[0]["confidence"] == 85.0
    tsv = "level\tpage\tb\tp\tl\tw\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t91.5\tHi\n"
    assert one(spark, tsv, ocr.parsed_tsv)[0]["text"] == "Hi"
    histogram = spark.createDataFrame([(1, level, n) for level, n in ((10, 50), (20, 50), (200, 30), (210, 70))], "page_id int, level int, n int")
    assert ocr.otsu_threshold(histogram).first()["threshold"] == 20


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = "id int, v string, first_seen int"
    sinks.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], kinds), path, ["id"])
    sinks.upsert(spark.createDataFrame([(2, "B", 9), (3, "c", 9)], kinds), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 1), (2, "B", 1), (3, "c", 9)]
    sinks.delete(path, spark.createDataFrame([(1,)], "id int"), ["id"])
    assert spark.read.parquet(path).count() == 2
    docs, parts = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, name string"), spark.createDataFrame([(1, 5), (1, 3)], "doc_id int, n int")
    fused = {r[0]: r[1] for r in sinks.fused(docs, "doc_id", rows=parts).collect()}
    assert fused[1] == '{"document":{"doc_id":1,"name":"x"},"rows":[{"n":3},{"n":5}]}' and fused[2] == '{"document":{"doc_id":2,"name":"y"}}'
    assert {tuple(r) for r in sinks.audit_counts(a=docs, b=parts).collect()} == {("a", 2), ("b", 2)}
    assert [r["name"] for r in sinks.bad_values(docs, {"name": ["x"]}).collect()] == ["y"]


# records, layout, tables


def test_records(spark):
    boxes = spark.createDataFrame([(1, "qr", 0.9, 0, 0, 10, 10), (1, "qr", 0.8, 1, 0, 11, 10), (1, "qr", 0.7, 8, 0, 18, 10), (2, "qr", 0.1, 0, 0, 10, 10)], "page_index int, type string, score double, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["score"] for r in visual.suppressed(boxes, ["page_index", "type"]).collect()) == [0.1, 0.7, 0.9]
    old = records.registry(spark.createDataFrame([(1, "c", "k"), (3, "c", "k")], "run_id int, entity_kind string, natural_key string"))
    new = records.merged_registry(old, spark.createDataFrame([(7, "c", "k"), (7, "c", "new")], "run_id int, entity_kind string, natural_key string"))
    assert {(r["natural_key"], r["first_run"], r["last_run"]) for r in new.collect()} == {("k", 1, 7), ("new", 7, 7)}
    nodes = records.json_nodes(spark.createDataFrame([(1, '{"a": [1, {"b c": null}], "t": true, "s": "x"}'), (2, "{bad"), (3, None), (4, str(list(range(70))))], "id int, p string"), "id", "p").collect()
    assert [(r["path"], r["kind"]) for r in nodes if r["id"] == 1] == [("$", "object"), ("$.a", "array"), ("$.a[0]", "number"), ("$.a[1]", "object"), ('$.a[1]["b c"]', "null"), ("$.t", "boolean"), ("$.s", "string")]
    assert [r["kind"] for r in nodes if r["id"] == 2] == ["invalid"] and len([r for r in nodes if r["id"] == 4]) == 1 and not [r for r in nodes if r["id"] == 3]
    tables_ = spark.createDataFrame([(1, 1, ["a", "b"], True), (1, 2, ["a"], False), (1, 3, ["z"], False), (2, 4, ["a"], False)], "doc_id int, table_id int, codes array<string>, rich boolean")
    assert sorted(r["table_id"] for r in records.without_subset_tables(tables_).collect()) == [1, 3, 4]


def test_layout(spark):
    assert one(spark, "1. One\ntext\n2. Two", layout.chunks) == ["1. One\ntext", "2. Two"] and one(spark, "a b\n\nc d", layout.chunks) == ["a b", "c d"] and one(spark, "A. B? c", layout.chunks) == ["A.", "B?", "c"]
    assert [one(spark, t, layout.is_noise) for t in ("Page 3", "3 / 12", "---", "Page three", None)] == [True, True, True, False, True]
    assert [one(spark, t, layout.is_sentence) for t in ("abcdefghijk", "abcdefghijkl")] == [False, True]
    assert [one(spark, t, layout.layout_kind) for t in ("a\tb\tc", "left side        right side", "plain text", "qty and price", "a        1        2")] == ["table", "multicol", "plain", "table", "table"]
    assert one(spark, "Date   12 May", layout.key_value) == "Date: 12 May" and one(spark, "plain text", layout.key_value) == "plain text"
    assert tuple(one(spark, "ab\ncd", lambda c: layout.line_and_column(c, F.lit(4)))) == (2, 2)
    pages = spark.createDataFrame([(1, i, f"ACME 20{i}\nbody {'x' * i}") for i in range(1, 5)], "doc_id int, page_index int, text string")
    assert [(r["key"], r["pages"]) for r in layout.noise_lines(layout.lines(pages)).collect()] == [("acme #", 4)]


def test_tables(spark):
    page = "Invoice\nRéférence\tDesignation\tQté\tPrix unitaire\tTotal HT\nA-1\tBolt\t2\t1,50\t3,00\n\nA-2\tNut\tmany\t1,00\t2,00\nTOTAL HT: 3,00\nA-3\tLate\t1\t1,00\t1,00\nTVA 20%: 0,60\nTotal TTC 3,60 EUR"
    lines = layout.lines(spark.createDataFrame([(1, 1, page)], "doc_id int, page_index int, text string"))
    got = tables.line_items(lines).collect()
    assert [(r["reference"], r["product"], float(r["quantity"]), float(r["unit_price"]), float(r["total_ht"]), r["row_index"]) for r in got] == [("A-1", "Bolt", 2, 1.5, 3, 1)] and got[0]["confidence"] == 1.0
    assert {r["key"]: [float(a) for a in r["amounts"]] for r in tables.totals(lines).collect()} == {"total_ht": [3.0], "tax": [0.6], "total_ttc": [3.6]}
    assert [one(spark, t, tables.split_cells) for t in ("| a | b |", "a\tb", "a  b c   d", "a;b", "a b", None)] == [["a", "b"], ["a", "b"], ["a", "b c", "d"], ["a", "b"], ["a b"], [""]]
    dense = layout.lines(spark.createDataFrame([(1, 1, "Blue bolt 3 1.50 4.50\nno table here")], "doc_id int, page_index int, text string"))
    assert [(r["product"], float(r["quantity"]), float(r["total"])) for r in tables.dense_rows(dense).collect()] == [("Blue bolt", 3.0, 4.5)]
    checked = totals.verify_rows(tables.line_items(lines)).collect()
    assert [r["row_status"] for r in checked] == ["ok"]


def test_extraction(spark):
    pages = spark.createDataFrame([(1, 1, "Mail a@b.com or c@d.org. Alice met Bob."), (1, 2, "Carol"), (2, 1, None), (3, 1, "")], "doc_id int, page_index int, text string")
    found = extract.matches(pages)
    assert [(r["value"], r["start"], r["match_no"]) for r in found.filter("field = 'email'").orderBy("start").collect()] == [("a@b.com", 5, 1), ("c@d.org", 16, 2)]
    assert [(r["page_index"], r["value"]) for r in found.filter("field = 'first_name'").orderBy("page_index").collect()] == [(1, "Mail"), (2, "Carol")]
    fields = extract.fields(pages.select("doc_id").distinct(), found).collect()
    assert len(fields) == 3 * len({r[0] for r in extract.RULES}) and {(r["doc_id"], r["n"], r["first_value"]) for r in fields if r["field"] == "email"} == {(1, 2, "a@b.com"), (2, 0, None), (3, 0, None)}
    lines = spark.createDataFrame([(1, 0, "Contact : me@x.org"), (1, 1, "Montant"), (1, 2, "120,50 EUR"), (1, 3, "nothing")], "doc_id int, line int, text string")
    assert {(r["field"], r["value"]) for r in extract.label_values(lines).collect()} == {("contact", "me@x.org"), ("amount", "120,50")}
    routed = extract.routed(spark.createDataFrame([(1, "invoice"), (2, "UNKNOWN"), (3, None)], "doc_id int, doc_type string"))
    assert {tuple(r) for r in routed.collect()} == {(1, "invoice"), (1, "common"), (2, "common"), (3, "common")}


def test_grammar(spark):
    df = spark.createDataFrame([(1, "I can't see John Smith's dogs in New York City. He paid 30 EUR on 2024-01-02.", "en"), (2, "L'entreprise ne paie plus à Jean Dupont aujourd'hui", "fr"), (3, "وكتابهم في البيت", "ar"), (4, None, "en")], "id int, text string, lang string")
    rows = gr.grammar_tokens(df, F.col("lang")).orderBy("id", "tok_index").collect()
    at = {(r["id"], r["token"]): (r["lemma"], r["pos"], r["ner"]) for r in rows}
    assert at[1, "ca"] == ("can", "VB", "O") and at[1, "n't"] == ("not", "RB", "O") and at[1, "'s"][1] == "POS" and at[1, "dogs"][0] == "dog"
    assert [at[1, w][2] for w in ("John", "Smith", "New", "York", "City", "EUR", "2024-01-02")] == ["B-MISC", "I-MISC", "B-LOC", "I-LOC", "I-LOC", "B-CUR", "B-DATE"]
    assert at[2, "L'"][0] == "le" and at[2, "aujourd'hui"][1] == "NN" and at[3, "وكتابهم"][0] == "كتاب" and not [r for r in rows if r["id"] == 4]
    fixed = spark.createDataFrame([(["O", "I-P", "I-P", "B-L", "I-P", "O", "I-L"],)], "l array<string>").select(gr.bio_repaired(F.col("l"))).first()[0]
    assert fixed == ["O", "B-P", "I-P", "B-L", "B-P", "O", "B-L"]


def test_search(spark):
    pages = spark.createDataFrame([(1, 2, "second page"), (1, 1, "First page. More"), (2, 1, None)], "doc_id int, page_index int, text string")
    docs = {r["doc_id"]: r for r in search.search_documents(pages).collect()}
    assert docs[1]["full_text"] == "First page. More\n\nsecond page" and docs[1]["words"] == ["first", "page", "more", "second"] and docs[2]["words"] == []
    back = search.restored_pages(search.search_documents(pages)).orderBy("page_index").collect()
    assert [r["text"] for r in back] == ["First page. More", "second page"]


def test_ranking(spark):
    chunks = spark.createDataFrame([(1, 0, "red fox"), (1, 1, "red red wine"), (1, 2, "blue sea")], "doc_id int, chunk int, text string")
    queries = spark.createDataFrame([(1, ["red", "wine"])], "doc_id int, terms array<string>")
    assert ranking.bm25_summary(chunks, queries).first()["top_chunks"] == [1, 0]
    boosted = ranking.document_topics(chunks, spark.createDataFrame([(1, "fox", 9.0), (1, "sea", 0.1)], "doc_id int, term string, factor double"), prune=False)
    assert boosted.orderBy("rank").first()["term"] == "fox"


# streams and the pipeline


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.document_stream(spark, str(tmp_path / "in"), rows.schema)
    events.each_batch(stream, lambda b: b.select("user_id", "value"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
    query = events.tumbling(events.document_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, events.tumbling(rows).collect()))
    assert events.sessions(rows).agg(F.sum("n")).first()[0] == 500 and events.sliding(rows).agg(F.sum("n")).first()[0] == 1000


def test_pipeline_profiles(spark):
    docs = spark.createDataFrame([(1, "Alice paid the invoice. Alice met Bob in Paris."), (2, None)], "doc_id long, text string")
    steps = []
    out = Pipeline("50ml").run(docs, upto="chunks", progress=lambda name, i, n: steps.append((name, i, n)))
    assert steps == [("pages", 1, 3), ("classification", 2, 3), ("chunks", 3, 3)] and out["chunks"].count() == 2
    every = Pipeline("50ml").run(docs)
    assert {"links", "search_docs", "vectors", "bm25_docs", "line_items"} <= set(every) and "bm25_docs" not in Pipeline("0ml").run(docs)
    assert every["vectors"].count() == 2 and every["entities"].count() > 0
    with pytest.raises(ValueError):
        Pipeline("9ml")
    with pytest.raises(ValueError):
        Pipeline().run(docs, only=["nothing"])
    assert list(PROFILES) == ["0ml", "50ml", "100ml"]
