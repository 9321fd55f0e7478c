"""Golden rows: what each rule makes of a text or row, worked out by hand from the rule, not from the library's constants."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grammar as gr, numbers as nb, text as tx, vectors
from ledgerloom.operators import classify, config, extract, linking, relational, resolve, search, table_blocks, tables, totals

from .test_operators import one


def column(spark, values, expression):
    """What an expression makes of each of several strings."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(1).select("i", expression(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def floats(values):
    return [None if v is None else float(v) for v in values]


def test_amounts_by_the_gates(spark):
    rows = [("1,2345", 12345), ("abc 12", None), ("12 janvier 2024", None), ("12 EUR", 12), ("Total 12", 12), ("12/05/2024", None), ("Total 12/05/2024", 2024), ("REF-123", None), ("1.234.567", 1234567), ("1.234.56", 1234.56), ("1.234", 1.23), ("10-20-30", None), ("12 DA", 12), ("1 500,5 dzd", 1500.5), ("3 / 4", None), ("5 - 7", 7), ("5 -7", -7)]
    assert floats(column(spark, [r for r, _ in rows], nb.amount)) == floats(w for _, w in rows)


def test_quantities_by_the_gates(spark):
    rows = [("1,5", 1.5), ("+3", 3), ("-2", -2), ("2 x", None), ("1/2", None), ("€ 4", 4), ("1.2.3", None)]
    assert floats(column(spark, [r for r, _ in rows], nb.quantity)) == floats(w for _, w in rows)


def test_layout_language(spark):
    rows = [("", "en"), (None, "en"), ("123 456", "en"), ("xyz", "fr"), ("the end of it", "en"), ("le chat et la souris", "fr"), ("café", "fr"), ("the café", "fr"), ("مر abc", "fr"), ("مر", "ar"), ("مرحبا بك", "ar"), ("total amount of the invoice", "en")]
    assert column(spark, [r for r, _ in rows], tx.language_of_layout) == [w for _, w in rows]


def test_grammar_language(spark):
    rows = [("", "en"), ("xyz", "en"), ("the café", "fr"), ("the and the café", "en"), ("abc م", "ar"), ("le chat", "fr")]
    assert column(spark, [r for r, _ in rows], tx.language_of_grammar) == [w for _, w in rows]


def test_currencies(spark):
    rows = [("ten pounds", "GBP"), ("a dollar", "USD"), ("5 €", "EUR"), ("AED 5", "AED"), ("5 SAR", "SAR"), ("data", "DZD"), ("٥ دينار", "DZD"), ("dirham", None), ("nothing", None)]
    assert column(spark, [r for r, _ in rows], tx.currency) == [w for _, w in rows]


def test_first_dates(spark):
    rows = [("le 1/2/2024.", "01/02/2024"), ("2024.3.9", "2024-03-09"), ("40/1/2024 then 2/1/2023", "02/01/2023"), ("lundi 3 mars 2024 x", "lundi 3 mars 2024"), ("on March 3rd, 2024", "March 3rd, 2024"), ("1er février 24", "1er février 24"), ("12/2024", None), ("", None)]
    assert column(spark, [r for r, _ in rows], tx.first_date) == [w for _, w in rows]


def test_terms_codes_and_keywords(spark):
    info = spark.createDataFrame([(t,) for t in ("tva", "ttc", "abc", "the", "subject", "whereas", "bolt", "____", "12345", "loi")], "v string")
    assert [r[0] for r in info.select(tx.is_informative(F.col("v"))).collect()] == [True, True, False, False, False, False, True, False, False, True]
    topic = spark.createDataFrame([(t,) for t in ("article", "http", "bolt", "ab", "a_b_c", "a12", "a123", "x" * 49)], "v string")
    assert [r[0] for r in topic.select(tx.is_topic_candidate(F.col("v"))).collect()] == [False, False, True, False, False, False, False, False]
    assert one(spark, "Ǻngström ﬁn ’s", tx.term_normal) == "angstrom fin 's" and one(spark, "Ŝé́", tx.classifier_normal) == "SE"
    assert column(spark, ["AB-123", "ABC", "123", "A 1", "ABCDEFG-12", "x9"], tx.is_code_like) == [True, False, False, False, False, True]
    assert column(spark, [" ref-12 ", "1234", "12", "hello", "(A77)"], tx.reference_code) == ["REF-12", "1234", None, None, "A77"]
    assert column(spark, ["invoice_no", "Dossier", "total", "doc name", "customer"], tx.is_identifier_field) == [True, True, False, True, False]
    assert tuple(one(spark, "net total(x3,-6,negative)", tx.compact_keyword)) == ("net total", 3, -6.0, "negative") and tuple(one(spark, "plain (x)", tx.compact_keyword)) == ("plain (x)", None, None, None)
    assert column(spark, ["Subtotal 5", "Total TVA 3", "TOTAL TTC", "timbre 1", "Amount due 2", "montant 4", "hello", "Taxes 1"], tables.totals_key) == ["total_ht", "tax", "total_ttc", "stamp", "amount_due", "total", None, "tax"]


def test_classification_decisions(spark):
    rules = [("A", 2, "strong", "alpha"), ("B", 1, "strong", "beta"), ("C", 5, "strong", "gamma")]
    texts = {1: "alpha alpha", 2: "alpha beta", 3: "alpha", 4: "", 5: "alpha alpha beta", 6: "alpha alpha alpha beta beta"}
    docs = spark.createDataFrame([(i,) for i in texts], "doc_id int")
    pages = spark.createDataFrame([(i, 2, t) for i, t in texts.items()], "doc_id int, page_index int, text string")
    got = {r["doc_id"]: (r["doc_type"], r["status"], r["top_score"], r["second_score"], r["margin"]) for r in classify.decisions(docs, classify.scores(pages, rules), types=classify.types_of(rules)).collect()}
    # 10 against 0; a tie; 5 is below the threshold of 6; nothing; 10 against 5; 15 against 10
    assert got == {1: ("A", "OK", 10, 0, 10), 2: ("UNCLASSIFIED", "REVIEW", 5, 5, 0), 3: ("UNCLASSIFIED", "REVIEW", 5, 0, 5), 4: ("UNCLASSIFIED", "REVIEW", 0, 0, 0), 5: ("A", "OK", 10, 5, 5), 6: ("A", "OK", 15, 10, 5)}
    ranks = [(r["doc_type"], r["score"], r["rank"]) for r in classify.ranked(docs, classify.scores(pages, rules), classify.types_of(rules)).filter("doc_id = 3").orderBy("rank").collect()]
    assert ranks == [("A", 5, 1), ("C", 0, 2), ("B", 0, 3)]
    below = spark.createDataFrame([(1, 1, "alpha never"), (1, 2, "never")], "doc_id int, page_index int, text string")
    only = classify.decisions(below.select("doc_id").distinct(), classify.scores(below, [("A", 1, "strong", "alpha"), ("B", 1, "strong_negative", "never")]), types=[("A", 1), ("B", 1), ("Z", 0)]).first()
    # A has 6, B -11 and Z, without a hit, 0: the second score is 0
    assert (only["doc_type"], only["top_score"], only["second_score"]) == ("A", 6, 0)


def test_rows_and_documents_verified(spark):
    kinds = "doc_id int, row_index int, quantity decimal(18,3), unit_price decimal(18,2), total_ht decimal(18,2), total_ttc decimal(18,2), total decimal(18,2)"
    d = lambda *xs: tuple(None if x is None else __import__("decimal").Decimal(str(x)) for x in xs)
    rows = [(1, 1, *d(2, 3, 6, None, None)), (1, 2, *d(1, 4, None, None, 4.02)), (2, 1, *d(2, 3, 9, None, None)), (3, 1, *d(None, 3, 9, None, None)), (3, 2, *d(2, 5, 10, None, None)), (4, 1, *d(2, 3, None, None, None)), (5, 1, *d(2, 3, 7, None, 6))]
    checked = totals.verify_rows(spark.createDataFrame(rows, kinds))
    got = {(r["doc_id"], r["row_index"]): (r["row_status"], r["effective_total"] and float(r["effective_total"]), r["total_source"]) for r in checked.collect()}
    assert got == {
        (1, 1): ("ok", 6.0, "declared+computed"), (1, 2): ("ok", 4.02, "declared+computed"), (2, 1): ("mismatch", 6.0, "computed"), (3, 1): ("ignored_missing_qty_or_unit_price", None, None),
        (3, 2): ("ok", 10.0, "declared+computed"), (4, 1): ("partial", 6.0, "computed"), (5, 1): ("ok", 6.0, "declared+computed"),
    }
    money = ", ".join(f"{c} array<decimal(18,2)>" for c in totals.DECLARED)
    declared = [(1, [*d(10.02)], [], [*d(12.02)], [], [*d(2, 9)]), (2, [*d(6)], [], [], [], []), (3, [*d(19)], [], [*d(21)], [], [*d(2)]), (5, [], [], [*d(6, 7)], [], [])]
    found = {r["doc_id"]: r for r in totals.verify_documents(checked, spark.createDataFrame(declared, f"doc_id int, {money}")).collect()}
    say = lambda i: tuple(found[i][c] for c in ("rows_check", "subtotal_check", "tax_check", "total_check", "verification_status"))
    assert say(1) == ("ok", "ok", "ok", "ok", "ok") and float(found[1]["expected_total"]) == 12.02 and float(found[1]["declared_tax"]) == 2
    assert say(2) == ("mismatch", "ok", "missing", "missing", "mismatch") and found[2]["expected_total"] is None
    # a row was left out, so that the declared subtotal of 19 needn't agree with 10
    assert say(3) == ("ok", "ok", "ok", "ok", "ok") and float(found[3]["declared_total"]) == 21
    assert say(4) == ("ok", "partial", "missing", "missing", "partial_ok")
    # without total_ht the totals stand in for the subtotal, too; 6 is the nearest from 6 upwards
    assert float(found[5]["declared_subtotal"]) == 6 and float(found[5]["declared_total"]) == 6 and say(5) == ("ok", "ok", "missing", "partial", "partial_ok")


def test_hashed_vectors_have_the_sign_of_an_even_byte(spark):
    df = spark.createDataFrame([(1, ["bolt"]), (2, ["ab", "nut"])], "doc_id long, terms array<string>")
    digest = hashlib.blake2b(b"bolt", digest_size=16).digest()
    got = {r[0]: r[1] for r in vectors.hashed_vectors(df, "doc_id", "terms", 64).collect()}
    assert got[1][int.from_bytes(digest[:8], "big") % 64] == (1.0 if digest[8] % 2 == 0 else -1.0)

    def by_hand(word):
        out, marked = np.zeros(64), f"<{word}>"
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = hashlib.blake2b(marked[i : i + n].encode(), digest_size=16).digest()
                out[int.from_bytes(h[:8], "big") % 64] += 1 if h[8] % 2 == 0 else -1
        return out / np.linalg.norm(out)

    got = {r[0]: r[1] for r in vectors.subword_vectors(df, "doc_id", "terms", 64).collect()}
    mean = by_hand("ab") + by_hand("nut")
    assert np.allclose(got[1], by_hand("bolt"), atol=1e-5) and np.allclose(got[2], mean / np.linalg.norm(mean), atol=1e-5)


def test_links_by_topics_signals_and_sentences(spark):
    topics = spark.createDataFrame([(1, "harbor"), (1, "lantern"), (2, "harbor"), (2, "copper"), (3, "velvet")], "doc_id int, term string")
    others = spark.createDataFrame([(1, "facture"), (3, "facture"), (2, "the")], "doc_id int, term string")
    signals = linking.signal_terms(topics, others)
    pairs = {(r["source"], r["target"]): (r["n_shared"], r["n_signals"]) for r in linking.signal_pairs(signals).collect()}
    assert pairs == {(1, 2): (1, 1), (1, 3): (0, 1)}
    chunks = spark.createDataFrame([(1, 0, "The harbor master sold copper"), (1, 1, "a facture"), (2, 0, "Copper from the harbor"), (3, 0, "one facture"), (3, 1, "velvet sleeves")], "doc_id int, chunk int, text string")
    matches = linking.sentence_matches(linking.signal_pairs(signals), linking.sentence_terms(chunks), signals)
    got = {(r["source"], r["target"], r["a"], r["b"]): (r["n_common"], r["n_topics"], r["score"]) for r in matches.collect()}
    w = lambda s, df, topic, signal, word: math.log(1 + (s + 1) / df) + 0.85 * topic + 0.55 * signal + min(0.35, max(0, (len(word) - 4) * 0.03))
    # document 1 has two sentences with terms (harbor master sold copper; facture), document 2 one, document 3 two
    first = (w(3, 2, 1, 1, "harbor") + w(3, 2, 0, 0, "copper")) / (4 + 2 + 1) * 1.17 * 1.12
    second = w(4, 2, 0, 1, "facture") / (1 + 1 + 1) * 1.12
    assert set(got) == {(1, 2, 0, 0), (1, 3, 1, 0)} and got[1, 2, 0, 0] == (2, 1, round(first, 6)) and got[1, 3, 1, 0] == (1, 0, round(second, 6))
    links = {(r["source"], r["target"]): r["score"] for r in linking.link_scores(linking.signal_pairs(signals), matches, signals).collect()}
    assert links == {(1, 2): round(0.45 / 2 + 0.35 * round(first, 6) + 0.2 / 2, 6), (1, 3): round(0.35 * round(second, 6) + 0.2 / 2, 6)}
    examples = linking.topic_examples(linking.link_scores(linking.signal_pairs(signals), matches, signals), topics, chunks, linking.sentence_terms(chunks))
    assert {(r["term"], r["side"], r["chunk"]) for r in examples.collect()} == {("harbor", "source", 0), ("harbor", "target", 0)}


def test_source_chunks_and_best_rows(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "Bolt 2 3,00", "plain"), (1, 1, 1, "Header line", "table"), (1, 2, 2, "Bolt", "plain")], "doc_id int, page_index int, chunk int, text string, layout_kind string")
    rows = spark.createDataFrame([(1, 1, 1, ["bolt 2 3,00", None]), (1, 1, 2, ["bolt"]), (1, 1, 3, ["missing thing"]), (1, 2, 4, ["zzz"])], "doc_id int, page_index int, row_index int, candidates array<string>")
    got = {r["row_index"]: (r["chunk"], r["score"]) for r in resolve.source_chunks(rows, chunks).collect()}
    assert got == {1: (0, 10.11), 2: (0, 7.04), 3: (1, 0.75)}
    starts = spark.createDataFrame([("a  bc d",), ("",), (None,)], "v string").select(resolve.token_starts(F.col("v"))).collect()
    assert [r[0] for r in starts] == [[0, 3, 6], [], []]
    assert resolve.first_with_rows(None, rows.limit(0), chunks) is chunks and resolve.first_with_rows(None) is None


def test_spans_to_labels_against_brute_force(spark):
    rng = random.Random(4)
    tokens, spans, want = [], [], {}
    for s in range(60):
        at, own = 0, []
        for i in range(rng.randrange(1, 12)):
            end = at + rng.randrange(1, 6)
            own.append((s, i, at, end))
            at = end + rng.randrange(0, 2)
        mine = []
        for _ in range(rng.randrange(0, 6)):
            a = rng.randrange(0, at + 2)
            mine.append((s, a, a + rng.randrange(1, 9), rng.choice(["PERS", "DATE"]), rng.choice(["currency", "model", "date"])))
        tokens, spans = tokens + own, spans + mine
        labels = ["O"] * len(own)
        for _, a, b, label, _ in sorted(mine, key=lambda x: (["model", "date", "currency"].index(x[4]), x[1], x[2], x[3])):
            inside = [i for _, i, c, e in own if not (e <= a or c >= b)]
            if inside and all(labels[i] == "O" for i in inside):
                for i in inside:
                    labels[i] = ("B-" if i == inside[0] else "I-") + label
        want |= {(s, i): x for i, x in enumerate(labels)}
    got = gr.labels_of_spans(spark.createDataFrame(tokens, "k int, tok_index int, start int, end int"), spark.createDataFrame(spans, "k int, start int, end int, label string, source string"), ["k"])
    assert {(r["k"], r["tok_index"]): r["ner"] for r in got.collect()} == want
    tags = spark.createDataFrame([(t,) for t in ("NNS", "VBG", "PRP$", "nnp", "xyz", None, ",")], "v string").select(gr.simple_tag(F.col("v"))).collect()
    assert [r[0] for r in tags] == ["NN", "VB", "PRP", "NNP", "NN", "NN", "PUNCT"]


@pytest.mark.parametrize("fan", [16, 1024])
def test_token_budget_by_levels(spark, fan):
    rng = random.Random(fan)
    rows = sorted({rng.randrange(-50, 5000): rng.randrange(0, 9) for _ in range(300)}.items())
    got = {r["id"]: r["within"] for r in search.within_budget(spark.createDataFrame(rows, "id long, n long"), "id", "n", 600, fan).collect()}
    total, want = 0, {}
    for i, n in rows:
        total += n
        want[i] = total <= 600
    assert got == want
    assert search.within_budget(spark.createDataFrame([], "id long, n long"), "id", "n").collect() == []


def test_config_files_and_routed_rules(spark, tmp_path):
    kinds = tmp_path / "types"
    kinds.mkdir()
    files = {"common": {"threshold": 4, "weights": {"strong": 5}}, "invoice": {"doc_type": "invoice", "priority": 3, "keywords": {"strong": ["facture"], "odd": ["tva"]}, "anti_confusion_targets": ["order"]}, "off": {"enabled": False, "keywords": ["x"]}, "list": {"keywords": ["alpha"]}}
    for name, body in files.items():
        (kinds / f"{name}.json").write_text(json.dumps(body))
    (kinds / "bad.json").write_text("{")
    rules, settings, confusions = config.classifiers(str(kinds))
    assert rules == [("INVOICE", 3, "strong", "facture"), ("INVOICE", 3, "weak", "tva"), ("LIST", 0, "weak", "alpha")] and settings["threshold"] == 4 and settings["margin"] == 3 and confusions == {"INVOICE": ["ORDER"]}
    sets = tmp_path / "rules"
    sets.mkdir()
    (sets / "common.json").write_text(json.dumps({"rules": [{"field": "year", "pattern": r"\b20\d\d\b"}]}))
    (sets / "invoice.json").write_text(json.dumps({"rules": [{"field": "number", "id": "n", "pattern": r"no (\d+)", "group": 1, "many": False, "flags": ["IGNORECASE"]}, {"field": "nothing"}]}))
    found = config.rule_sets(str(sets))
    assert found == {"common": [("year", "common-1", r"\b20\d\d\b", 0, True, "")], "invoice": [("number", "n", r"no (\d+)", 1, False, "i")]}
    (tmp_path / "routes.json").write_text(json.dumps({"routes": {"invoice": ["invoice"]}, "include_common": True}))
    routes, with_common = config.routes(str(tmp_path / "routes.json"))
    assert routes == {"INVOICE": ["invoice"]} and with_common and config.routes(str(tmp_path / "none.json")) == ({}, True)
    pages = spark.createDataFrame([(i, 1, "No 17 of 2024, no 18") for i in (1, 2, 3)], "doc_id long, page_index int, text string")
    decided = spark.createDataFrame([(1, "INVOICE"), (2, "UNCLASSIFIED")], "doc_id long, doc_type string")
    got = sorted((r["doc_id"], r["ruleset"], r["value"]) for r in extract.routed_matches(pages, decided, found, routes).collect())
    assert got == [(1, "common", "2024"), (1, "invoice", "17"), (2, "common", "2024"), (3, "common", "2024")]


def test_tables_are_made_once_and_shredded(spark, tmp_path):
    schemas = {"runs_t": "run_id string, n int", "docs_t": "doc_id long"}
    try:
        assert resolve.bootstrap(spark, schemas, "loom_test", str(tmp_path)) == ["runs_t", "docs_t"] and resolve.bootstrap(spark, schemas, "loom_test", str(tmp_path)) == []
    finally:
        spark.sql("DROP DATABASE IF EXISTS loom_test CASCADE")
    docs = spark.createDataFrame([(1, "a.txt", "x\ny"), (2, None, None)], "doc_id long, filename string, text string")
    made, again = relational.ingest_tables(docs, "r"), relational.ingest_tables(docs, "r")
    assert made["documents"].collect() == again["documents"].collect() and made["document_texts"].count() == 1 and tuple(made["runs"].first()) == ("r", 2, 1)
    parts = relational.processing_tables(spark.createDataFrame([(1, '{"warnings": ["w", ""], "steps": [{"name": "a", "status": "ok", "seconds": 1.5}]}'), (2, "{bad"), (3, None)], "id int, p string"), "id", "p")
    assert [r["text"] for r in parts["warnings"].collect()] == ["w"] and [(r["id"], r["steps"], r["seconds"]) for r in parts["durations"].collect()] == [(1, 1, 1.5)] and parts["business_fields"].count() == 0


INVOICE = """ACME Corp
Tel: 0123

Reference    Designation       Qty    Price    Total
A-1          Blue bolt         2      1.50     3.00
A-2          Red nut           4      2.00     8.00
             long variety
A-3          Washer            1      0.10     0.10
Total HT 11.10
Thank you for the business we have done together in this year"""


def test_table_blocks(spark):
    got = table_blocks.blocks_of(INVOICE)
    assert [[i for i, _ in block] for block in got] == [[3, 4, 5, 6, 7], [3, 4, 5, 7]]
    assert got[0][0][1] == ["Reference", "Designation", "Qty", "Price", "Total"] and got[0][1][1] == ["A-1", "Blue bolt", "2", "1.50", "3.00"]
    dense = table_blocks.blocks_of("Item list\nBlue bolt 3 1.50 4.50\nRed nut 2 1 500,00 3 000,00\nTVA 3.00")
    assert dense[0] == [(0, ["Item list"]), (1, ["Blue bolt", "3 1.50", "4.50"]), (2, ["Red nut", "2 1", "500,00", "3 000,00"])]
    assert table_blocks.blocks_of("") == [] and table_blocks.blocks_of("Just one line of prose.\nAnd another one of it.") == []
    pages = spark.createDataFrame([(1, 1, INVOICE), (2, 1, None), (3, 1, "")], "doc_id long, page_index int, text string")
    rows = table_blocks.table_rows(pages).collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["row"] for r in rows if r["block"] == 1][:3] == [1, 2, 3]
    scores = {r["line"]: r for r in table_blocks.line_scores(pages.filter("doc_id = 1")).collect()}
    # four gaps, five tokens, all under the next line's, a header: 3.2 + 1 + 1.4 + 1.9
    assert scores[3]["is_header"] and scores[8]["is_footer"] and scores[3]["score"] == 7.5 and scores[2]["score"] == -1.0 and scores[9]["score"] < 1


def test_both_amount_readers_agree(spark):
    raws = ["1 234,56", "1.234,56", "1,2345", "abc 12", "12 EUR", "Total 12/05/2024", "REF-123", "1.234.56", "٣٤,٥٠", "-3.10", "3 / 4", "", "TVA 20%: 0,60", "x9", "12 janvier"]
    mine = [table_blocks.amount(r) for r in raws]
    assert floats(column(spark, raws, nb.amount)) == [None if m is None else round(m + 1e-9, 2) for m in mine]
