"""Odd rows, empty tables and clashing columns, for every operator."""

import pytest

from ledgerloom.llm import decontaminate, fingerprints, linededup, mixing, neardup, sharding, tokenbin, tokencount, toxicity, webtext

from . import fixtures as fx

OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "mixing_rates": lambda s, d: mixing.mixing_rates(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, fx.labels(s, [(1, 1, 0), (6, 1, 1), (None, 0, 1), (5, None, None), (5, 1, 7)])),
    "token_counts": lambda s, d: tokencount.token_counts(d),
    "near_duplicates": lambda s, d: neardup.near_duplicates(d),
    "token_binary": lambda s, d: tokenbin.token_binary(d),
    "shard": lambda s, d: sharding.shard(d),
    "deduped_lines": lambda s, d: linededup.deduped_lines(d),
}
FILTERS = {
    "remove_toxic": lambda s, d: toxicity.remove_toxic(d, fx.labels(s, [(1, 1, 0), (5, 1, 0)])),
    "remove_near_duplicates": lambda s, d: neardup.remove_near_duplicates(d),
    "remove_contaminated": lambda s, d: decontaminate.remove_contaminated(d, fx.items(s, [(1, "none of these words is in the texts at all"), (2, None), (None, "")])),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("clashes", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name, clashes):
    rows = fx.odd_rows()
    out = OPERATORS[name](spark, fx.frame(spark, rows, clashes)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", [*OPERATORS, *FILTERS])
def test_empty_tables(spark, name):
    assert (OPERATORS | FILTERS)[name](spark, fx.frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    docs = fx.frame(spark, fx.odd_rows(), clashes=True)
    out = FILTERS[name](spark, docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    out.collect()


def test_clean_filters_keep_odd_rows(spark):
    rows = fx.odd_rows()
    for name in ("remove_toxic", "remove_contaminated"):
        assert FILTERS[name](spark, fx.frame(spark, rows)).count() == len(rows), name


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, 0])
def test_decontamination_of_odd_rows(spark, index_bytes):
    docs = fx.frame(spark, fx.odd_rows(), clashes=True)
    found = decontaminate.contaminated(docs, fx.items(spark, [(1, fx.prose(4, 60)), (None, fx.prose(2, 60)), (3, "too short"), (4, None), (5, "")]), index_bytes=index_bytes)
    assert sorted(((r[0] or 0), (r[1] or 0)) for r in found.collect()) == [(0, 1), (1, 0), (1, 0), (10, 0)]
    assert decontaminate.contaminated(fx.frame(spark, []), fx.items(spark, []), index_bytes=index_bytes).collect() == []
    assert decontaminate.contaminated(docs, fx.items(spark, []), index_bytes=index_bytes).collect() == []


def test_pages(spark):
    rows = [(1, "http://a.b/c", "<p>One, two, three words and more of them here.</p>"), (1, "http://a.b/c", "<p>One, two, three words and more of them here.</p>"), (2, None, "<div>text without a host, but long enough to count</div>"), (3, "http://a.b/d", None), (None, "", ""), (4, "//[", "<div <p class='x"), (5, "http://a.b/e", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    out = webtext.extract(pages).collect()
    assert len(out) == len(rows) and webtext.extract(pages.limit(0)).collect() == []
    assert {r["text"] for r in out if r["page_id"] in (3, None)} == {""}
    assert next(r["text"] for r in out if r["page_id"] == 5) == "deep"
