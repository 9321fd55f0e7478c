"""The registered queries of this subpackage, and the pipeline, on the smallest tables."""

import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import neardup, textarrays as ta, tokenbin, tokencount, workspace

from .. import compare
from ..conftest import DATA
from . import fixtures as fx
from .test_methods import near_groups, shingle_set

entry = importlib.import_module("__spark_entry__")
SF = f"{DATA}/sf0.001"
OWN = [n for n in entry.queries() if n.startswith("op")]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in OWN) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_against_sql(spark, name):
    assert compare.difference(entry.queries()[name](spark, SF), compare.connection(SF), entry.oracle_sql()[name]) is None


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    pairs, root = near_groups(rows, neardup.THRESHOLD)
    got = {r["doc_id"]: r["group_id"] for r in entry.queries()["op6_near_dedup"](spark, SF).collect()}
    assert sum(got[rows[a][0]] == got[rows[b][0]] for a, b in pairs) >= 0.97 * len(pairs)
    assert len({(got[r[0]], root[i]) for i, r in enumerate(rows)}) == len({got[r[0]] for r in rows})


def test_contaminated_documents(spark):
    docs = [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    sets = {i: shingle_set(t, 5) for i, t in items}
    truth = {(d, i) for d, t in docs for mine in [shingle_set(t, 5)] for i, s in sets.items() if len(s & mine) >= 0.5 * len(s)}
    found = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op2_decontamination"](spark, SF).collect()}
    assert truth and found <= truth and len(found) >= 0.9 * len(truth)


def test_pipeline_by_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, first = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.count()
    assert rows["near_dedup"] < rows["toxicity"] and rows["decontamination"] <= rows["near_dedup"] and rows["mixing"] == rows["token_binary"]
    mixed = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/mixing").collect()}
    counter = tokencount.Counter(tokencount.read_ranks(tokencount.RANKS_PATH))
    for r in docs.collect():
        ids = tokenbin.decode(r["n_tokens"], r["words"], r["block_words"], r["escapes"])
        assert len(ids) == r["n_tokens"] == counter.count([mixed[r["doc_id"]]])[0]
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] == docs.agg(F.sum("n_tokens")).first()[0]


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, kind):
    rows = fx.odd_rows() if kind == "odd" else []
    before = len(workspace._live)
    fx.frame(spark, rows, clashes=True).write.parquet(f"{tmp_path}/documents.parquet")
    fx.items(spark, [(1, "none of these words is in the texts at all"), (None, None)][: len(rows)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    fx.labels(spark, [(1, 1, 0), (None, None, 1)][: len(rows)]).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(workspace._live) - before <= 1  # the table that the result reads
    kept = {r["doc_id"] for r in out}
    if kind == "empty":
        assert out == []
    else:
        # of the wordless rows 2, 3, 4, 9 and a null one only the least stays, of rows 1 and 10 the least; copies come from the mixture
        assert kept <= {1, 2, 5, 6, 7, 8, 11, 2**62, None} and kept


def test_long_texts_are_groups_of_their_own():
    import pyarrow as pa

    assert list(ta.groups(pa.array(["a" * 10, None, "b" * 30, "c"]), 20)) == [(0, 2), (2, 3), (3, 4)]
    assert fx.odd_rows()
