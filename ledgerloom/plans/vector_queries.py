"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, vectors
from ..operators import linking
from .common import query, table

_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_UNIT = f"list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_NORM.format('embedding')})"
_COSINE = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (" + _NORM.format("{0}") + " * " + _NORM.format("{1}") + ")"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("unit_vectors", f"SELECT vec_id, list_transform(CASE WHEN {_NORM.format('embedding')} > 0 THEN {_UNIT} ELSE embedding END, lambda x: round(x, 5)) AS v, round({_NORM.format('embedding')}, 5) AS length FROM embeddings")
def unit_vectors(spark, d):
    v = F.col("embedding")
    # a sum over no element is null
    length = F.when(F.exists(v, lambda x: x.isNotNull()), F.round(vectors.norm(v), 5))
    return table(spark, d, "embeddings").select("vec_id", F.transform(vectors.unit(v), lambda x: vectors.rounded(x, 5)).alias("v"), length.alias("length"))


@query("mean_vectors", f"""WITH u AS (SELECT label, unnest({_UNIT}) AS x, unnest(range(len(embedding))) AS place FROM embeddings), m AS (SELECT label, place, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS len FROM m)
    SELECT label, place, round(x / len, 5) AS x FROM n""")
def mean_vectors(spark, d):
    return vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("place", "x")).withColumn("x", vectors.rounded(F.col("x"), 5))


@query("cosine_pairs", f"""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s WHERE cosine >= 0.25) SELECT * FROM r WHERE rank <= 14""")
def cosine_pairs(spark, d):
    both = _vectors(spark, d)
    return linking.similar_vectors(both, both, ["label"], 0.25)


@query("chunk_matches", f"""WITH c AS (SELECT vec_id AS id, embedding AS v, label, vec_id % 7 AS topic, vec_id % 3 AS n FROM embeddings),
    s AS (SELECT a.id AS a, b.id AS b, {_COSINE.format('a.v', 'b.v')} AS cosine, CASE WHEN a.topic = b.topic THEN 1 ELSE 0 END AS topics, least(a.n, b.n) AS terms FROM c a JOIN c b ON a.label = b.label AND a.id < b.id),
    h AS (SELECT a, b, round(cosine, 6) AS cosine, round(0.78 * cosine + 0.12 * topics + 0.10 * least(terms / 2, 1) + CASE WHEN topics = 1 THEN 0.10 ELSE 0.0 END + CASE WHEN cosine >= 0.3 THEN 0.06 ELSE 0.0 END, 5) AS hybrid FROM s)
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY hybrid DESC, b) AS rank FROM h WHERE cosine >= 0.3 OR hybrid >= 0.3 QUALIFY rank <= 14""")
def chunk_matches(spark, d):
    chunks = _vectors(spark, d).withColumns({"topic": F.col("id") % 7, "n": F.col("id") % 3})
    return linking.chunk_matches(chunks, chunks, ["label"], 0.3, 0.3)


@query("hash_vectors")
def hash_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("terms"))
    return vectors.hashed_vectors(docs, "doc_id", "terms")


@query("subword_vectors")
def subword_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("terms"))
    return vectors.subword_vectors(docs, "doc_id", "terms")
