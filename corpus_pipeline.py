"""A corpus through five stages: toxic documents go, one of each group of near duplicates stays,
documents with benchmark passages go, sources and languages are mixed to their weights, and
what is left becomes packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, neardup, tokenbin, toxicity
from ledgerloom.llm.workspace import mark, release, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.remove_toxic(docs, _table(spark, sf_dir, "labels"))),
    ("near_dedup", lambda spark, docs, sf_dir: neardup.remove_near_duplicates(docs)),
    ("decontamination", lambda spark, docs, sf_dir: decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("token_binary", lambda spark, docs, sf_dir: tokenbin.token_binary(docs)),
]

#: SQL can express none of these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed ids of the documents that are left, a row for each copy that the mixture wants.

    Null, empty and wordless texts are one group of copies, so the one of least doc_id stays, and repeated rows are copies too. Rows without doc_id stay
    like any other and are the last to be kept of their group. Ties are broken by doc_id, then by text. Empty tables give no rows; without labels of both
    kinds nothing is toxic, and without test items nothing is contaminated. Extra columns of documents are carried up to the last stage, whatever their names.
    Once a stage is written the tables before it are deleted; the last stage's input stays, because the result reads it.
    """
    docs, begun = _table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, begun, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
