"""What the query modules share: tables, chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and its SQL if there is one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def pages_of(docs: DataFrame) -> DataFrame:
    """Documents as single pages: doc_id, page_index, text."""
    return docs.select("doc_id", F.lit(1).alias("page_index"), "text")


def sentences_of(docs: DataFrame) -> DataFrame:
    """doc_id, chunk (from 0), text."""
    return docs.select("doc_id", F.posexplode_outer(tx.sentences(F.col("text"))).alias("chunk", "text")).filter("chunk IS NOT NULL")


WORD = "([A-Za-z0-9_À-ɏ؀-ۿ]+)"
WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}', 1)"
SENTENCES = r"""sent AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS chunk FROM (SELECT doc_id,
    list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?:;\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"""
PLAIN_WORDS = f"regexp_extract_all(lower(translate(coalesce(text, ''), '{tx._ACCENTED}', '{tx._PLAIN}')), '{WORD}', 1)"
ACCENTS = f"'{tx._ACCENTED}', '{tx._PLAIN}'"
NORMAL = f"upper(trim(regexp_replace(translate(coalesce(text, ''), {ACCENTS}), '[^A-Za-z0-9]+', ' ', 'g')))"


def in_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in sorted(values))


LETTERS = "length(regexp_replace(t, '[^A-Za-zÀ-ɏ؀-ۿ]', '', 'g'))"
INFORMATIVE = f"(t NOT IN ({in_list(tx.STOPWORDS)}) AND {LETTERS} > 0 AND (length(t) >= 4 OR t IN ({in_list(tx.SHORT_TERMS)})))"
CANDIDATE = f"""(length(t) BETWEEN 3 AND 48 AND length(regexp_replace(t, '[0-9_]', '', 'g')) > 0 AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= length(regexp_replace(t, '[0-9_]', '', 'g'))
    AND length(regexp_replace(t, '[^_]', '', 'g')) <= 1 AND t NOT IN ({in_list(tx.TOPIC_STOPWORDS)}))"""
