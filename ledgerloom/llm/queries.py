"""The queries of this subpackage and, where SQL can tell them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import decontaminate, fingerprints, linededup, mixing, neardup, sharding, tokenbin, tokencount, toxicity, webtext


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_fingerprints": lambda spark, d: fingerprints.fingerprints(_table(spark, d, "documents")),
    "op2_decontamination": lambda spark, d: decontaminate.contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op3_mixing": lambda spark, d: mixing.mixing_rates(_table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op5_token_counts": lambda spark, d: tokencount.token_counts(_table(spark, d, "documents")),
    "op6_near_dedup": lambda spark, d: neardup.near_duplicates(_table(spark, d, "documents")),
    "op7_html_extraction": lambda spark, d: webtext.extract(_table(spark, d, "pages")),
    "op8_token_binary": lambda spark, d: tokenbin.token_binary(_table(spark, d, "documents")),
    "op9_sharding": lambda spark, d: sharding.shard(_table(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: linededup.deduped_lines(_table(spark, d, "documents")),
}

_WHITE = " || ".join(f"chr({ord(c)})" for c in linededup.WHITE)
_SHARD_ROWS = ", ".join(f"('{name}', {weight})" for name, weight in sorted(sharding.SHARDS.items()))

ORACLE_SQL = {
    "op9_sharding": f"""
        WITH shards(name, weight) AS (VALUES {_SHARD_ROWS}),
        keyed AS (SELECT *, row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS k FROM documents),
        drawn AS (SELECT r, arg_min(name, -ln((CAST('0x' || substr(md5(k || '|' || name), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight) AS shard FROM keyed, shards GROUP BY r)
        SELECT doc_id, text, lang, source, n_chars, shard FROM keyed JOIN drawn USING (r)""",
    "op10_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, pos, trim(line, {_WHITE}) AS line, raw FROM (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM lines)
        SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE nth = 1 OR line = ''), '') AS text,
            count(*) AS n_lines, count(*) FILTER (WHERE nth > 1 AND line <> '') AS n_removed
        FROM ranked GROUP BY doc_id""",
}
