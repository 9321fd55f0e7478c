"""Queries of the row-keeping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from .common import query, table


@query("best_rows", """SELECT source, lang, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(coalesce(text, '')) DESC, doc_id) = 1""")
def best_rows(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "text")
    return records.best_rows(docs, ["source", "lang"], "text", "doc_id").select("source", "lang", "doc_id", F.length("text").alias("n"))


@query("drop_empty_duplicates", """WITH x AS (SELECT doc_id, 'file-' || (doc_id % 97) AS name, CASE WHEN doc_id % 3 = 0 OR doc_id % 97 < 5 THEN '' ELSE text END AS text FROM documents), y AS (SELECT *, max(length(trim(text))) OVER (PARTITION BY name) AS m FROM x)
    SELECT doc_id, name, length(text) AS n FROM y WHERE length(trim(text)) > 0 OR m = 0""")
def drop_empty_duplicates(spark, d):
    key = F.col("doc_id")
    named = table(spark, d, "documents").select("doc_id", F.concat(F.lit("file-"), (key % 97).cast("string")).alias("name"), F.when((key % 3 == 0) | (key % 97 < 5), "").otherwise(F.col("text")).alias("text"))
    return records.without_empty_duplicates(named, "name", "text").select("doc_id", "name", F.length("text").alias("n"))


@query("union_sources", """SELECT 'document' AS kind, doc_id AS id, lang, length(text) AS n FROM documents UNION ALL SELECT 'item', item_id, NULL, length(text) FROM benchmark UNION ALL SELECT 'page', page_id, NULL, length(html) FROM pages""")
def union_sources(spark, d):
    one = lambda kind, key, text, *more: table(spark, d, {"document": "documents", "item": "benchmark", "page": "pages"}[kind]).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length(text).alias("n"), *more)
    return records.merged_sources(one("document", "doc_id", "text", "lang"), one("item", "item_id", "text"), one("page", "page_id", "html"))


@query("distinct_rows", """SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity, l_discount ORDER BY l_orderkey, l_linenumber) = 1""")
def distinct_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_orderkey", "l_linenumber")
    return records.distinct_first(rows, rows.columns[:4], ["l_orderkey", "l_linenumber"])


@query("ruleset_merge", """SELECT key, coalesce(b.value, a.value) AS value FROM (SELECT c_custkey AS key, c_name AS value FROM customer) a FULL JOIN (SELECT s_suppkey * 2 AS key, s_name AS value FROM supplier) b USING (key)""")
def ruleset_merge(spark, d):
    common = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    typed = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("key"), F.col("s_name").alias("value"))
    return records.later_wins(common, typed, key="key")


_TABLES = "t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, list_sort(list(DISTINCT l_suppkey % 25)) AS codes, count(*) >= 5 AS rich FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query("subset_prune", f"WITH {_TABLES} SELECT doc_id, table_id, len(codes) AS n, rich FROM t WHERE rich OR NOT EXISTS (SELECT 1 FROM t r WHERE r.rich AND r.doc_id = t.doc_id AND list_has_all(r.codes, t.codes))")
def subset_prune(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 25).alias("codes"), (F.count("*") >= 5).alias("rich"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"))
    tables = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("doc_id", F.col("o_orderkey").alias("table_id"), "codes", "rich")
    return records.without_subset_tables(tables).select("doc_id", "table_id", F.size("codes").alias("n"), "rich")


@query("gap_clusters", """WITH l AS (SELECT p_brand, p_retailprice AS x, coalesce(p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) > 3.0, true) AS fresh FROM part),
    c AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY x) AS BIGINT) AS cluster FROM l)
    SELECT p_brand, cluster, count(*) AS n, min(x) AS low, max(x) AS high, list_sort(list(x))[count(*) // 2 + 1] AS middle FROM c GROUP BY ALL""")
def gap_clusters(spark, d):
    return records.position_clusters(table(spark, d, "part"), ["p_brand"], "p_retailprice", 3.0)


@query("stable_registry", """SELECT 'customer' AS entity_kind, CAST(o_custkey AS VARCHAR) AS natural_key, min(o_orderkey) AS first_run, max(o_orderkey) AS last_run, count(DISTINCT o_orderkey) AS runs, 'customer-' || substr(sha1('customer|' || o_custkey), 1, 24) AS stable_id FROM orders GROUP BY o_custkey""")
def stable_registry(spark, d):
    return records.registry(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("customer").alias("entity_kind"), F.col("o_custkey").cast("string").alias("natural_key")))


@query("upsert_merge", """WITH n AS (SELECT c_custkey AS k, 'moved-' || c_name AS name, c_acctbal + 1 AS balance, 2 AS first_seen FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal, 2 FROM supplier)
    SELECT coalesce(c_custkey, k) AS key, coalesce(name, c_name) AS name, CASE WHEN k IS NULL THEN c_acctbal ELSE balance END AS balance, CASE WHEN c_custkey IS NULL THEN first_seen ELSE 1 END AS first_seen FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_merge(spark, d):
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    old = customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("first_seen"))
    new = old.filter("key % 3 = 0").select("key", F.concat(F.lit("moved-"), "name").alias("name"), (F.col("balance") + 1).alias("balance"), F.lit(2).alias("first_seen"))
    added = supplier.select((F.col("s_suppkey") + 10000000).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(2).alias("first_seen"))
    return records.upserted(old, new.unionByName(added), ["key"], keep=["first_seen"])


@query("page_sampling", """WITH n AS (SELECT doc_id, CAST(doc_id % 61 AS INTEGER) AS n FROM documents), p AS (SELECT doc_id, CASE WHEN n < 1 THEN [] WHEN n <= 20 THEN range(1, n + 1) ELSE list_sort(list_distinct(list_concat(range(1, 5), list_transform(range(1, 13), lambda i: CAST(4 + round_even(CAST(i * (n - 8) AS DOUBLE) / 13, 0) AS BIGINT)), range(n - 3, n + 1)))) END AS l FROM n)
    SELECT doc_id, unnest(l) AS page FROM p""")
def page_sampling(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(records.page_sample((F.col("doc_id") % 61).cast("int"))).alias("page"))


@query("json_nodes", """SELECT event_id, 0 AS nth, '$' AS path, CAST(NULL AS VARCHAR) AS parent, '' AS name, 'object' AS kind, CAST(NULL AS DOUBLE) AS number FROM events WHERE props IS NOT NULL
    UNION ALL SELECT event_id, 1, '$.k', '$', 'k', 'number', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_nodes(spark, d):
    return records.json_nodes(table(spark, d, "events"), "event_id", "props").drop("text", "truth")


@query("json_leaves", "SELECT event_id, '$.k' AS path, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaves(spark, d):
    nodes = records.json_nodes(table(spark, d, "events"), "event_id", "props")
    return nodes.filter(~F.col("kind").isin("object", "array")).select("event_id", "path", "number")


@query("cells_shred", """WITH c AS (SELECT l_orderkey, l_linenumber, [CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag, CAST(l_suppkey AS VARCHAR)] AS raw FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, raw, unnest(range(4)) AS cell, unnest(raw) AS value FROM c)
    SELECT l_orderkey, l_linenumber, cell, value, CASE WHEN value = raw[1] THEN 'quantity' WHEN value = raw[2] THEN 'reference' ELSE 'other' END AS role FROM x""")
def cells_shred(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").cast("string").alias("q"), F.col("l_partkey").cast("string").alias("p"), "l_returnflag", F.col("l_suppkey").cast("string").alias("s"))
    return records.cells(rows.withColumn("raw", F.array("q", "p", "l_returnflag", "s")), ["l_orderkey", "l_linenumber"], "raw", {"quantity": "q", "reference": "p"})


@query("unpivot_features", """SELECT p_partkey AS id, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part UNION ALL SELECT p_partkey, 'name_length', CAST(length(p_name) AS DOUBLE) FROM part""")
def unpivot_features(spark, d):
    wide = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.length("p_name").cast("double").alias("name_length"))
    return wide.unpivot(["id"], ["size", "price", "name_length"], "feature", "value")


@query("link_views_union", """SELECT 'customer-' || o_custkey AS a, 'order-' || o_orderkey AS b, 'document_document' AS kind FROM orders UNION ALL SELECT 'order-' || l_orderkey, 'part-' || l_partkey, 'document_entity' FROM lineitem
    UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || n_name, 'document_identifier' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'nation-' || n_name, 'region-' || r_name, 'document_topic' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def link_views_union(spark, d):
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a + "-"), F.col(x).cast("string")).alias("a"), F.concat(F.lit(b + "-"), F.col(y).cast("string")).alias("b"), F.lit(kind).alias("kind"))
    nation, region, customer = (table(spark, d, n) for n in ("nation", "region", "customer"))
    return records.merged_sources(
        edge(table(spark, d, "orders"), "customer", "o_custkey", "order", "o_orderkey", "document_document"),
        edge(table(spark, d, "lineitem"), "order", "l_orderkey", "part", "l_partkey", "document_entity"),
        edge(customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]), "customer", "c_custkey", "nation", "n_name", "document_identifier"),
        edge(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]), "nation", "n_name", "region", "r_name", "document_topic"),
    )
