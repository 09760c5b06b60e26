"""Queries over the entity graph: parts that share orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import query, table
from .extraction import mentions
from .vectors import vector_of

PAIRS = "i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem), p AS (SELECT a.l_orderkey AS chunk, a.l_partkey AS src, b.l_partkey AS dst FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.k < b.k WHERE b.k <= 20), e AS (SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst)"
BOTH = f"{PAIRS}, s AS (SELECT src, dst, n FROM e UNION ALL SELECT dst, src, n FROM e WHERE src <> dst)"


AT = {"chunk": "chunk", "name": "name", "order": "ord"}


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("ord"))


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name long")


@query(f"WITH {PAIRS} SELECT src, dst, n FROM e")
def cooccurrence_edges(spark, sf):
    return G.cooccurrence_weights(lines(spark, sf), **AT)


@query(f"WITH {BOTH} SELECT src, dst, n FROM s WHERE src IN (1, 7)")
def neighbors_1hop(spark, sf):
    asked = names(spark, 1, 7)
    return G.neighbours(G.edges_near(lines(spark, sf), asked, **AT), asked)


@query(f"WITH {BOTH}, a AS (SELECT DISTINCT dst FROM s WHERE src = 1 AND dst <> 1), b AS (SELECT DISTINCT s.dst FROM s JOIN a ON s.src = a.dst) SELECT CAST(1 AS BIGINT) AS name, 0 AS hop UNION ALL SELECT dst, 1 FROM a UNION ALL SELECT dst, 2 FROM b WHERE dst <> 1 AND dst NOT IN (SELECT dst FROM a)")
def neighbors_2hop(spark, sf):
    return G.reach(lines(spark, sf), names(spark, 1), **AT, hops=2)


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_partkey IN (1, 7)")
def entity_documents(spark, sf):
    return G.documents_of(mentions(spark, sf), names(spark, 1, 7), "name", "doc_id")


@query(f"WITH {BOTH} SELECT name, type, n_docs, n_neighbours, CAST(n_edges AS BIGINT) AS n_edges FROM (SELECT l_partkey AS name, min(p_brand) AS type, count(DISTINCT l_orderkey) AS n_docs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey IN (1, 7, 9) GROUP BY l_partkey) JOIN (SELECT src, count(DISTINCT dst) AS n_neighbours, sum(n) AS n_edges FROM s GROUP BY src) ON name = src")
def entity_card(spark, sf):
    asked = names(spark, 1, 7, 9)
    return G.entity_card(mentions(spark, sf), G.edges_near(lines(spark, sf), asked, **AT), asked, "name", "type", "doc_id")


@query(f"""WITH {BOTH}, r AS (SELECT 1 AS name UNION SELECT 7 UNION SELECT dst FROM s WHERE src IN (1, 7)), docs AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_partkey IN (SELECT name FROM r)),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
x AS (SELECT doc_id, coalesce(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 0) AS score FROM docs LEFT JOIN embeddings ON vec_id = doc_id CROSS JOIN q)
SELECT doc_id, round(score, 6) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 10""")
def enhanced_search(spark, sf):
    """Documents of two entities and their neighbours, ranked by a query vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    reached = G.reach(lines(spark, sf), names(spark, 1, 7), **AT)
    found = G.search(mentions(spark, sf), reached, vectors, vector_of(spark, sf), 10, "name", "doc_id")
    return found.withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT s_name AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT dst AS name FROM e WHERE lower(src) IN ('supplier#000000001', 'nation_3', 'china') UNION SELECT src FROM e WHERE lower(dst) IN ('supplier#000000001', 'nation_3', 'china')) SELECT name FROM r WHERE name NOT IN ('supplier#000000001', 'nation_3', 'china')""")
def related_entities(spark, sf):
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"))
    asked = spark.createDataFrame([("SUPPLIER#000000001",), ("Nation_3",), ("China",)], "name string")
    return G.related(rows, asked)


@query("SELECT l_partkey AS src, l_suppkey AS dst, max(l_discount) AS confidence, count(DISTINCT l_orderkey) AS n_sources, max(length(l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR))) AS n FROM lineitem GROUP BY l_partkey, l_suppkey")
def relation_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("source_id"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("description"))
    merged = G.merge_relations(rows, ["src", "dst"], listed=False)
    return merged.select("src", "dst", "confidence", "n_sources", F.length("description").cast("long").alias("n"))


@query("SELECT user_id, string_agg(event_type, '；' ORDER BY first_id) AS description, CAST(sum(n) AS BIGINT) AS n_sources FROM (SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def entity_merge_sources(spark, sf):
    """Descriptions that no other contains fold to the distinct ones in the order they came in."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("description"), F.col("event_id").alias("source_id"), F.col("event_id").alias("ord"))
    return G.merge_entities(rows, ["user_id"], listed=False).select("user_id", "description", "n_sources")


@query("WITH a AS (SELECT DISTINCT upper(event_type) AS name FROM events WHERE value > 90), b AS (SELECT event_type AS name, min(event_id) AS ord FROM events GROUP BY event_type) SELECT name, 'first' AS round FROM a UNION ALL SELECT name, 'more' FROM b WHERE lower(name) NOT IN (SELECT lower(name) FROM a)")
def gleaning_merge(spark, sf):
    events = table(spark, sf, "events")
    first = events.where("value > 90").select(F.upper("event_type").alias("name"), F.lit("first").alias("round")).distinct()
    more = events.groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("ord")).withColumn("round", F.lit("more"))
    return G.add_missing(first, more, "name", "ord")
