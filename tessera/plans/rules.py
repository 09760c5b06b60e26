"""Queries over predicates, lookups and assembled contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from .base import query, table


@query("SELECT conv_id, turn, contains(lower(text), 'the') OR contains(lower(text), 'idiot') AS gate, CASE WHEN turn % 5 = 4 THEN 'attachment' WHEN starts_with(text, '/') THEN 'command' ELSE 'chat' END AS route, role IN ('user', 'system') AS permitted FROM conversations")
def message_gates(spark, sf):
    from ..functions.text import any_of

    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", any_of(t, ("the", "idiot")).alias("gate"), R.route(t, F.when(F.col("turn") % 5 == 4, 1).otherwise(0)).alias("route"), R.permitted(F.col("role"), ["user", "system"]).alias("permitted"))


NAMES = "CASE doc_id % 5 WHEN 0 THEN 'qwen:4b' WHEN 1 THEN 'llama3:8b' WHEN 2 THEN 'big-13b' WHEN 3 THEN 'bge-m3' ELSE 'x:72b' END"


@query(f"SELECT doc_id, contains(n, 'bge') AS embedding, CASE doc_id % 5 WHEN 0 THEN '4B' WHEN 1 THEN '8B' WHEN 2 THEN '4B' WHEN 3 THEN '7B' ELSE '70B' END AS size FROM (SELECT doc_id, {NAMES} AS n FROM documents)")
def model_sizes(spark, sf):
    """A name with 13b contains 3b, and that rule comes first."""
    k = F.col("doc_id") % 5
    n = F.when(k == 0, "qwen:4b").when(k == 1, "llama3:8b").when(k == 2, "big-13b").when(k == 3, "bge-m3").otherwise("x:72b")
    return table(spark, sf, "documents").select("doc_id", R.is_embedding_model(n).alias("embedding"), R.model_size(n).alias("size"))


@query("SELECT doc_id, CAST(line AS INT) AS line, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE contains(lower(text), 'the') OR contains(lower(text), 'eine')) WHERE rn <= 10")
def matching_lines(spark, sf):
    rows = R.matching_lines(table(spark, sf, "documents"), "doc_id", "text", ["the", "eine"])
    return rows.select("doc_id", "line", F.md5("text").alias("digest"))


@query("WITH q AS (SELECT DISTINCT left(c_name, 11) AS prefix FROM customer) SELECT prefix, CASE WHEN count(DISTINCT c_name) = 1 THEN min(c_name) END AS c_name, count(DISTINCT c_name) AS n FROM q JOIN customer ON starts_with(c_name, prefix) GROUP BY prefix")
def prefix_lookup(spark, sf):
    names = table(spark, sf, "customer").select("c_name")
    return R.prefix_lookup(names, names.select(F.left("c_name", F.lit(11)).alias("prefix")).distinct(), "c_name", "prefix")


@query("SELECT item_id, CASE WHEN contains(lower(text), 'the ') THEN 'a' WHEN contains(lower(text), 'er') THEN 'b' END AS skill FROM benchmark WHERE contains(lower(text), 'the ') OR contains(lower(text), 'er')")
def skill_triggers(spark, sf):
    triggers = spark.createDataFrame([("b", 2, "ER"), ("a", 1, "The ")], "skill string, ord int, trigger string")
    return R.first_trigger(F.col("text"), triggers, table(spark, sf, "benchmark"), "item_id")


@query("""WITH l AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, '- ' || l_partkey || ' (' || l_returnflag || '): ' || l_shipdate::DATE AS line FROM lineitem),
f AS (SELECT * FROM (SELECT *, sum(length(line) // 2) OVER (PARTITION BY q ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM l) WHERE used <= 40)
SELECT q, '## 实体信息' || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS context FROM f GROUP BY q""")
def context_fusion(spark, sf):
    from pyspark.sql import Window as W

    lines = table(spark, sf, "lineitem")
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    entities = lines.select(F.col("l_orderkey").alias("q"), order.alias("ord"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").cast("date").cast("string").alias("description"))
    none = spark.createDataFrame([], "q long, ord int, src string, relation string, dst string, description string")
    return R.fused_context(entities, none, "q", 40)


@query("SELECT doc_id, '[a]' || chr(10) || lang || CASE WHEN doc_id % 3 > 0 THEN chr(10) || chr(10) || '[c]' || chr(10) || source ELSE '' END AS prompt FROM documents")
def layer_assembly(spark, sf):
    third = F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", R.assemble(("a", F.col("lang")), ("b", F.lit(None)), ("c", third)).alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%d s', CAST(trunc(s) AS INT)) WHEN s < 3600 THEN printf('%d min', CAST(trunc(s / 60) AS INT)) ELSE 'long' END AS eta FROM (SELECT o_orderkey, 90e0 / (1 + o_orderkey % 7) * (10 + o_orderkey % 40 - (1 + o_orderkey % 7)) AS s FROM orders)")
def indexing_eta(spark, sf):
    done, total = 1 + F.col("o_orderkey") % 7, 10 + F.col("o_orderkey") % 40
    e = R.eta(done, total, F.lit(90.0))
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.endswith(e, F.lit("h")), "long").otherwise(e).alias("eta"))
