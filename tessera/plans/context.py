"""Queries over budgets, compaction and memory: conversations as threads, documents as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import context as X
from ..operators import vectors as O
from .base import query, table
from .vectors import SCORED, vector_of

CJK = "length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))"
COST = f"CAST(floor(({CJK}) * 1.5e0 + (length(text) - ({CJK})) * 0.5e0) AS BIGINT)"
RECENT = "r AS (SELECT *, role = 'system' AS s, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS k FROM conversations)"


@query(f"WITH {RECENT} SELECT conv_id, turn FROM r WHERE s OR k <= 4")
def compaction_window(spark, sf):
    return X.compact(table(spark, sf, "conversations"), "conv_id", "turn", "role", 4).select("conv_id", "turn")


@query(f"WITH {RECENT} SELECT conv_id, count(*) AS n_before, count(*) FILTER (s OR k <= 4) AS n_after, CAST(sum({COST}) AS BIGINT) AS tokens_before, CAST(coalesce(sum({COST}) FILTER (s OR k <= 4), 0) AS BIGINT) AS tokens_after, round(CASE WHEN sum({COST}) > 0 THEN coalesce(sum({COST}) FILTER (s OR k <= 4), 0) / sum({COST}) ELSE 1 END, 6) AS ratio FROM r GROUP BY conv_id")
def compaction_report(spark, sf):
    return X.compaction_report(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 4).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT conv_id, CAST(sum({COST}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id HAVING sum({COST}) >= 800 * 0.8e0")
def compaction_trigger(spark, sf):
    return X.needs_compaction(table(spark, sf, "conversations"), "conv_id", "text", 800)


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text) * 1.5e0) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 900")
def working_budget(spark, sf):
    return X.suffix_fit(table(spark, sf, "conversations"), ["conv_id"], "turn", K.generous(F.col("text")), F.lit(900)).select("conv_id", "turn")


PARTS = "p AS (SELECT conv_id, turn AS ord, length(text) * 1.5e0 AS cost, CASE role WHEN 'system' THEN 'runtime' WHEN 'user' THEN 'working' ELSE 'knowledge' END AS layer, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'memory' ELSE 'kb' END AS kind FROM conversations)"


def _parts(spark, sf):
    role = F.col("role")
    layer = F.when(role == "system", "runtime").when(role == "user", "working").otherwise("knowledge")
    kind = F.when((role == "assistant") & (F.col("turn") % 4 == 1), "memory").otherwise("kb")
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), K.generous(F.col("text")).alias("cost"), layer.alias("layer"), kind.alias("kind"))


KNOWLEDGE = "m AS (SELECT * FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM {src} WHERE kind = 'memory') WHERE used <= {budget}), s AS (SELECT conv_id, max(used) AS spent FROM m GROUP BY conv_id), k AS (SELECT * FROM (SELECT t.*, coalesce(spent, 0) + sum(cost) OVER (PARTITION BY t.conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM {src} t LEFT JOIN s ON s.conv_id = t.conv_id WHERE kind = 'kb') WHERE used <= {budget})"


@query(f"WITH {PARTS}, g AS (SELECT * FROM p WHERE layer = 'knowledge'), {KNOWLEDGE.format(src='g', budget=1500)} SELECT conv_id, ord, kind, round(used, 6) AS used FROM m UNION ALL SELECT conv_id, ord, kind, round(used, 6) FROM k")
def knowledge_budget(spark, sf):
    rows = _parts(spark, sf).where("layer = 'knowledge'")
    return X.knowledge_fit(rows, ["conv_id"], "ord", F.col("cost"), F.lit(1500.0)).select("conv_id", "ord", "kind", F.round("used", 6).alias("used"))


@query(f"""WITH {PARTS}, l AS (SELECT conv_id, 2500 - floor(coalesce(sum(cost) FILTER (layer = 'runtime'), 0)) AS rem FROM p GROUP BY conv_id),
w AS (SELECT * FROM (SELECT p.*, rem, sum(cost) OVER (PARTITION BY p.conv_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS used FROM p JOIN l ON l.conv_id = p.conv_id WHERE layer = 'working' AND rem > 0) WHERE used <= least(1000, rem)),
t AS (SELECT l.conv_id, rem - coalesce(floor(max(used)), 0) AS rest FROM l LEFT JOIN w USING (conv_id) GROUP BY l.conv_id, l.rem),
g AS (SELECT p.*, rest FROM p JOIN t ON t.conv_id = p.conv_id WHERE layer = 'knowledge' AND rest > 0), {KNOWLEDGE.format(src='g', budget='rest')}
SELECT conv_id, layer, ord FROM p WHERE layer = 'runtime' UNION ALL SELECT conv_id, layer, ord FROM w UNION ALL SELECT conv_id, layer, ord FROM m UNION ALL SELECT conv_id, layer, ord FROM k""".replace("l.rem)", "rem)").replace("SELECT l.conv_id, rem -", "SELECT l.conv_id, l.rem -").replace("GROUP BY l.conv_id, rem)", "GROUP BY l.conv_id, l.rem)"))
def layer_optimizer(spark, sf):
    return X.fit_layers(_parts(spark, sf), "conv_id", 2500).select("conv_id", "layer", "ord")


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def session_export(spark, sf):
    rows = X.transcript(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.md5("transcript").alias("digest"))


QUERY_WORDS = "the and with der ist"
MEMORY = "s AS (SELECT doc_id AS id, text AS content, len(list_intersect(['the', 'and', 'with', 'der', 'ist'], list_distinct(regexp_split_to_array(lower(text), '\\s+')))) / 5e0 * (0.1e0 + doc_id % 7 / 10e0) AS score FROM documents)"


def _memories(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.lit(0.1) + F.col("doc_id") % 7 / 10).alias("importance"))


@query(f"WITH {MEMORY} SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 20")
def keyword_recall(spark, sf):
    return X.keyword_recall(_memories(spark, sf), F.lit(QUERY_WORDS), 20).select("id", F.round("score", 6).alias("score"))


@query(f"{SCORED}, v AS (SELECT d.doc_id AS id, d.text AS content, t.score FROM (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10) t JOIN documents d ON d.doc_id = t.vec_id), {MEMORY.replace('s AS', 'kw AS')}, k AS (SELECT * FROM kw WHERE score > 0 ORDER BY score DESC, id LIMIT 10), b AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY src, score DESC, id) AS rn FROM (SELECT *, 0 AS src FROM v UNION ALL SELECT *, 1 FROM k)) SELECT id, CASE src WHEN 0 THEN 'vector' ELSE 'keyword' END AS source, round(score, 6) AS score FROM b WHERE rn = 1 OR src = 0 ORDER BY b.score DESC, id, source LIMIT 10")
def hybrid_recall(spark, sf):
    docs = _memories(spark, sf)
    hits = O.top_k(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), vector_of(spark, sf), 10)
    by_vector = hits.join(docs.select("id", "content"), "id").select("id", "content", "score")
    by_keyword = X.keyword_recall(docs, F.lit(QUERY_WORDS), 10).select("id", "content", "score")
    return X.hybrid_recall(by_vector, by_keyword, 10).select("id", "source", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'system' WHEN turn % 7 = 5 THEN 'tool' WHEN role = 'user' THEN 'human' ELSE 'ai' END AS kind, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, '# 会话导出: ' || conv_id || chr(10) || chr(10) || '导出时间: 2024-03-05 06:07:08' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| string_agg(CASE kind WHEN 'human' THEN '**用户:** ' || text WHEN 'ai' THEN '**助手:** ' || text WHEN 'system' THEN '*[系统]* ' || left(text, 100) || '...' ELSE '*tool:* ' || text END || chr(10) || chr(10), '' ORDER BY turn)
|| '---' || chr(10) || chr(10) || '共 ' || count(*) || ' 条消息' || chr(10) AS markdown FROM m GROUP BY conv_id""")
def session_markdown(spark, sf):
    kind = F.when(F.col("turn") % 7 == 3, "system").when(F.col("turn") % 7 == 5, "tool").when(F.col("role") == "user", "human").otherwise("ai")
    rows = table(spark, sf, "conversations").withColumn("kind", kind)
    return X.session_markdown(rows, "conv_id", "turn", "kind", "text", F.lit("2024-03-05 06:07:08").cast("timestamp"))
