"""Queries over what an assistant keeps and sends: facts, contexts, tool results, checkpoints, listings, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import hits as H
from ..operators import memory, messages, sessions
from .base import query, table
from .hits import HITS, hits

FACT = "text"
for _prefix in T.FACT_PREFIXES:
    FACT = f"replace({FACT}, '{_prefix}', '')"
FACT = f"regexp_replace(lower({FACT}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


@query(f"""WITH f AS (SELECT conv_id, turn, text AS fact, {FACT} AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, turn, fact FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY conv_id, turn) AS rn FROM f WHERE n NOT IN (SELECT {FACT} FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)) WHERE rn = 1""")
def new_facts(spark, sf):
    """The whole message is the fact."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("fact"))
    found, held = rows.where("role = 'user'").drop("role"), rows.where("role = 'assistant'").select("fact")
    return memory.new_facts(found, held, "fact", ["conv_id", "turn"])


@query("""SELECT conv_id, CAST(turn AS DOUBLE) AS turn, role, md5(text) AS digest FROM conversations UNION ALL
SELECT conv_id, min(turn) - 0.5e0, 'system', md5('about ' || conv_id) FROM conversations WHERE role = 'user' AND conv_id % 3 > 0 GROUP BY conv_id""")
def retrieval_context(spark, sf):
    """Every third conversation has no context and stays as it is."""
    rows = table(spark, sf, "conversations")
    contexts = rows.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("about "), F.col("conv_id").cast("string"))).alias("context"))
    return messages.insert_context(rows, contexts, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, text, role = 'assistant' AND turn % 3 = 1 AS calls FROM conversations),
l AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM m WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM m WHERE calls) GROUP BY conv_id),
o AS (SELECT conv_id, 0 AS part, turn, 'user' AS role, text FROM l UNION ALL SELECT conv_id, 3, turn, 'user', '请基于上述工具执行结果，直接回答用户的问题。' FROM l UNION ALL
SELECT conv_id, 1, turn, 'assistant', '我需要调用工具来获取信息：search, read' FROM m WHERE calls AND conv_id IN (SELECT conv_id FROM l) UNION ALL
SELECT conv_id, 2, turn, 'tool', CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '... (内容已截断)' ELSE text END FROM m WHERE role = 'tool' AND conv_id IN (SELECT conv_id FROM l))
SELECT * FROM o""")
def forced_answer(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("calls", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.array(F.lit("search"), F.lit("read"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))
    return messages.answer_thread(rows, "conv_id", "turn", "role", "text", "calls", most=100)


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 2 AND conv_id % 2 = 0 THEN '（无可用工具）' WHEN conv_id % 2 = 0 THEN '' ELSE role END AS text, CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS n_calls FROM conversations""")
def allowed_tool_calls(spark, sf):
    """By turn: one call that is not allowed, two of those, one of each kind, none."""
    call = lambda *names: F.array(*(F.struct(F.lit(n).alias("name")) for n in names))
    turn, none = F.col("turn") % 4, F.array().cast("array<struct<name:string>>")
    calls = F.when(turn == 0, call("shell")).when(turn == 1, call("shell", "kill")).when(turn == 2, call("shell", "search")).otherwise(none)
    text = F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("role"))
    out = messages.allowed_calls(text, calls, ["search"])
    return table(spark, sf, "conversations").select("conv_id", "turn", out["text"].alias("text"), F.size(out["calls"]).alias("n_calls"))


@query("SELECT item_id, CAST(o AS INT) AS ord, 'user' AS role, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS content FROM (SELECT item_id, 0 AS o, text AS c FROM benchmark WHERE item_id % 5 < 3 UNION ALL SELECT item_id, 2, left(text, 6) FROM benchmark WHERE item_id % 5 < 3) WHERE length(c) > 5")
def checkpoint_messages(spark, sf):
    """Checkpoints hold their messages in one of three places; some hold none or are broken."""
    message = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    held = F.struct(F.array(message(F.col("text")), message(F.lit("short")), message(F.left("text", F.lit(6)))).alias("messages"))
    kind = F.col("item_id") % 5
    payload = F.when(kind == 0, F.to_json(held)).when(kind == 1, F.to_json(F.struct(held.alias("channel_values")))).when(kind == 2, F.to_json(F.struct(held.alias("state")))).when(kind == 3, "{}").otherwise("{broken")
    return messages.checkpoint_messages(table(spark, sf, "benchmark").select("item_id", payload.alias("payload")), "item_id", "payload")


@query("""WITH s AS (SELECT user_id, event_type || '_' || CAST(hour(ts) AS VARCHAR) AS k, count(*) AS n, max(ts) AS seen FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, k) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM s)
SELECT user_id, string_agg(left(k, 8) || ': ' || n || '条消息 | ' || strftime(seen, '%m-%d %H:%M'), chr(10) ORDER BY rn) || CASE WHEN max(c) > 10 THEN chr(10) || '... 还有 ' || (max(c) - 10) || ' 个会话' ELSE '' END AS listing FROM r WHERE rn <= 10 GROUP BY user_id""")
def session_listing(spark, sf):
    key = F.concat_ws("_", "event_type", F.hour("ts").cast("string")).alias("k")
    rows = table(spark, sf, "events").groupBy("user_id", key).agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    return sessions.session_list(rows, "user_id", "k", "n", "seen")


@query("SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS yesterday, strftime(ts, '%Y-%m-%d') AS today, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS tomorrow, strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') AS day_after, dayname(ts) AS weekday FROM events")
def day_labels(spark, sf):
    return table(spark, sf, "events").select("event_id", T.day_labels(F.col("ts")).alias("d")).select("event_id", "d.*")


@query("SELECT item_id, 'cat:cs.CL AND all:' || text AS papers, text || ' language:python' AS code, 'web_' || (item_id % 7) || '_' || item_id AS thread, CASE WHEN item_id % 150 > 100 THEN 100 WHEN item_id % 150 < 1 THEN 1 ELSE item_id % 150 END AS n FROM benchmark")
def query_rewrites(spark, sf):
    q, i = F.col("text"), F.col("item_id")
    thread = T.thread_id(F.lit("web"), (i % 7).cast("string"), i.cast("string"))
    n = F.greatest(F.lit(1).cast("long"), F.least(F.lit(100).cast("long"), i % 150))
    return table(spark, sf, "benchmark").select("item_id", T.scoped_query(q, category=F.lit("cs.CL")).alias("papers"), T.scoped_query(q, language=F.lit("python")).alias("code"), thread.alias("thread"), n.alias("n"))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM hits),
b AS (SELECT query_id, string_agg('- [' || title || '](' || url || ') - ' || left(snippet, 100) || '...', chr(10) ORDER BY rank) AS body FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT t.query_id, '# topic ' || t.query_id || ' 研究报告' || coalesce(chr(10) || chr(10) || body, '') AS report FROM (SELECT CAST(range AS INT) AS query_id FROM range(4)) t LEFT JOIN b USING (query_id)""")
def research_reports(spark, sf):
    from pyspark.sql import Window as W

    ranked = hits(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("seq")))
    topics = spark.range(4).select(F.col("id").cast("int").alias("query_id"), F.concat(F.lit("topic "), F.col("id").cast("string")).alias("topic"))
    return H.research_report(ranked, topics)


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part))
SELECT l_partkey, max(CASE WHEN rn = 1 THEN l_returnflag END) AS type, count(DISTINCT l_orderkey) AS n_docs, coalesce(max(CASE WHEN rn = 1 AND l_linenumber > 2 THEN l_linestatus END), 'unknown') AS status, coalesce(max(CASE WHEN rn = 1 AND l_linenumber > 2 THEN 1 - l_discount END), 1) AS similarity FROM m GROUP BY l_partkey""")
def verification_report(spark, sf):
    """Lines stand for mentions of parts; the first two of an order are not aligned."""
    aligned = lambda c: F.when(F.col("l_linenumber") > 2, c)
    rows = table(spark, sf, "lineitem").withColumns({"status": aligned(F.col("l_linestatus")), "similarity": aligned(1 - F.col("l_discount"))})
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    return G.entity_report(rows, asked, "l_partkey", "l_returnflag", "l_orderkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE WHEN length(url) > 30 THEN left(url, 30) || '...' ELSE url END ELSE '' END AS description FROM pages")
def page_descriptions(spark, sf):
    """Pages of which every second has a description in its head."""
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<META name="description"  content="'), "url", F.lit('">'))).otherwise("")
    html = F.concat(head, "html")
    return table(spark, sf, "pages").select("page_id", T.truncate(T.meta_description(html), 30).alias("description"))
