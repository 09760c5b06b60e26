"""Queries over sessions, activity, quotas and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import sessions as S
from .base import query, table


@query("SELECT conv_id, count(*) AS checkpoints, md5(arg_min(text, turn)) AS first, md5(arg_max(text, turn)) AS last, count(*) * 2 AS message_count, '会话 ' || CAST(conv_id AS VARCHAR) AS name FROM conversations GROUP BY conv_id")
def restore_sessions(spark, sf):
    rows = S.restore_sessions(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    name = S.session_name(F.concat(F.lit("session_"), F.col("conv_id").cast("string")))
    return rows.select("conv_id", "checkpoints", F.md5("first").alias("first"), F.md5("last").alias("last"), "message_count", name.alias("name"))


@query("SELECT count(DISTINCT conv_id) AS n_threads, count(*) * 2 AS n_messages, count(DISTINCT role) AS n_roles FROM conversations")
def session_stats(spark, sf):
    return table(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("n_threads"), (F.count("*") * 2).alias("n_messages"), F.count_distinct("role").alias("n_roles"))


@query("SELECT conv_id, turn, CAST(back AS INT) AS back, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE length(text) > 5) WHERE back <= 3")
def session_history_lastn(spark, sf):
    rows = S.last_n(table(spark, sf, "conversations").where(F.length("text") > 5), "conv_id", "turn", 3)
    text = F.when(F.length("text") > 200, F.concat(F.left("text", F.lit(200)), F.lit("..."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "back", text.alias("text"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_human_message(spark, sf):
    return S.last_of_role(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "user")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-9, 4) AS mean FROM events")
def rolling_response_mean(spark, sf):
    rows = S.rolling_mean(table(spark, sf, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value")
    return rows.select("event_id", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-9, 4) AS mean FROM events")
def speed_window(spark, sf):
    rows = S.rolling_mean(table(spark, sf, "events"), ["ts", "event_id"], "value", 10, ["event_type"])
    return rows.select("event_type", "event_id", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failures, round((count(*) - count(*) FILTER (event_type = 'error')) / count(*) * 100, 6) AS rate FROM events GROUP BY user_id")
def runner_stats(spark, sf):
    return S.runner_stats(table(spark, sf, "events"), F.col("event_type") == "error", "user_id").withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS calls, least(count(*), 20) AS accepted FROM events GROUP BY ALL")
def quota_epoch_windows(spark, sf):
    rows = S.epoch_quota(table(spark, sf, "events"), "event_type", "ts", 20)
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "calls", F.col("accepted").cast("long").alias("accepted"))


@query("""WITH RECURSIVE w AS (SELECT event_type, min(ts) AS s FROM events GROUP BY event_type UNION ALL SELECT w.event_type, min(e.ts) FROM w JOIN events e ON e.event_type = w.event_type AND e.ts > w.s + INTERVAL 3600 SECOND GROUP BY w.event_type)
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, s ORDER BY ts, event_id) <= 500 AS accepted FROM (SELECT e.event_id, e.event_type, e.ts, w.s FROM events e ASOF JOIN w ON e.event_type = w.event_type AND e.ts >= w.s)""")
def quota_anchored(spark, sf):
    calls = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return S.anchored_quota(calls, "event_type", "ts", 500, 3600, ["ts", "event_id"]).select("event_id", "event_type", "accepted")


@query("SELECT event_type, count(*) AS used, greatest(0, 2500 - count(*)) AS remaining, round(count(*) / 2500 * 100, 6) AS share FROM events GROUP BY event_type")
def quota_usage_report(spark, sf):
    used = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("used"))
    return S.quota_report(used, F.lit(2500).cast("long")).withColumn("share", F.round("share", 6))


@query("SELECT event_id, coalesce(lag(event_type) OVER w = event_type AND epoch(ts) - epoch(lag(ts) OVER w) <= 3600, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ttl_cache_replay(spark, sf):
    return S.ttl_cache(table(spark, sf, "events"), "user_id", "ts", "event_type", 3600, ["ts", "event_id"]).select("event_id", "hit")


@query("SELECT doc_id, lang, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) AS rn FROM (SELECT doc_id, lang, 1 AS v FROM documents UNION ALL SELECT doc_id, upper(lang), 2 FROM documents JOIN labels USING (doc_id) WHERE quality = 0)) WHERE rn = 1")
def upsert_latest(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.select("doc_id", "lang", F.lit(1).alias("v"))
    poor = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    new = docs.join(poor, "doc_id").select("doc_id", F.upper("lang").alias("lang"), F.lit(2).alias("v"))
    return S.upsert(old, new, ["doc_id"], "v")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_antijoin(spark, sf):
    return S.unseen(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def delete_thread(spark, sf):
    rows = table(spark, sf, "conversations")
    return S.unseen(rows, rows.where("role = 'system'"), ["conv_id"]).select("conv_id", "turn")


@query("SELECT c_custkey, CAST(5 + coalesce(n, 0) AS BIGINT) AS message_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def session_activity(spark, sf):
    sessions = table(spark, sf, "customer").select("c_custkey", F.lit(5).cast("long").alias("message_count"), F.lit(None).cast("timestamp").alias("updated_at"))
    activity = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).cast("long").alias("n"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return S.apply_activity(sessions, activity, ["c_custkey"]).select("c_custkey", "message_count")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id")
def gap_sessions(spark, sf):
    rows = S.gap_sessions(table(spark, sf, "events"), "user_id", "ts")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query()
def message_split(spark, sf):
    """Messages packed line by line into parts that a channel takes."""
    from ..operators.messages import split_lines

    parts = split_lines(F.col("text"), 200)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("part", "text"))


@query("SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS chunks FROM (SELECT doc_id, CAST(ceil(length(text) / 1800) AS BIGINT) AS k FROM documents)")
def indexing_progress(spark, sf):
    chunks = C.windows(F.col("text"), 2000, 200)
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum(F.size(chunks)).alias("chunks"))
