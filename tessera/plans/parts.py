"""Queries of single functions and of sources and streams, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown, rules
from ..functions import text as T
from ..operators import hits as H
from ..operators import messages as M
from ..operators import vectors as O
from ..sources import files, payloads
from ..streaming import live
from .base import folder, query, table
from .hits import HITS, hits
from .vectors import SCORED, vector_of

CUT = lambda mark: f"CASE WHEN contains(p, {mark}) THEN length(p) - strpos(reverse(p), reverse({mark})) - length({mark}) + 1 ELSE 0 END"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, 0 AS i, '' AS part, coalesce(text, '') AS s FROM documents UNION ALL
SELECT doc_id, i + 1, CASE WHEN length(s) > 500 THEN left(s, cut_at) ELSE s END, CASE WHEN length(s) > 500 THEN regexp_replace(substr(s, cut_at + 1), '^\\s+|\\s+$', '', 'g') ELSE '' END FROM (
SELECT doc_id, i, s, CAST(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c ELSE 500 END AS INT) AS cut_at FROM (
SELECT *, {CUT("chr(10)")} AS a, {CUT("'。'")} AS b, {CUT("'. '")} AS c FROM (SELECT *, left(s, 500) AS p FROM r WHERE s <> ''))))
SELECT doc_id, CAST(i - 1 AS INT) AS part, md5(part) AS digest FROM r WHERE i > 0""")
def natural_parts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(M.split_natural(F.col("text"), 500)).alias("part", "text")).select("doc_id", "part", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, text || role || 'end' AS text FROM conversations WHERE text IS NOT NULL")
def nested_texts(spark, sf):
    shown, inner = F.struct("text", F.lit("not shown").alias("other")), F.struct(F.array("role", F.lit("end")).alias("b"))
    nested = F.to_json(F.struct(F.struct(shown.alias("a"), inner.alias("c")).alias("parts")))
    return table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", T.json_text(nested).alias("text"))


@query("SELECT conv_id, turn, role AS category, ltrim(replace(text, chr(10), ' ')) AS fact FROM conversations WHERE text IS NOT NULL AND ltrim(replace(text, chr(10), ' ')) <> ''")
def remembered_lines(spark, sf):
    reply = F.concat(F.lit("facts:\n- ["), F.col("role"), F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n* [no] item\n-"))
    return table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.inline(rules.memory_lines(reply)))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS name FROM documents")
def stated_names(spark, sf):
    said = F.concat(F.lit("你好，我"), F.when(F.col("doc_id") % 3 > 0, "叫 ").otherwise("是 "), F.col("source"), F.lit("。谢谢"))
    return table(spark, sf, "documents").select("doc_id", rules.stated_name(said).alias("name"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 ELSE 0 END AS images, CASE page_id % 3 WHEN 0 THEN 1 ELSE 2 END AS files FROM pages")
def attachments_by_kind(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html")
    parts = M.by_mime(F.array(F.struct("url", kind.alias("content_type")), F.struct("url", F.lit("application/pdf").alias("content_type"))))
    return table(spark, sf, "pages").select("page_id", F.size(parts["images"]).alias("images"), F.size(parts["files"]).alias("files"))


@query(f"WITH {HITS} SELECT query_id, CAST(engine_rank AS INT) AS engine_rank, url, score FROM hits UNION ALL SELECT query_id, 0, url, 2e0 FROM hits WHERE seq % 10 = 0 AND snippet <> ''")
def answers_first(spark, sf):
    rows = hits(spark, sf).select("query_id", "seq", "engine_rank", "title", "url", "snippet", "score")
    answers = rows.where("seq % 10 = 0").select("query_id", "title", "url", "snippet")
    return payloads.answer_first(rows.drop("seq"), answers).select("query_id", "engine_rank", "url", "score")


@query("SELECT doc_id, lang || '|' || source AS code FROM documents")
def inline_codes(spark, sf):
    said = F.concat(F.lit("`"), "lang", F.lit("` and\n```py\n`none`\n```\n then `"), "source", F.lit("` `"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(markdown.inline_code(said), "|").alias("code"))


#: Names of models, and the size that each stands for.
MODELS = (("x-0.5b", 1, 18), ("x-1b", 1, 18), ("x-1.5b", 1, 18), ("x-4b", 4, 37), ("x-3b", 4, 37), ("x-7b", 7, 64), ("x-8b", 8, 64), ("x-70b", 70, 640), ("x-72b", 70, 640), ("other", 7, 64))
MODEL_ROWS = ", ".join(f"({i}, {size}, {mb})" for i, (_, size, mb) in enumerate(MODELS))


@query(f"SELECT doc_id, CAST(greatest(0, floor((doc_id % 100 - size * 0.5e0 - 1) * 1024 / mb * 1024)) AS BIGINT) AS tokens FROM documents JOIN (VALUES {MODEL_ROWS}) m(i, size, mb) ON i = doc_id % {len(MODELS)}")
def contexts_that_fit(spark, sf):
    name = F.get(F.array(*(F.lit(n) for n, _, _ in MODELS)), (F.col("doc_id") % len(MODELS)).cast("int"))
    return table(spark, sf, "documents").select("doc_id", rules.affordable_context(name, (F.col("doc_id") % 100).cast("double")).alias("tokens"))


@query("SELECT page_id, lower(regexp_replace(url || ' 《A》_(b)-[c]', '[\\s\"''“”‘’《》()（）\\[\\]【】_-]', '', 'g')) AS name FROM pages")
def file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_filename(F.concat("url", F.lit(" 《A》_(b)-[c]"))).alias("name"))


@query("SELECT doc_id, lang || ', ' || source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', x' ELSE ', x et al.' END AS authors FROM documents")
def author_lines(spark, sf):
    names = F.slice(F.array("lang", "source", F.lit("x"), F.lit("y")), F.lit(1), (F.col("doc_id") % 3 + 2).cast("int"))
    return table(spark, sf, "documents").select("doc_id", T.join_authors(names).alias("authors"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day, strftime(ts, '%Y') || CASE WHEN event_id % 2 = 0 THEN '-' || strftime(ts, '%b') ELSE '' END AS rough FROM events")
def dates_of_papers(spark, sf):
    stamp = F.when(F.col("event_id") % 4 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date")
    rough = T.partial_date(F.date_format("ts", "yyyy"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MMM")), F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", T.iso_date(stamp).alias("day"), rough.alias("rough"))


@query("SELECT page_id, unnest([url, '(' || CAST(page_id AS VARCHAR) || ')']) AS suggestion FROM pages")
def suggested_terms(spark, sf):
    reply = F.concat(F.lit("callback("), F.to_json(F.struct(F.lit("q").alias("q"), F.array("url", F.concat(F.lit("("), F.col("page_id").cast("string"), F.lit(")"))).alias("s"))), F.lit(");"))
    return table(spark, sf, "pages").select("page_id", F.explode(payloads.suggestions(reply)).alias("suggestion"))


@query("SELECT DISTINCT event_type || '_' || CAST(user_id AS VARCHAR) || '_' || CAST(hour(ts) AS VARCHAR) AS thread FROM events")
def thread_ids(spark, sf):
    return table(spark, sf, "events").select(T.thread_id(F.col("event_type"), F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("thread")).distinct()


@query("SELECT doc_id, '## ' || lang || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## last' ELSE '' END AS sections FROM documents")
def memory_files(spark, sf):
    said = F.concat(F.lit("# title\nintro\n## "), "lang", F.lit("\n"), "source", F.lit("\n## 使用说明\nhow\n## 存储格式\nshape"), F.when(F.col("doc_id") % 2 == 0, "\n## last").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", rules.memory_sections(said).alias("sections"))


WORDS = ", ".join(f"'{w}'" for w in rules.MEMORABLE)


@query(f"SELECT conv_id, turn, len(list_filter([{WORDS}], lambda w: contains(lower(t), lower(w)))) > 0 AS kept FROM (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN list_extract([{WORDS}], CAST(conv_id % {len(rules.MEMORABLE)} + 1 AS INT)) ELSE '' END AS t FROM conversations)")
def memorable_messages(spark, sf):
    word = F.get(F.array(*map(F.lit, rules.MEMORABLE)), (F.col("conv_id") % len(rules.MEMORABLE)).cast("int"))
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, word).otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.memorable(said).alias("kept"))


@query("""WITH h AS (SELECT page_id, i, url || '#' || i AS url, CASE i WHEN 0 THEN 'first' ELSE '无标题' END AS title FROM pages, range(0, 3) r(i))
SELECT page_id, CAST(i + 1 AS INT) AS engine_rank, title, url, 'about <' || page_id || '>' AS snippet, round(1 - 0.1e0 * i, 6) AS score FROM h""")
def service_replies(spark, sf):
    item = lambda i: F.struct(F.lit("first" if not i else None).cast("string").alias("title"), F.concat("url", F.lit(f"#{i}")).alias("link"), F.concat(F.lit("<b>about</b> &lt;"), F.col("page_id").cast("string"), F.lit("&gt;")).alias("snippet"))
    replies = table(spark, sf, "pages").select("page_id", F.to_json(F.struct(F.array(*map(item, range(3))).alias("organic"))).alias("payload"))
    return payloads.hits(replies, "serper", key="page_id").select("page_id", "engine_rank", "title", "url", "snippet", "score")


@query("SELECT l_returnflag AS kind, l_partkey AS name, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def entities_first_seen(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return H.first_by(rows, F.col("name"), ["kind"], "ord")


@query(f"{SCORED}, e AS (SELECT DISTINCT l_partkey % 500 AS vec_id FROM lineitem WHERE l_quantity > 49) SELECT vec_id, round(score, 6) AS score FROM s WHERE vec_id IN (SELECT vec_id FROM e) ORDER BY s.score DESC, vec_id LIMIT 5")
def hybrid_graph_search(spark, sf):
    """The same as ``hybrid_fallback`` for a query whose entities are known."""
    found = table(spark, sf, "lineitem").where("l_quantity > 49").select((F.col("l_partkey") % 500).alias("vec_id")).distinct()
    return O.top_k_of_found(table(spark, sf, "embeddings").select("vec_id", "embedding"), found, vector_of(spark, sf), 5, "vec_id").withColumn("score", F.round("score", 6))


@query("""WITH l AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem),
b AS (SELECT q, ord, unnest([0, 1]) AS i, unnest(['- ' || p || ' (' || f || '): ' || s, '- ' || s || ' SUPPLIES ' || p || CASE WHEN f = 'R' THEN ': returned' ELSE '' END]) AS line FROM l),
k AS (SELECT * FROM (SELECT *, sum(length(line) // 2) OVER (PARTITION BY q, i ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM b) WHERE used <= CASE i WHEN 0 THEN 30 ELSE 45 END),
o AS (SELECT q, i, CASE i WHEN 0 THEN '## 实体信息' ELSE '## 关系信息' END || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS part FROM k GROUP BY q, i)
SELECT q, string_agg(part, chr(10) || chr(10) ORDER BY i) AS context FROM o GROUP BY q""")
def context_with_relations(spark, sf):
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), order.alias("ord"), F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag")
    entities = lines.select("q", "ord", F.col("part").alias("name"), F.col("l_returnflag").alias("type"), F.col("supplier").alias("description"))
    relations = lines.select("q", "ord", F.col("supplier").alias("src"), F.lit("SUPPLIES").alias("relation"), F.col("part").alias("dst"), F.when(F.col("l_returnflag") == "R", "returned").alias("description"))
    return rules.fused_context(entities, relations, "q", 30, 45)


def _item_files(spark, sf) -> str:
    """The benchmark's items as text files, a folder each."""
    path = folder(spark, "files")
    table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")).repartition("item_id").write.option("maxRecordsPerFile", 1).partitionBy("item_id").text(path)
    return path


def _item():
    return F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id")


@query("SELECT item_id, 'txt' AS extension, text || chr(10) AS text FROM benchmark WHERE text IS NOT NULL")
def documents_read(spark, sf):
    return files.read_documents(spark, _item_files(spark, sf)).select(_item(), "extension", "text")


@query("SELECT item_id, octet_length(encode(text)) + 1 AS size FROM benchmark")
def files_scanned(spark, sf):
    return files.scan(spark, _item_files(spark, sf)).select(_item(), "size")


@query("SELECT item_id FROM benchmark")
def files_found(spark, sf):
    return files.find_files(spark, _item_files(spark, sf), "PART-", "txt", 1 << 30).select(_item())


@query("SELECT item_id, CAST(i AS INT) AS line, lines[i + 1] AS text FROM (SELECT *, unnest(range(0, len(lines))) AS i FROM (SELECT item_id, string_split(text || chr(10), chr(10)) AS lines FROM benchmark))")
def first_lines(spark, sf):
    rows = files.head_lines(spark, _item_files(spark, sf), keep=["item_id"])
    return rows.select(F.col("item_id").cast("long"), "line", "text")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_upserts(spark, sf):
    """Events as a stream of row versions, merged batch by batch into generations of a table."""
    path = folder(spark, "stream")
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")
    done = live.merge_stream(stream, f"{path}/table", f"{path}/state", ["user_id", "event_type"], "event_id", live.latest_generation)
    done.awaitTermination()
    return live.latest_generation(spark, f"{path}/table/{done.lastProgress['batchId']}").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    rows = live.counts_by_window(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", length="1 hour")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


STATUS = ("pending", "running", "completed", "failed")


@query(f"""WITH s AS (SELECT user_id, event_id, list_extract({list(STATUS)}, CAST(event_id % 4 + 1 AS INT)) AS status FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
SELECT user_id, CASE WHEN arg_max(status, event_id) = 'running' THEN 'failed' ELSE arg_max(status, event_id) END AS status,
count(*) FILTER (before IS NOT NULL AND NOT (before || '>' || status IN ('pending>running', 'running>completed', 'running>failed', 'failed>running'))) AS broken FROM b GROUP BY user_id""")
def status_histories(spark, sf):
    status = F.get(F.array(*map(F.lit, STATUS)), (F.col("event_id") % 4).cast("int"))
    return live.replay_status(table(spark, sf, "events").select("user_id", "event_id", status.alias("status")), "user_id", "event_id")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, length(text), 1800)) AS i FROM documents) GROUP BY doc_id")
def stream_indexed(spark, sf):
    """Documents chunked once as they come in as files; counted by windows of 2,000 characters."""
    path = folder(spark, "index")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.write.parquet(f"{path}/in")
    live.index_directory(spark, f"{path}/in", "doc_id long, text string", f"{path}/out", f"{path}/state", kind="windows").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("doc_id").agg(F.count("*").alias("n"))
