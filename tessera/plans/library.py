"""Queries over the register of documents, index files, stored messages, and extraction from chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import context as X
from ..operators import entities as E
from ..operators import extraction as EX
from ..operators import graph as G
from ..operators import hits as H
from ..operators import library as L
from ..operators import memory as M
from ..operators import sessions as S
from .base import folder, query, table
from .context import COST
from .extraction import dictionary, mentions
from .hits import HITS, hits

STATUS = "CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'pending' ELSE 'completed' END"


def register(spark, sf):
    """Every document as an entry; two of five are not complete."""
    kind = F.col("doc_id") % 5
    status = F.when(kind == 0, L.FAILED).when(kind == 1, "pending").otherwise(L.COMPLETED)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), status.alias("status"))


@query(f"SELECT doc_id, n_chars AS score, 'doc ' || doc_id AS document_name FROM documents WHERE {STATUS} = 'completed' ORDER BY n_chars DESC, doc_id LIMIT 10")
def completed_search(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    reg = register(spark, sf)
    done = L.in_completed(found, reg)
    return done.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score", "document_name")


@query(f"""WITH d AS (SELECT * FROM documents WHERE {STATUS} = 'completed')
SELECT count(*) AS total_documents, CAST(sum(n_chars % 7) AS BIGINT) AS total_entities, CAST(sum(n_chars % 3) AS BIGINT) AS total_relations, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM d) AS entity_types FROM d""")
def library_stats(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("documents"), (F.col("n_chars") % 7).alias("entities"), (F.col("n_chars") % 3).alias("relations"), F.array("lang").alias("types"))
    return L.global_stats(own, register(spark, sf)).withColumn("entity_types", F.array_join("entity_types", ","))


@query(f"""SELECT count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'pending') AS remaining,
round(count(*) FILTER (s <> 'pending') * 100 / count(*), 6) AS percent FROM (SELECT {STATUS} AS s FROM documents)""")
def library_progress(spark, sf):
    return L.progress(register(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("""WITH o AS (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN n_chars % 10 = 0 THEN 'errors' ELSE 'indexed' END AS outcome FROM documents)
SELECT count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'errors') AS errors FROM o""")
def scan_outcomes(spark, sf):
    """Labelled documents count as indexed before; a size divisible by ten stands for a file that cannot be read."""
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    files = table(spark, sf, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    outcome = L.scan_outcome(F.coalesce("known", F.lit(False)), F.when(F.col("n_chars") % 10 == 0, "unreadable"))
    return L.scan_summary(files.select(outcome.alias("outcome")))


@query("SELECT t, doc_id FROM (SELECT 'register' AS t, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def document_removed(spark, sf):
    """Documents labelled toxic leave the register and the table of labels."""
    labels = table(spark, sf, "labels")
    left = L.without_document({"register": register(spark, sf), "labels": labels}, labels.where("toxic = 1"))
    return left["register"].select(F.lit("register").alias("t"), "doc_id").unionByName(left["labels"].select(F.lit("labels").alias("t"), "doc_id"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc ' || doc_id AS name, {STATUS} AS status, CAST(n_chars % 7 AS INT) AS entities_count FROM documents")
def register_saved(spark, sf):
    """The register written as lines of JSON and read back."""
    rows = register(spark, sf).join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 7).cast("int").alias("entities_count")), "doc_id")
    path = folder(spark, "register")
    L.write_register(rows.withColumn("doc_id", F.col("doc_id").cast("string")), path)
    return L.load_register(spark, path).select("doc_id", "name", "status", "entities_count")


@query("SELECT l_partkey AS name, any_value(p_brand) AS type, l_orderkey AS doc_id FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_orderkey")
def index_saved(spark, sf):
    """Postings of a model written to its folder and read back."""
    path = folder(spark, "index")
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("SUPPLIED").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("doc_id"))
    L.save_index(mentions(spark, sf).select("name", "type", "doc_id"), lines, path, "m1")
    return L.load_index(spark, path, "m1")[0]


@query("""WITH n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS role, text FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, md5(text) AS digest FROM conversations UNION ALL SELECT conv_id, last + row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, md5(text) FROM m JOIN n USING (conv_id)""")
def messages_appended(spark, sf):
    """Every conversation is said again behind its end; system messages are not stored."""
    rows = table(spark, sf, "conversations").withColumn("timestamp", F.lit(0.0)).withColumnRenamed("text", "content")
    out = S.appended(rows, rows.drop("timestamp"), "conv_id", "turn", F.lit(1.0))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.md5("content").alias("digest"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user' AND length(text) BETWEEN 1 AND 49) > 0 THEN '讨论过 ' || count(*) FILTER (role = 'user' AND length(text) BETWEEN 1 AND 49) || ' 个话题' ELSE '对话历史已压缩' END AS summary FROM conversations GROUP BY conv_id")
def simple_summaries(spark, sf):
    return X.simple_summary(table(spark, sf, "conversations"), "conv_id", "role", "text")


@query("SELECT conv_id, role, CAST(floor(coalesce(sum(length(text)), 0) * 1.5e0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, role")
def layer_token_counts(spark, sf):
    return X.layer_tokens(table(spark, sf, "conversations"), "conv_id", "role", "text")


@query(f"""WITH due AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING sum({COST}) >= 800 * 0.8e0), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system' AND conv_id IN (SELECT conv_id FROM due)),
k AS (SELECT conv_id, CAST(turn AS DOUBLE) AS turn, role, text FROM o WHERE back <= 3), f AS (SELECT conv_id, min(turn) AS first FROM k GROUP BY conv_id)
SELECT conv_id, CAST(turn AS DOUBLE) AS turn, role, md5(text) AS digest FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM due) OR role = 'system' UNION ALL SELECT conv_id, turn, role, md5(text) FROM k
UNION ALL SELECT conv_id, coalesce(first, 0) - 0.5e0, 'system', md5('about ' || conv_id) FROM due LEFT JOIN f USING (conv_id)""")
def compacted_messages(spark, sf):
    rows = table(spark, sf, "conversations")
    notes = rows.select("conv_id").distinct().select("conv_id", F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("summary"))
    return X.compacted(rows, notes, "conv_id", "turn", "role", "text", 800, keep=3).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS semantic, count(*) FILTER (event_type = 'click') AS procedural, count(*) FILTER (event_type NOT IN ('view', 'click')) AS episodic FROM events GROUP BY user_id")
def memory_kinds(spark, sf):
    kind = F.when(F.col("event_type") == "view", "semantic").when(F.col("event_type") == "click", "procedural").otherwise("episodic")
    return M.counts_by_kind(table(spark, sf, "events").withColumn("type", kind), ["user_id"])


@query(f"""WITH {HITS}, c AS (SELECT query_id, category, engine_ord, count(*) AS own FROM hits GROUP BY ALL),
b AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY query_id, category ORDER BY engine_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
p AS (SELECT h.query_id, category, seq, before + row_number() OVER (PARTITION BY h.query_id, category, engine_ord ORDER BY engine_rank) AS place FROM hits h JOIN b USING (query_id, category, engine_ord) WHERE before < 5) SELECT query_id, category, seq, CAST(place AS BIGINT) AS place FROM p WHERE place <= 5""")
def category_union(spark, sf):
    return H.by_category(hits(spark, sf), 5).select("query_id", "category", "seq", "place")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 2 = 0 AND NOT contains(lower(text), 'you'))")
def group_gate(spark, sf):
    """Every second conversation is a group's; there only messages that say ``you`` are answered."""
    kind = F.when(F.col("conv_id") % 2 == 0, "group").otherwise("private")
    return table(spark, sf, "conversations").where(R.answers(kind, F.contains(F.lower("text"), F.lit("you")), True)).select("conv_id", "turn")


@query("SELECT DISTINCT l_partkey AS name, l_partkey || ' ' || p_brand AS entity, l_partkey || ' 与 ' || l_suppkey || ' 相关' AS relation FROM lineitem JOIN part ON l_partkey = p_partkey")
def embedding_texts(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(brands, "l_partkey")
    part = F.col("l_partkey").cast("string")
    return rows.select(F.col("l_partkey").alias("name"), EX.entity_text(part, F.col("p_brand")).alias("entity"), EX.relation_text(part, F.col("l_suppkey").cast("string")).alias("relation"))


@query("SELECT conv_id, turn, CAST(i AS INT) AS place, w AS \"left\", 10 * i AS \"right\" FROM (SELECT conv_id, turn, unnest(range(0, least(5, len(string_split(text, ' '))))) AS i, unnest(string_split(text, ' ')[1:5]) AS w FROM conversations)")
def zipped_by_place(spark, sf):
    """Words zipped with five numbers, as far as both go."""
    pairs = EX.zipped(F.split("text", " "), F.array(*(F.lit(10 * i).cast("long") for i in range(5))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(pairs).alias("place", "p")).select("conv_id", "turn", "place", "p.*")


@query("""WITH r AS (SELECT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, length(CAST(l_partkey AS VARCHAR)) DESC, CAST(l_partkey AS VARCHAR)) AS k FROM lineitem)
SELECT a.name AS src, b.name AS dst, count(*) AS n FROM r a JOIN r b ON a.o = b.o AND a.k < b.k WHERE b.k <= 4 GROUP BY ALL""")
def cooccurrence_strongest(spark, sf):
    """Edges among the four surest parts of an order, the longer name first among equals."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").cast("string").alias("name"), F.col("l_discount").alias("confidence"))
    ranked, order = G.strongest_first(rows)
    return G.cooccurrence_weights(ranked, "chunk", "name", order, cap=4)


@query("SELECT o, term, CAST(rank AS INT) AS rank FROM (SELECT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS term, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, length(CAST(l_partkey AS VARCHAR)) DESC, CAST(l_partkey AS VARCHAR)) AS rank FROM lineitem) WHERE rank <= 3")
def strongest_mentions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("term"), F.col("l_discount").alias("confidence"))
    return E.strongest(rows, "o", 3).select("o", "term", "rank")


@query("SELECT o, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\", ord FROM (SELECT l_orderkey AS o, l_partkey % 3 AS s, l_partkey % 3 + 5 AS e, l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_discount DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def distinct_span_alignments(spark, sf):
    s = (F.col("l_partkey") % 3).cast("int")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), s.alias("start"), (s + 5).alias("end"), F.col("l_discount").alias("similarity"), F.col("l_linenumber").alias("ord"))
    return E.distinct_spans(rows, "o", "ord").select("o", "start", "end", "ord")


@query("SELECT page_id, regexp_extract(u, '^mcp://([^/]+)/(.+)$', 1) AS server, regexp_extract(u, '^mcp://([^/]+)/(.+)$', 2) AS tool FROM (SELECT page_id, replace(url, 'https://', 'mcp://') AS u FROM pages) WHERE regexp_matches(u, '^mcp://([^/]+)/(.+)$')")
def tool_references(spark, sf):
    ref = T.tool_reference(F.replace("url", F.lit("https://"), F.lit("mcp://")))
    return table(spark, sf, "pages").select("page_id", ref.alias("r")).where("r IS NOT NULL").select("page_id", "r.*")


def _replies(spark, sf):
    """A reply for each benchmark item: its third to fifth words as entities, the last one without type and confidence, and every fourth with three relations."""
    items = table(spark, sf, "benchmark").where(F.size(F.split("text", " ")) >= 5)
    word = lambda i: F.element_at(F.split("text", " "), i)
    named = F.array(F.struct(word(3).alias("name"), F.lit("thing").alias("type"), F.lit(0.9).alias("confidence")), F.struct(word(4).alias("name"), F.lit("thing").alias("type"), F.lit(0.6).alias("confidence")), F.struct(word(5).alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence")))
    link = F.array_repeat(F.struct(word(3).alias("source"), word(4).alias("target"), F.lit("NEXT").alias("relation"), F.lit(0.8).alias("confidence")), 3)
    said = F.when(F.col("item_id") % 4 == 0, F.to_json(F.struct(named.alias("entities"), link.alias("relations")))).otherwise(F.to_json(F.struct(named.alias("entities"))))
    return items.select("item_id", said.alias("reply"))


def _extracted(spark, sf):
    return EX.extract(table(spark, sf, "benchmark"), dictionary(spark, sf), "item_id", "text", _replies(spark, sf))


@query()
def hybrid_entities(spark, sf):
    """Dictionary, patterns and a model's replies over the benchmark's items."""
    return _extracted(spark, sf)[0]


@query()
def hybrid_relations(spark, sf):
    return _extracted(spark, sf)[1]


@query()
def learned_terms(spark, sf):
    return EX.learned(_extracted(spark, sf)[0], "item_id")
