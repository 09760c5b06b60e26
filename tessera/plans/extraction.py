"""Queries over chunks, dictionaries and mentions. The dictionary is derived from the documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import entities as E
from .base import query, table


def _frequencies(spark, sf):
    """(term, df, type) of the words of 8 letters or more: the documents that hold it and its main language."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{8,})"), F.lit(1)))).alias("term"))
    by_lang = words.groupBy("term", "lang").agg(F.count("*").alias("n"))
    return by_lang.groupBy("term").agg(F.sum("n").alias("df"), F.min(F.struct((-F.col("n")).alias("m"), "lang"))["lang"].alias("type"))


def dictionary(spark, sf):
    """(term, type): every word in at least 3 documents."""
    return _frequencies(spark, sf).where("df >= 3").select("term", "type")


DICT = """w AS (SELECT DISTINCT doc_id, lang, term FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[a-z]{8,}')) AS term FROM documents)),
c AS (SELECT term FROM w GROUP BY term HAVING count(*) >= 3),
d AS (SELECT term, lang AS type FROM (SELECT term, lang, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, lang) AS rn FROM w JOIN c USING (term) GROUP BY term, lang) WHERE rn = 1)"""


def contained(table: str, key: str, text: str = "text") -> str:
    """SQL of ``held`` (key, term, type): a term lies within one run of letters, so runs are looked into once, by the terms' first eight letters."""
    return f"""o AS (SELECT DISTINCT {key}, run FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[a-z]{{8,}}')) AS run FROM {table})),
g AS (SELECT DISTINCT run, substr(run, CAST(i AS INT), 8) AS front FROM (SELECT run, unnest(range(1, length(run) - 6)) AS i FROM (SELECT DISTINCT run FROM o))),
m AS (SELECT run, term, type FROM g JOIN d ON front = left(term, 8) AND contains(run, term)), held AS (SELECT DISTINCT {key}, term, type FROM o JOIN m USING (run))"""


WORDS = "u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{8,}')) AS term FROM documents)"


@query(f"WITH {DICT} SELECT type, count(*) AS n FROM d GROUP BY type")
def dictionary_stats(spark, sf):
    return dictionary(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {DICT}, {WORDS} SELECT doc_id, term, type, count(*) AS n FROM u JOIN d USING (term) GROUP BY ALL")
def dictionary_candidates(spark, sf):
    return E.word_mentions(table(spark, sf, "documents"), dictionary(spark, sf), "doc_id", "text").select("doc_id", "term", "type", "n")


@query(f"WITH {DICT}, {WORDS} SELECT term, any_value(type) AS type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM u JOIN d USING (term) GROUP BY term")
def mention_counts(spark, sf):
    found = E.word_mentions(table(spark, sf, "documents"), dictionary(spark, sf), "doc_id", "text")
    return found.groupBy("term").agg(F.min("type").alias("type"), F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"WITH {DICT}, {contained('benchmark', 'item_id')} SELECT item_id, term, type FROM held")
def query_entities(spark, sf):
    return E.contained_terms(table(spark, sf, "benchmark"), dictionary(spark, sf), "item_id", "text")


@query(f"WITH {DICT}, {contained('documents', 'doc_id')} SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id")
def terms_per_document(spark, sf):
    return E.contained_terms(table(spark, sf, "documents"), dictionary(spark, sf), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {DICT}, {contained('documents', 'doc_id')},
p AS (SELECT run, term, type, len(term) AS n, string_split(run, term) AS parts FROM m),
placed AS (SELECT run, term, type, CAST(list_sum(list_transform(parts[1:k], lambda x: len(x))) + (k - 1) * n AS BIGINT) AS a, n FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM p)),
q AS (SELECT *, a + n AS b, row_number() OVER (PARTITION BY run ORDER BY n DESC, term, a, type) AS i FROM (SELECT DISTINCT * FROM placed)),
r AS (SELECT DISTINCT run, CAST(NULL AS VARCHAR) AS term, CAST(NULL AS VARCHAR) AS type, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS i, FALSE AS ok, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken FROM q UNION ALL
SELECT run, term, type, a, b, i, ok, CASE WHEN ok THEN list_append(taken, {{'a': a, 'b': b}}) ELSE taken END FROM (
SELECT q.run, q.term, q.type, q.a, q.b, q.i, len(list_filter(r.taken, lambda t: t.a < q.b AND q.a < t.b)) = 0 AS ok, r.taken FROM r JOIN q ON q.run = r.run AND q.i = r.i + 1)),
x AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{{8,}}') AS runs, regexp_split_to_array(text, '[a-z]{{8,}}') AS gaps FROM documents),
y AS (SELECT doc_id, runs[k] AS run, CAST(list_sum(list_transform(gaps[1:k], lambda t: len(t))) + coalesce(list_sum(list_transform(runs[1:k - 1], lambda t: len(t))), 0) AS BIGINT) AS base FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS k FROM x))
SELECT doc_id, term, CAST(base + a AS INT) AS start, CAST(base + b AS INT) AS "end", type, 0.95e0 AS confidence, 'dictionary' AS source FROM y JOIN (SELECT * FROM r WHERE ok) USING (run)""")
def mentions_resolved(spark, sf):
    """Greedy resolution of overlaps: the longest term claims its characters first."""
    return E.resolved(table(spark, sf, "documents"), dictionary(spark, sf), "doc_id", "text")


@query("SELECT doc_id, CAST(i // 1800 AS INT) AS chunk_index, md5(substr(text, CAST(i + 1 AS INT), 2000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents)")
def fixed_windows(spark, sf):
    rows = C.chunk_documents(table(spark, sf, "documents"), kind="windows")
    return rows.select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query()
def sentence_chunks(spark, sf):
    rows = C.chunk_documents(table(spark, sf, "documents"), kind="sentences")
    return rows.select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query()
def paragraph_chunks(spark, sf):
    rows = C.chunk_documents(table(spark, sf, "documents"))
    return rows.select("doc_id", "chunk_index", "chunk_id", F.md5("chunk").alias("digest"))


@query("SELECT doc_id, length(text) <= 2000 AS whole, length(text) AS n FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def whole_documents(spark, sf):
    """Documents that need no chunking, read off the chunker itself."""
    docs = table(spark, sf, "documents").where(F.length(F.regexp_replace("text", r"\s", "")) > 0)
    chunks = C.paragraphs(F.col("text"))
    return docs.select("doc_id", ((F.size(chunks) == 1) & (F.length("text") <= 2000)).alias("whole"), F.length("text").cast("long").alias("n"))


@query()
def chunk_offsets(spark, sf):
    docs = table(spark, sf, "documents").withColumn("chunks", C.sentences(F.col("text"), 2000, 200))
    return docs.select("doc_id", F.posexplode(C.offsets(F.col("text"), F.col("chunks"))).alias("chunk_index", "start"))


MENTION = "substr(text, CAST(1 + doc_id % 90 AS INT), 25)"


@query(f"SELECT doc_id, CAST(a + p - 1 AS INT) AS start, CAST(a + p - 1 + length(m) AS INT) AS \"end\" FROM (SELECT doc_id, m, a, instr(substr(text, CAST(a + 1 AS INT)), m) AS p FROM (SELECT doc_id, text, {MENTION} AS m, doc_id % 40 AS a FROM documents)) WHERE p > 0 AND m <> ''")
def align_exact(spark, sf):
    docs = table(spark, sf, "documents").withColumn("m", F.substring("text", (1 + F.col("doc_id") % 90).cast("int"), F.lit(25))).withColumn("at", (F.col("doc_id") % 40).cast("int"))
    return E.exact_alignment(docs, F.col("m"), F.col("text"), F.col("at")).where("start IS NOT NULL").select("doc_id", "start", "end")


def _aligned(spark, sf):
    items = table(spark, sf, "benchmark").withColumn("at", F.lit(0))
    own = F.substring("text", 20, 60)
    kind = F.col("item_id") % 4
    m = F.when(kind == 0, own).when(kind == 1, F.upper(own)).when(kind == 2, F.regexp_replace(own, r"(\w+) (\w+)$", "$1 changed")).otherwise(F.lit("nothing alike whatsoever 0"))
    return E.align(items.withColumn("mention", m))


@query()
def align_fuzzy(spark, sf):
    return _aligned(spark, sf).select("item_id", "start", "end", "status", F.round("similarity", 6).alias("similarity"))


@query()
def alignment_verified(spark, sf):
    return E.verify(_aligned(spark, sf), "mention", "text").select("item_id", "status", "passed")


@query("WITH s AS (SELECT CASE event_type WHEN 'view' THEN 'match_exact' WHEN 'click' THEN 'match_lesser' WHEN 'purchase' THEN 'match_fuzzy' ELSE 'unknown' END AS status FROM events) SELECT status, count(*) AS n, CAST(round_even(count(*) * 100 / sum(count(*)) OVER (), 1) AS VARCHAR) || '%' AS share FROM s GROUP BY status")
def alignment_stats(spark, sf):
    status = F.when(F.col("event_type") == "view", "match_exact").when(F.col("event_type") == "click", "match_lesser").when(F.col("event_type") == "purchase", "match_fuzzy")
    return E.alignment_stats(table(spark, sf, "events").select(status.alias("status")))


@query(f"SELECT doc_id, substr(text, CAST(greatest(a - 30, 0) + 1 AS INT), CAST(a - greatest(a - 30, 0) AS INT)) || '[[' || substr(text, CAST(a + 1 AS INT), 12) || ']]' || substr(text, CAST(a + 13 AS INT), 30) AS line FROM (SELECT doc_id, text, doc_id % 60 AS a FROM documents)")
def highlight_context(spark, sf):
    a = (F.col("doc_id") % 60).cast("int")
    return table(spark, sf, "documents").select("doc_id", T.highlight(F.col("text"), a, a + 12).alias("line"))


@query("SELECT l_partkey AS name, arg_min(p_brand, l_orderkey) AS type, count(DISTINCT l_orderkey) AS n_docs, min(l_orderkey) AS first_doc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey")
def inverted_index(spark, sf):
    rows = mentions(spark, sf)
    return E.inverted_index(rows, "name", "type", "doc_id", "doc_id").select("name", "type", "n_docs", "first_doc")


def mentions(spark, sf):
    """Parts in orders as entities in chunks: name, type, doc_id, ord."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("type"))
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"))
    return lines.join(parts, "name")


@query("SELECT name, type, n_docs, CAST(rank AS INT) AS rank FROM (SELECT l_partkey AS name, p_brand AS type, count(DISTINCT l_orderkey) AS n_docs, row_number() OVER (PARTITION BY p_brand ORDER BY l_partkey) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_brand) WHERE rank <= 20")
def entities_by_type(spark, sf):
    index = mentions(spark, sf).groupBy("name", "type").agg(F.count_distinct("doc_id").alias("n_docs"))
    rank = F.row_number().over(W.partitionBy("type").orderBy("name"))
    return index.withColumn("rank", rank).where("rank <= 20")


@query("SELECT count(DISTINCT l_orderkey) AS n_docs, count(DISTINCT l_partkey) AS n_entities, count(*) AS n_mentions, count(DISTINCT p_brand) AS n_types FROM lineitem JOIN part ON l_partkey = p_partkey")
def graph_stats(spark, sf):
    return mentions(spark, sf).agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("name").alias("n_entities"), F.count("*").alias("n_mentions"), F.count_distinct("type").alias("n_types"))


@query("WITH r AS (SELECT l_orderkey AS doc_id, l_partkey AS name, l_discount AS confidence, l_linenumber AS ord FROM lineitem) SELECT doc_id, name, confidence, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, ord) AS rn FROM r) WHERE rn = 1")
def best_mention_per_name(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("name"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("ord"))
    return E.best_per_name(rows, ["doc_id", "name"], ["ord"])


@query(f"WITH {DICT}, o AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{8,}}')) AS term FROM benchmark)), m AS (SELECT term, type, 1 AS priority FROM d UNION ALL SELECT term, 'private', 2 FROM o) SELECT term, arg_max(type, priority) AS type FROM m GROUP BY term")
def dictionary_merge(spark, sf):
    """The dictionary under one of all words of 8 letters or more in the benchmark."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{8,})"), F.lit(1))).alias("term")).distinct()
    base = dictionary(spark, sf).select(F.lit("all").alias("dict_name"), "term", "type", F.lit(1).alias("priority"))
    return E.merge_dictionaries(base.unionByName(words.select(F.lit("own").alias("dict_name"), "term", F.lit("private").alias("type"), F.lit(2).alias("priority"))))


@query(f"""WITH {DICT}, s AS (SELECT doc_id || '_' || (i // 1800) AS chunk_id, substr(text, CAST(i + 1 AS INT), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents)), {contained('s', 'chunk_id', 'chunk')},
r AS (SELECT chunk_id, count(*) / (SELECT count(*) FROM d) AS score FROM held GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 10) SELECT chunk_id, round(score, 6) AS score FROM r""")
def overlap_search(spark, sf):
    """Chunks by the share of the dictionary's terms that they hold."""
    terms = dictionary(spark, sf)
    chunks = C.chunk_documents(table(spark, sf, "documents"), kind="windows")
    found = E.contained_terms(chunks, terms, "chunk_id", "chunk").groupBy("chunk_id").agg(F.count_distinct("term").alias("held"))
    found = found.crossJoin(F.broadcast(terms.agg(F.count("*").alias("n")))).select("chunk_id", (F.col("held") / F.col("n")).alias("score"))  # one row
    return found.orderBy(F.desc("score"), "chunk_id").limit(10).withColumn("score", F.round("score", 6))
