"""Queries over search hits: pages as hits of the engines that their hosts stand for."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hits as H
from ..operators.sessions import rank_rows
from .base import query, table
from .text import NORMAL_TITLE, TITLE, VISIBLE

HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
URL = "lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', ''), '^www\\.', ''))"
HITS = f"""h AS (SELECT CAST(page_id % 3 AS INT) AS query_id, page_id AS seq, url, {URL} AS u, {TITLE} AS title, {NORMAL_TITLE} AS t, left({VISIBLE}, 200) AS snippet, {HOST} AS engine,
CASE page_id % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'code' ELSE 'general' END AS category, row_number() OVER (PARTITION BY page_id % 3, {HOST} ORDER BY page_id) AS engine_rank, dense_rank() OVER (PARTITION BY page_id % 3 ORDER BY {HOST}) AS engine_ord FROM pages),
hits AS (SELECT *, round(1 - 0.1e0 * (engine_rank - 1), 6) AS score FROM h)"""


def hits(spark, sf):
    """Hits with seq, engine_rank, engine_ord and a score that falls by a tenth a place."""
    html = F.col("html")
    rows = table(spark, sf, "pages").select(
        (F.col("page_id") % 3).cast("int").alias("query_id"), F.col("page_id").alias("seq"), "url", T.html_title(html).alias("title"), F.left(T.html_to_text(html), F.lit(200)).alias("snippet"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("engine"), F.when(F.col("page_id") % 4 == 0, "academic").when(F.col("page_id") % 4 == 1, "code").otherwise("general").alias("category"),
    )
    rows = rows.withColumn("engine_rank", F.row_number().over(W.partitionBy("query_id", "engine").orderBy("seq")))
    engines = rank_rows(rows.select("query_id", "engine").distinct(), ["query_id"], ["engine"], "engine_ord")
    rows = rows.join(engines, ["query_id", "engine"])
    return rows.withColumn("score", F.round(1 - F.lit(0.1) * (F.col("engine_rank") - 1), 6)).withColumns({"author": F.lit(None).cast("string"), "published_date": F.lit(None).cast("string")})


@query(f"WITH {HITS} SELECT query_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id, u ORDER BY seq) AS rn FROM hits) WHERE rn = 1")
def hits_url_dedupe(spark, sf):
    return H.first_by(hits(spark, sf), T.normalize_url(F.col("url")), ["query_id"]).select("query_id", "seq")


@query(f"WITH {HITS} SELECT query_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY seq) AS rn FROM hits) WHERE rn = 1")
def hits_title_dedupe(spark, sf):
    return H.first_by(hits(spark, sf), T.normalize_title(F.col("title")), ["query_id"]).select("query_id", "seq")


@query(f"WITH {HITS} SELECT DISTINCT query_id, url, title FROM hits")
def hits_distinct(spark, sf):
    return hits(spark, sf).dropDuplicates(["query_id", "url", "title"]).select("query_id", "url", "title")


@query(f"""WITH RECURSIVE {HITS}, o AS (SELECT query_id, seq, u, t, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS i FROM hits),
g AS (SELECT DISTINCT query_id, CAST(NULL AS BIGINT) AS seq, 0 AS i, FALSE AS ok, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ts FROM o UNION ALL
SELECT query_id, seq, i, ok, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN list_append(ts, t) ELSE ts END FROM (
SELECT o.*, NOT list_contains(us, u) AND NOT list_contains(ts, t) AS ok, us, ts FROM g JOIN o ON o.query_id = g.query_id AND o.i = g.i + 1))
SELECT query_id, seq FROM g WHERE ok""")
def hits_greedy_dedupe(spark, sf):
    return H.greedy(hits(spark, sf)).select("query_id", "seq")


@query(f"WITH {HITS} SELECT query_id, seq FROM hits WHERE CASE WHEN score IS NULL OR score = 0 THEN 0.5 ELSE score END >= 0.6e0")
def hits_min_score(spark, sf):
    return hits(spark, sf).where(H.effective_score(F.col("score")) >= 0.6).select("query_id", "seq")


@query(f"WITH {HITS}, s AS (SELECT *, round(least(1e0, CASE WHEN score = 0 THEN 0.5e0 ELSE score END + CASE WHEN contains(lower(title), 'the') THEN 0.3e0 ELSE 0e0 END + CASE WHEN lower(title) = 'the' THEN 0.2e0 ELSE 0e0 END + CASE WHEN contains(lower(snippet), 'the') THEN 0.1e0 ELSE 0e0 END + CASE WHEN category = 'code' THEN 0.15e0 ELSE 0e0 END), 6) AS relevance FROM hits) SELECT query_id, seq, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, seq) AS INT) AS rank FROM s")
def hits_rank(spark, sf):
    return H.rank(hits(spark, sf), F.lit("the"), ("code",)).select("query_id", "seq", "relevance", "rank")


@query(f"WITH {HITS} SELECT 'source' AS kind, engine AS value, count(*) AS n FROM hits GROUP BY engine UNION ALL SELECT 'category', category, count(*) FROM hits GROUP BY category UNION ALL SELECT 'total', '', count(*) FROM hits")
def hits_stats(spark, sf):
    return H.stats(hits(spark, sf))


@query(f"WITH {HITS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, u ORDER BY engine_rank, engine_ord) AS rn FROM hits WHERE engine_rank <= 3) WHERE rn = 1) SELECT query_id, seq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY engine_rank, engine_ord) AS INT) AS place FROM f")
def hits_round_robin(spark, sf):
    return H.round_robin(hits(spark, sf), 3).select("query_id", "seq", "place")


@query(f"WITH {HITS}, c AS (SELECT query_id, engine_ord, count(*) AS own FROM hits GROUP BY ALL), b AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY query_id ORDER BY engine_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), p AS (SELECT h.query_id, seq, before + engine_rank AS place FROM hits h JOIN b USING (query_id, engine_ord) WHERE before < 10) SELECT query_id, seq, CAST(place AS BIGINT) AS place FROM p WHERE place <= 10")
def engine_early_stop(spark, sf):
    return H.early_stop(hits(spark, sf), 10).select("query_id", "seq", "place")


@query(f"WITH {HITS}, own AS (SELECT * FROM hits WHERE query_id = 0), q AS (SELECT DISTINCT query_id FROM hits) SELECT query_id, seq FROM own UNION ALL SELECT query_id, seq FROM hits WHERE engine_rank = 1 AND query_id NOT IN (SELECT query_id FROM own)")
def engine_fallback(spark, sf):
    rows = hits(spark, sf)
    return H.with_fallback(rows, rows.where("query_id = 0"), rows.where("engine_rank = 1")).select("query_id", "seq")


PREFERRED = ", ".join(f"('{c}', {i}, '{e}')" for c, names in H.ENGINES.items() for i, e in enumerate(names))


@query(f"""WITH p AS (SELECT * FROM (VALUES {PREFERRED}) t(category, ord, engine)), k AS (SELECT category, count(*) AS size FROM p GROUP BY category),
c AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'academic' WHEN 1 THEN 'code' WHEN 2 THEN 'encyclopedia' WHEN 3 THEN 'general' ELSE 'research' END AS category FROM pages),
h AS (SELECT category, p.engine, count(*) AS n FROM c JOIN k USING (category) JOIN p USING (category) WHERE p.ord = size - 1 - (page_id // 7) % greatest(1, size - 1) GROUP BY ALL)
SELECT category, ord, engine, coalesce(n, 0) AS n, coalesce(ord = min(ord) FILTER (n > 0) OVER (PARTITION BY category), FALSE) AS first FROM p LEFT JOIN h USING (category, engine)""")
def engines_by_category(spark, sf):
    """Pages as hits of the engines of five categories; in those of several engines the most preferred one has none."""
    names = F.create_map(*(x for c, own in H.ENGINES.items() for x in (F.lit(c), F.array(*map(F.lit, own)))))
    kinds = F.array(*map(F.lit, sorted(H.ENGINES)))
    pages = table(spark, sf, "pages").select("page_id", F.get(kinds, (F.col("page_id") % 5).cast("int")).alias("category"))
    size = F.size(names[F.col("category")])
    place = size - 1 - (F.floor(F.col("page_id") / 7) % F.greatest(F.lit(1), size - 1)).cast("int")
    return H.engine_counts(pages.select("category", F.get(names[F.col("category")], place).alias("engine")))


@query(f"WITH {HITS} SELECT query_id, seq, printf('%d. **%s** [%s]', engine_rank, title, engine) || chr(10) || '   ' || url || chr(10) || '   ' || replace(snippet, chr(10), ' ') AS line FROM hits")
def hits_report(spark, sf):
    return hits(spark, sf).select("query_id", "seq", H.report_line(F.col("engine_rank")).alias("line"))
