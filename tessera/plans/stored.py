"""Queries through sources and files: what is written is read back, and pages are read as replies of search services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, packed, result_pages, store_files
from .base import folder, query, table
from .extraction import DICT
from .extraction import dictionary as words

NAMED = f"{DICT}, n AS (SELECT 'words ' || left(term, 1) AS dict_name, CASE WHEN left(term, 1) < 'n' THEN 'front' END AS domain, type, term FROM d)"


def named_dictionaries(spark, sf):
    """The words of the documents as several dictionaries, by first letter."""
    front = F.left("term", F.lit(1))
    return words(spark, sf).select(F.concat(F.lit("words "), front).alias("dict_name"), F.when(front < "n", F.lit("front")).alias("domain"), "type", "term")


def _files(rows, label: str):
    path = folder(rows.sparkSession, label)
    files.write_dictionary(rows, path)
    return files.read_dictionaries(rows.sparkSession, path)


@query(f"WITH {NAMED} SELECT dict_name, domain, type, term FROM n")
def dictionary_files(spark, sf):
    return _files(named_dictionaries(spark, sf), "dictionaries")


HALVES = f"{NAMED}, b AS (SELECT dict_name, domain, type, term FROM n WHERE length(term) % 2 = 0), m AS (SELECT CASE WHEN left(term, 1) < 'c' THEN dict_name ELSE 'other' END AS dict_name, domain, 'new' AS type, term FROM n WHERE length(term) % 3 = 0)"


def _halves(spark, sf):
    rows = named_dictionaries(spark, sf)
    kept = F.when(F.left("term", F.lit(1)) < "c", F.col("dict_name")).otherwise("other")
    more = rows.where(F.length("term") % 3 == 0).select(kept.alias("dict_name"), "domain", F.lit("new").alias("type"), "term")
    return rows.where(F.length("term") % 2 == 0), more


@query(f"WITH {HALVES} SELECT dict_name, type, term FROM b UNION SELECT dict_name, type, term FROM m")
def dictionary_merged_in(spark, sf):
    rows, more = _halves(spark, sf)
    return _files(files.import_terms(rows, more), "dictionaries").select("dict_name", "type", "term")


@query(f"WITH {HALVES} SELECT dict_name, type, term FROM b WHERE dict_name NOT IN (SELECT dict_name FROM m) UNION SELECT dict_name, type, term FROM m")
def dictionary_replaced(spark, sf):
    rows, more = _halves(spark, sf)
    return _files(files.import_terms(rows, more, merge=False), "dictionaries").select("dict_name", "type", "term")


LINK = """'<li><a href="([^"]*)">([^<]*)</a></li>'"""


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, {LINK}, 1) AS urls, regexp_extract_all(html, {LINK}, 2) AS titles FROM pages),
e AS (SELECT page_id, i, urls[i + 1] AS url, titles[i + 1] AS title FROM (SELECT *, unnest(range(0, least(10, len(urls)))) AS i FROM l))
SELECT page_id, CAST(i + 1 AS INT) AS engine_rank, replace(title, '&amp;', '&') AS title, url, CASE WHEN page_id % 3 < 2 THEN 'near ' || replace(title, '&amp;', '&') ELSE '' END AS snippet, round(1 - 0.1e0 * i, 6) AS score FROM e""")
def result_page_hits(spark, sf):
    """Pages whose lists of links are turned into results of three kinds, as such pages have them."""
    kind = F.col("page_id") % 3
    turned = lambda new: F.regexp_replace("html", r'<li><a href="([^"]*)">([^<]*)</a></li>', new)
    html = F.when(kind == 0, turned('<div class="x result"><h2><a class="result__a" href="$1">$2</a></h2><a class="result__snippet"><b>near</b> $2</a></div>'))
    html = html.when(kind == 1, turned('<div class="result__body"><a href="$1">$2</a><span class="Snippet-text">near $2</span></div>')).otherwise(turned('<article><a href="$1"> $2 </a></article>'))
    pages = table(spark, sf, "pages").select("page_id", html.alias("html"))
    rows = result_pages.duckduckgo_hits(pages, key="page_id")
    return rows.select("page_id", "engine_rank", "title", "url", F.regexp_replace("snippet", "^near(?! )", "near ").alias("snippet"), "score")


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"""SELECT page_id AS query_id, 'baidu_baike' AS engine, trim({TITLE}) AS title, url, CASE WHEN page_id % 2 = 1 THEN '词条: ' || trim({TITLE}) WHEN length(a) > 300 THEN left(a, 300) || '...' ELSE a END AS snippet
FROM (SELECT *, trim(repeat({TITLE} || ' ', 8)) AS a FROM pages) WHERE page_id % 5 > 0""")
def baike_entries(spark, sf):
    """Pages as entries: some without a description, some no entries at all."""
    kind = F.col("page_id")
    described = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    meta = F.when(kind % 2 == 0, F.concat(F.lit('<meta name="description" content="百度百科'), F.repeat(F.concat(described, F.lit(" ")), F.lit(8)), F.lit('">'))).otherwise("")
    html = F.when(kind % 5 > 0, F.concat(F.replace("html", F.lit("</title>"), F.lit("_百度百科</title>")), meta)).otherwise(F.col("html"))
    return result_pages.baike_hits(table(spark, sf, "pages").select(F.col("page_id").alias("query_id"), "url", html.alias("html")))


CUT = "CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END"


@query(f"SELECT conv_id, turn, CAST(o AS INT) AS ord, CASE o WHEN 0 THEN 'human' ELSE role END AS role, CASE o WHEN 0 THEN 'always there' ELSE {CUT} END AS content FROM (SELECT *, unnest([0, 1]) AS o FROM conversations WHERE (conv_id + turn) % 5 < 3) WHERE o = 0 OR length(text) > 5")
def packed_checkpoints(spark, sf):
    """Turns in packed checkpoints of three shapes; some are cut off, some hold nothing."""
    text, role = packed.pack_text(F.col("text")), packed.pack_text(F.col("role"))
    first = packed.pack_map(("type", packed.pack_text(F.lit("human"))), ("content", packed.pack_text(F.lit("always there"))))
    held = packed.pack_map(("messages", packed.pack_array(first, packed.pack_map(("role", role), ("content", text)))))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    blob = F.when(kind == 0, held).when(kind == 1, packed.pack_map(("v", F.unhex(F.lit("01"))), ("channel_values", held))).when(kind == 2, packed.pack_map(("state", held)))
    blob = blob.when(kind == 3, F.substring(held, F.lit(1), F.octet_length(held) - 1)).otherwise(packed.pack_map(("id", F.unhex(F.lit("C0")))))
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.struct("conv_id", "turn").alias("key"), blob.alias("blob"))
    return packed.checkpoint_blobs(rows, "key", "blob").select("key.conv_id", "key.turn", "ord", "role", "content")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) AS total FROM embeddings")
def vector_files(spark, sf):
    """The vectors written as the store's JSON and read in parts."""
    path = folder(spark, "vectors")
    line = F.concat(F.lit('{"'), F.col("vec_id").cast("string"), F.lit('": ['), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]}"))
    table(spark, sf, "embeddings").select(line.alias("value")).write.text(path)
    rows = store_files.read_vectors(spark, path)
    return rows.select("id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
