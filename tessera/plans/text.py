"""Queries over text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..functions import tokens as K
from .base import query, table


@query("SELECT doc_id, md5(c) AS digest, length(c) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM documents)")
def clean_text(spark, sf):
    c = T.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', ''), '^www\\.', '')) AS url FROM pages")
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')"
NORMAL_TITLE = f"trim(regexp_replace(regexp_replace(lower({TITLE}), '\\s+', ' ', 'g'), '\\s*[-|]\\s*(wikipedia|百度百科|github|arxiv).*$', ''))"


@query(f"SELECT page_id, {TITLE} AS title, {NORMAL_TITLE} AS normal FROM pages")
def normalize_title(spark, sf):
    title = T.html_title(F.col("html"))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), T.normalize_title(title).alias("normal"))


VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5(t) AS digest, length(t) AS n, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS head FROM (SELECT page_id, {VISIBLE} AS t FROM pages)")
def html_to_text(spark, sf):
    t = T.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"), T.truncate(t, 500).alias("head"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''')) AS digest FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean_html(F.col("html"))).alias("digest"))


@query("""SELECT doc_id, CAST(floor(length(text) / 2) AS INT) AS halves, length(text) * 1.5e0 AS generous,
CAST(floor((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) * 1.5e0 + length(regexp_replace(text, '[一-鿿]', '', 'g')) * 0.5e0) AS INT) AS by_script,
round(length(text) * 0.6e0, 6) AS document FROM documents""")
def token_estimates(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", K.halves(t).alias("halves"), K.generous(t).alias("generous"), K.by_script(t).alias("by_script"), F.round(K.document_estimate(t), 6).alias("document"))


@query("""SELECT doc_id, CASE WHEN c <= 8192 THEN 2000 WHEN c <= 32768 THEN 4000 WHEN c <= 131072 THEN 6000 ELSE 8000 END AS size,
CASE WHEN c <= 8192 THEN 200 WHEN c <= 32768 THEN 400 WHEN c <= 131072 THEN 600 ELSE 800 END AS overlap,
CASE WHEN c <= 8192 THEN 1000 WHEN c <= 32768 THEN 2000 ELSE 4000 END AS entities,
CASE WHEN c >= 262144 THEN 262144 WHEN c >= 131072 THEN 131072 WHEN c >= 65536 THEN 65536 WHEN c >= 32768 THEN 32768 WHEN c >= 16384 THEN 16384 ELSE 8192 END AS aligned,
CAST(greatest(2000, least(floor(c * 0.9e0), 50000)) AS INT) AS cut
FROM (SELECT doc_id, n_chars * 40 AS c FROM documents)""")
def chunk_size_config(spark, sf):
    c = F.col("n_chars") * 40
    conf = K.chunk_config(c)
    return table(spark, sf, "documents").select("doc_id", conf["size"].alias("size"), conf["overlap"].alias("overlap"), K.fusion_budget(c)["entities"].alias("entities"), K.align_context(c).alias("aligned"), K.truncation_limit(c).alias("cut"))


@query("SELECT doc_id, length(text) < 2000 AS plain, length(text) * 0.6e0 < 2457 AS at_8k, CAST(floor(floor(n_chars * 0.3e0) / 0.6e0) AS INT) AS threshold FROM documents")
def full_text_decision(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", K.use_full_text(n).alias("plain"), K.use_full_text(n.cast("double"), 8192).alias("at_8k"), K.full_text_threshold(F.col("n_chars")).alias("threshold"))


@query("SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '', 'g') AS normal, len(regexp_extract_all(text, '([\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}_]+)', 1)) AS n_tokens FROM benchmark")
def match_normal_form(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", T.normalize_for_match(t).alias("normal"), F.size(T.tokenize(t)).cast("long").alias("n_tokens"))


@query("SELECT doc_id, left(md5(text), 16) AS doc_key, left(md5(source || ':' || lang), 12) AS pair_key, regexp_replace(source || '-' || lang, '[^\\p{L}\\p{N}]', '_', 'g') AS name, CASE WHEN n_chars < 1024 THEN printf('%dB', n_chars) ELSE printf('%.1fKB', n_chars / 1024) END AS size FROM documents")
def ids_and_names(spark, sf):
    size = T.byte_size(F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", T.short_id(F.col("text")).alias("doc_key"), T.short_id(F.col("source"), F.col("lang"), length=12).alias("pair_key"), T.safe_name(F.concat_ws("-", "source", "lang")).alias("name"), size.alias("size"))


@query("SELECT conv_id, turn, replace(CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END, chr(10), ' ') AS line, lower(regexp_extract(text, '(?s)^(\\S+)\\s*(.*)$', 1)) AS name, length(regexp_extract(text, '(?s)^(\\S+)\\s*(.*)$', 2)) AS n_args FROM conversations")
def message_previews(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.preview(t).alias("line"), T.command(t)["name"].alias("name"), F.length(T.command(t)["args"]).cast("long").alias("n_args"))


#: Every sentence but the last is followed by a marked line; the text itself is cleared of marks first.
BARE = "regexp_replace(text, '[^\\p{L}\\p{N} .,;!?\\n]', '', 'g')"


def _marked(line: str) -> str:
    return f"replace({BARE}, '. ', '.' || chr(10) || '{line}')"


def _markdown(head: str) -> str:
    trimmed = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    plain = trimmed.format(f"'{head} title' || chr(10) || " + _marked("x and y z a b c link (http://a) "))
    shown = f"'【{head} title】' || chr(10) || " + _marked("> 【x】 and 【y】 [删除:z a] 【b c】 link(http://a) ")
    return plain, trimmed.format(f"regexp_replace({shown}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PLAIN, _SHOWN = _markdown("a")


def _markdown_text():
    bare = F.regexp_replace("text", r"[^\p{L}\p{N} .,;!?\n]", "")
    return F.concat(F.lit("# a title\n"), F.replace(bare, F.lit(". "), F.lit(".\n> **x** and `y` ~~z *a*~~ __b *c*__ [link](http://a) ")))


@query(f"SELECT doc_id, md5({_PLAIN}) AS plain FROM documents")
def markdown_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(M.markdown_plain(_markdown_text())).alias("plain"))


@query(f"SELECT doc_id, md5({_SHOWN}) AS shown FROM documents")
def markdown_decorated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(M.markdown_decorated(_markdown_text())).alias("shown"))


@query("""SELECT doc_id, 'py' AS language, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS code, 1 AS ord FROM documents WHERE NOT contains(text, '`')
UNION ALL SELECT doc_id, 'text', md5(CAST(doc_id AS VARCHAR)), 2 FROM documents WHERE NOT contains(text, '`')""")
def fenced_code(spark, sf):
    """Texts without backticks in a named fence, and their ids in a second one without name."""
    docs = table(spark, sf, "documents").where(~F.contains("text", F.lit("`")))
    marked = F.concat(F.lit("see\n```py\n"), "text", F.lit("\n```\nand\n```\n "), F.col("doc_id").cast("string"), F.lit("\n```"))
    rows = docs.select("doc_id", F.posexplode(M.code_blocks(marked)).alias("ord", "b"))
    return rows.select("doc_id", F.col("b.language").alias("language"), F.md5("b.code").alias("code"), (F.col("ord") + 1).alias("ord"))


@query("""SELECT doc_id, 'id: ' || doc_id || chr(10) AS head, CAST(doc_id AS VARCHAR) AS id, lang AS kind, 0.25e0 AS importance, md5(trim(text, ' ' || chr(10))) AS body FROM documents""")
def frontmatter_parse(spark, sf):
    raw = F.concat(F.lit("---\nid: "), F.col("doc_id"), F.lit("\ntype: "), F.col("lang"), F.lit("\nimportance: 0.25\n---\n\n"), "text")
    m = T.front_matter(raw)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("id: "), m["fields"]["id"], F.lit("\n")).alias("head"), m["fields"]["id"].alias("id"), m["fields"]["type"].alias("kind"), m["fields"]["importance"].cast("double").alias("importance"), F.md5(m["body"]).alias("body"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, event_type AS name, round(0.5e0 + (event_id % 5) / 10e0, 6) AS confidence FROM events WHERE event_id % 3 < 2")
def llm_json_parse(spark, sf):
    payload = F.format_string('{"entities": [{"name": "%s", "confidence": %.1f}]}', F.col("event_type"), F.lit(0.5) + F.col("event_id") % 5 / 10)
    kind = F.col("event_id") % 3
    reply = F.when(kind == 0, payload).when(kind == 1, F.concat(F.lit("Sure, here:\n"), payload, F.lit("\nDone."))).otherwise("no json at all")
    rows = table(spark, sf, "events").select("event_id", T.llm_json(reply).alias("v")).where("v IS NOT NULL")
    return rows.select("event_id", F.variant_get("v", "$.entities[0].name", "string").alias("name"), F.round(F.variant_get("v", "$.entities[0].confidence", "double"), 6).alias("confidence"))
