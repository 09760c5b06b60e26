"""Replies of search services as hits: one projection a service, from the reply's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, iso_date, join_authors, jsonp, partial_date, strip, truncate

HIT = "title string, url string, snippet string, author string, published_date string"


def _json(kind: str, at: str, **fields: str):
    """A reader of JSON replies: the list ``at``, and for each column an expression over its element ``x``."""

    def read(payload: Column) -> Column:
        items = F.from_json(payload, kind)
        for name in at.split("."):
            items = items[name]
        cols = [F.expr("CAST(NULL AS STRING)").alias(c) if c not in fields else None for c in ("title", "url", "snippet", "author", "published_date")]
        return F.transform(items, lambda x: F.struct(*((cols[i] if cols[i] is not None else x[fields[c]].cast("string").alias(c)) for i, c in enumerate(("title", "url", "snippet", "author", "published_date")))))

    return read


def _list(fields: str) -> str:
    return f"array<struct<{fields}>>"


READERS = {
    "serper": _json(f"organic {_list('title:string,link:string,snippet:string,date:string')}", "organic", title="title", url="link", snippet="snippet", published_date="date"),
    "brave": _json(f"web struct<results:{_list('title:string,url:string,description:string,age:string')}>", "web.results", title="title", url="url", snippet="description", published_date="age"),
    "bing": _json(f"webPages struct<value:{_list('name:string,url:string,snippet:string,dateLastCrawled:string')}>", "webPages.value", title="name", url="url", snippet="snippet", published_date="dateLastCrawled"),
    "tavily": _json(f"results {_list('title:string,url:string,content:string,published_date:string')}", "results", title="title", url="url", snippet="content", published_date="published_date"),
    "searxng": _json(f"results {_list('title:string,url:string,content:string,publishedDate:string')}", "results", title="title", url="url", snippet="content", published_date="publishedDate"),
    "github": _json(f"items {_list('full_name:string,html_url:string,description:string,updated_at:string')}", "items", title="full_name", url="html_url", snippet="description", published_date="updated_at"),
    "gitee": _json(f"items {_list('full_name:string,html_url:string,description:string,updated_at:string')}", "items", title="full_name", url="html_url", snippet="description", published_date="updated_at"),
    "wikipedia": _json(f"query struct<search:{_list('title:string,pageid:string,snippet:string,timestamp:string')}>", "query.search", title="title", url="pageid", snippet="snippet", published_date="timestamp"),
}


def arxiv(payload: Column) -> Column:
    """Atom entries as hits."""
    kind = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"
    entries = F.from_xml(payload, kind)["entry"]
    tidy = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    return F.transform(entries, lambda x: F.struct(tidy(x["title"]).alias("title"), x["id"].alias("url"), truncate(tidy(x["summary"]), 500).alias("snippet"), join_authors(F.transform(x["author"], lambda a: a["name"])).alias("author"), iso_date(x["published"]).alias("published_date")))


def pubmed(payload: Column) -> Column:
    """Article sets as hits."""
    date = "PubDate:struct<Year:string,Month:string,Day:string>"
    article = f"ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,Journal:struct<JournalIssue:struct<{date}>>"
    kind = f"PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<{article}>>>>"
    items = F.from_xml(payload, kind)["PubmedArticle"]

    def one(x):
        c, a = x["MedlineCitation"], x["MedlineCitation"]["Article"]
        d = a["Journal"]["JournalIssue"]["PubDate"]
        names = F.transform(a["AuthorList"]["Author"], lambda n: F.concat_ws(" ", n["ForeName"], n["LastName"]))
        return F.struct(a["ArticleTitle"].alias("title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), c["PMID"], F.lit("/")).alias("url"), truncate(F.array_join(a["Abstract"]["AbstractText"], " "), 500).alias("snippet"), join_authors(names, 5, "et al.").alias("author"), partial_date(d["Year"], d["Month"], d["Day"]).alias("published_date"))

    return F.transform(items, one)


def suggestions(payload: Column) -> Column:
    """The suggestions in a JSONP reply."""
    return F.from_json(jsonp(payload), "s array<string>")["s"]


def hits(replies: DataFrame, engine: str, payload: str = "payload", key: str = "query_id", most: int | None = None) -> DataFrame:
    """(key, engine, engine_rank, title, url, snippet, author, published_date, score) of replies of one service; the score falls by a tenth a place."""
    reader = {"arxiv": arxiv, "pubmed": pubmed}.get(engine) or READERS[engine]
    rows = replies.select(key, F.posexplode(reader(F.col(payload))).alias("i", "hit")).select(key, "i", "hit.*")
    if most:
        rows = rows.where(F.col("i") < most)
    snippet = truncate(clean_html(F.coalesce("snippet", F.lit(""))), 500)
    return rows.select(key, F.lit(engine).alias("engine"), (F.col("i") + 1).alias("engine_rank"), F.coalesce("title", F.lit("无标题")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), snippet.alias("snippet"), "author", "published_date", F.round(1 - F.lit(0.1) * F.col("i"), 6).alias("score"))


def answer_first(found: DataFrame, answers: DataFrame, key: str = "query_id", score: float = 2.0) -> DataFrame:
    """Direct answers (key, title, url, snippet) in front of the hits, at rank 0."""
    top = answers.where("snippet <> ''").withColumns({"engine_rank": F.lit(0), "score": F.lit(score)})
    return found.unionByName(top, allowMissingColumns=True)
