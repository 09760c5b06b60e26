"""Result pages of services without an interface of their own, as hits: DuckDuckGo's HTML pages and Baidu Baike's entries.

A page is read once, tag by tag. The stack of open elements holds what is being collected: each element
that may be a result keeps the first link and the first snippet inside it, whatever it contains besides,
and text goes to all open ones that collect. All kinds of results are collected in that one pass; which
kind counts is decided at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, truncate

#: What a result is, as (tag, class), in the order in which kinds are tried, and the classes of title and snippet in the first of them.
KINDS = (("div", "result"), ("div", "web-result"), ("div", "result__body"), ("article", None))
TITLE, SNIPPET = "result__a", "result__snippet"
#: Elements that have no end tag, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template".split())
HIT = "array<struct<place:int,title:string,url:string,snippet:string>>"


class _Result:
    def __init__(self, kind: int):
        self.kind, self.title, self.url, self.snippet = kind, None, None, None


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[_Result], list[str] | None]] = []
        self.results: tuple[list[_Result], ...] = tuple([] for _ in KINDS)
        self.open: list[_Result] = []
        self.texts: list[list[str]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        own = dict(reversed(attrs))  # of an attribute given twice the first counts
        classes = (own.get("class") or "").split()
        text: list[str] | None = None
        for r in self.open:
            first = r.kind == 0
            if r.title is None and tag == "a" and (not first or TITLE in classes):
                text = text if text is not None else []
                r.title, r.url = text, own.get("href") or ""
            if r.snippet is None and (tag == "a" and SNIPPET in classes if first else tag in ("p", "span", "div") and any("snippet" in c.lower() for c in classes)):
                text = text if text is not None else []
                r.snippet = text
        if tag in VOID:
            return
        kinds = [k for k, (name, cls) in enumerate(KINDS) if tag == name and (cls is None or cls in classes)]
        begun = [_Result(k) for k in kinds]
        for r in begun:
            self.results[r.kind].append(r)
        self.open += begun
        if text is not None:
            self.texts.append(text)
        self.hidden += tag in HIDDEN
        self.stack.append((tag, begun, text))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(name == tag for name, _, _ in self.stack):
            return
        while self.stack:
            name, begun, text = self.stack.pop()
            if begun:
                del self.open[-len(begun) :]
            if text is not None:
                self.texts.pop()
            self.hidden -= name in HIDDEN
            if name == tag:
                break

    def handle_data(self, data):
        if self.texts and not self.hidden and (shown := data.strip()):
            for text in self.texts:
                text.append(shown)


def page_hits(html: str, most: int = 10) -> list[dict]:
    """The hits of one result page: of each kind the first ``most`` elements, those without a link left out; the first kind that has hits."""
    page = _Page()
    page.feed(html)
    page.close()
    for found in page.results:
        hits = [{"place": i, "title": "".join(r.title), "url": r.url, "snippet": "".join(r.snippet or ())} for i, r in enumerate(found[:most]) if r.title is not None]
        if hits:
            return hits
    return []


def duckduckgo(html: Column, most: int = 10) -> Column:
    """The hits (place, title, url, snippet) of a result page."""

    @F.pandas_udf(HIT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: page_hits(p or "", most))

    return read(html)


def duckduckgo_hits(replies: DataFrame, html: str = "html", key: str = "query_id", most: int = 10, engine: str = "duckduckgo") -> DataFrame:
    """(key, engine, engine_rank, title, url, snippet, score) of result pages; the score falls by a tenth a place on the page."""
    rows = replies.select(key, F.inline(duckduckgo(F.col(html), most)))
    return rows.select(key, F.lit(engine).alias("engine"), (F.col("place") + 1).alias("engine_rank"), "title", "url", "snippet", F.round(1 - F.lit(0.1) * F.col("place"), 6).alias("score"))


def baike_summary(html: Column) -> Column:
    """The description of an entry, without the name of the encyclopedia; '' if it has none."""
    return strip(F.replace(F.regexp_extract(html, '<meta name="description" content="(.*?)"', 1), F.lit("百度百科"), F.lit("")))


def baike_hits(pages: DataFrame, html: str = "html", url: str = "url", key: str = "query_id") -> DataFrame:
    """(key, engine, title, url, snippet) of the pages that are entries; an entry without description names its title instead."""
    title = F.regexp_extract(html, "<title>(.*?)_百度百科</title>", 1)
    described = F.col(html).rlike('<meta name="description" content=".*?"')
    snippet = F.when(described, baike_summary(F.col(html))).otherwise(F.concat(F.lit("词条: "), strip(title)))
    entries = pages.where(F.col(html).rlike("<title>.*?_百度百科</title>"))
    return entries.select(key, F.lit("baidu_baike").alias("engine"), strip(title).alias("title"), url, truncate(snippet, 300).alias("snippet"))
