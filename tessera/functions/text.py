"""Text expressions: cleaning, normal forms, mark-up removal, parsing. Column in, Column out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space (all of Unicode's) at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """Runs of blanks and tabs to one blank, all line ends to ``\\n``, at most one empty line, ends stripped."""
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def normalize_url(c: Column) -> Column:
    """Scheme (in lower case only), trailing slashes and a leading ``www.`` go; then lower case. Query and fragment stay."""
    c = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/+$", "")
    return F.lower(F.regexp_replace(c, r"^www\.", ""))


def normalize_title(c: Column) -> Column:
    """Lower case, single blanks, without the name of a well-known site at the end."""
    c = F.regexp_replace(F.lower(c), r"\s+", " ")
    return strip(F.regexp_replace(c, r"\s*[-|]\s*(wikipedia|百度百科|github|arxiv).*$", ""))


def normalize_for_match(c: Column) -> Column:
    """Lower case, letters, digits and underscores alone."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def tokenize(c: Column) -> Column:
    """CJK characters one by one, else runs of word characters."""
    return F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}]|[\p{L}\p{N}_]+)"), F.lit(1))


def normalize_filename(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\"'“”‘’《》()（）\[\]【】_-]", ""))


#: Phrases that say nothing about a remembered fact.
FACT_PREFIXES = ("用户", "姓名", "名字", "是", "：", ":", " ")


def normalize_fact(c: Column, prefixes: tuple[str, ...] = FACT_PREFIXES) -> Column:
    for p in prefixes:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def html_title(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text(c: Column, max_chars: int | None = None) -> Column:
    """Visible text of a page: without scripts, styles and tags, single blanks; entities stay as they are."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    c = strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return c if max_chars is None else truncate(c, max_chars)


def clean_html(c: Column) -> Column:
    """Without tags; five entities decoded one after the other, so ``&amp;lt;`` ends as ``<``."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters and ``mark``, if there are more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def preview(c: Column, n: int = 100) -> Column:
    """A one-line preview."""
    return F.replace(truncate(c, n), F.lit("\n"), F.lit(" "))


def join_authors(names: Column, most: int = 3, more: str = " et al.") -> Column:
    return F.concat(F.concat_ws(", ", F.slice(names, 1, most)), F.when(F.size(names) > most, more).otherwise(""))


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` of an ISO timestamp, NULL if it is none."""
    return F.date_format(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day)


def short_id(*parts: Column, length: int = 16) -> Column:
    """The front of the md5 of the parts joined by colons."""
    return F.left(F.md5(F.concat_ws(":", *parts)), F.lit(length))


def safe_name(c: Column) -> Column:
    """Letters and digits stay, all else becomes ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def byte_size(c: Column) -> Column:
    """``512B``, ``1.5KB``, ``2.0MB``."""
    kb, mb = c / 1024, c / (1024 * 1024)
    return F.when(c < 1024, F.format_string("%dB", c.cast("long"))).when(c < 1024 * 1024, F.format_string("%.1fKB", F.bround(kb, 1))).otherwise(F.format_string("%.1fMB", F.bround(mb, 1)))


def command(c: Column) -> Column:
    """(name, args) of a line: the first word in lower case, and the rest."""
    pattern = r"(?s)^(\S+)\s*(.*)$"
    return F.struct(F.lower(F.regexp_extract(c, pattern, 1)).alias("name"), F.regexp_extract(c, pattern, 2).alias("args"))


def tool_reference(c: Column) -> Column:
    """(server, tool) of ``mcp://server/tool``, or NULL."""
    pattern = "^mcp://([^/]+)/(.+)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("server"), F.regexp_extract(c, pattern, 2).alias("tool")))


def front_matter(c: Column) -> Column:
    """(fields, body) of a text with a ``key: value`` head between ``---`` lines; without one, no fields and the whole text."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    lines = F.filter(F.split(F.regexp_extract(c, pattern, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    fields = F.map_from_entries(F.transform(lines, pair))
    has = c.rlike(pattern)
    return F.struct(F.when(has, fields).alias("fields"), strip(F.when(has, F.regexp_extract(c, pattern, 2)).otherwise(c)).alias("body"))


def jsonp(c: Column) -> Column:
    """The JSON text inside a callback's parentheses."""
    return F.regexp_extract(c, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)


def llm_json(c: Column) -> Column:
    """A model's reply as a variant: the whole text, else what stands from the first ``{`` to the last ``}``, else NULL."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def highlight(text: Column, start: Column, end: Column, around: int = 30) -> Column:
    """``before[[found]]after`` for 0-based ``start`` and ``end``."""
    low = F.greatest(start - around, F.lit(0))
    return F.concat(F.substring(text, low + 1, start - low), F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"), F.substring(text, end + 1, F.lit(around)))


def any_of(c: Column, words) -> Column:
    """Whether the text holds any of the words, whatever the case."""
    low = F.lower(c)
    return F.array_contains(F.array(*(F.contains(low, F.lit(w.lower())) for w in words)), True)


def meta_description(c: Column) -> Column:
    """The description in a page's head, '' without one."""
    return F.regexp_extract(c, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1)


def day_labels(at: Column) -> Column:
    """The days that a message sent ``at`` may speak of, as dates, and its weekday."""
    day = F.to_date(at)
    dates = (F.date_format(F.date_add(day, n), "yyyy-MM-dd").alias(k) for k, n in (("yesterday", -1), ("today", 0), ("tomorrow", 1), ("day_after", 2)))
    return F.struct(*dates, F.date_format(day, "EEEE").alias("weekday"))


def scoped_query(query: Column, category: Column | None = None, language: Column | None = None) -> Column:
    """A query limited to a category of a paper index, and to a programming language."""
    if category is not None:
        query = F.concat(F.lit("cat:"), category, F.lit(" AND all:"), query)
    return query if language is None else F.concat(query, F.lit(" language:"), language)


def thread_id(channel: Column, user: Column, session: Column) -> Column:
    return F.concat_ws("_", channel, user, session)


def json_text(c: Column) -> Column:
    """All text of a nested JSON message in order, where a ``text`` field stands for its object; no JSON: the text itself."""

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        import json

        def inner(x) -> str:
            if isinstance(x, dict):
                x = [x["text"]] if "text" in x else list(x.values())
            return "".join(map(inner, x)) if isinstance(x, list) else x if isinstance(x, str) else ""

        def one(v):
            try:
                return None if v is None else inner(json.loads(v))
            except (ValueError, RecursionError):
                return v

        return values.map(one)

    return texts(c)
