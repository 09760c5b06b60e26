"""Markdown as plain or decorated text.

A text is read as fenced blocks and lines, a line as nested runs, and both are written in a style. What
stands in code is never read as markup; marks that nothing closes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How each part of a text is shown.
PLAIN = {"strong": "{}", "emphasis": "{}", "struck": "{}", "code": "{}", "link": "{} ({})", "heading": "{}", "quote": "{}", "bullet": "{}{} {}", "number": "{}{}. {}", "rule": "", "fence": "{code}"}
DECORATED = {
    "strong": "【{}】", "emphasis": "{}", "struck": "[删除:{}]", "code": "【{}】", "link": "{}({})", "heading": "【{}】", "quote": "> {}", "bullet": "• {2}", "number": "{1}. {2}", "rule": "\n━━━━━━━━━━━━\n",
    "fence": "\n━━━━━━【{language}】━━━━━━\n{stripped}\n━━━━━━━━━━━━━━━━\n", "language": "代码",
}

_FENCE = re.compile(r"```(?P<language>\w*)\n(?P<code>.*?)```", re.S)
_MARK = re.compile(r"[`\[*_~]")
_SPANS = {"**": "strong", "__": "strong", "~~": "struck", "*": "emphasis", "_": "emphasis"}
_LINE = re.compile(r"(?P<heading>#+ )|(?P<quote>> )|(?P<indent>\s*)(?:(?P<bullet>[-*+])|(?P<number>\d+)\.) ")


class _Ahead:
    """The next place of a mark in a line. Questions come from left to right, so each mark is looked for once along the line."""

    def __init__(self, line: str):
        self.line, self.known = line, {}

    def __call__(self, mark: str, at: int) -> int:
        asked, place = self.known.get(mark, (at + 1, -1))
        if not (asked <= at and (place < 0 or at <= place)):
            self.known[mark] = at, (place := self.line.find(mark, at))
        return place


def inline(line: str, style: dict[str, str]) -> str:
    """The runs of one line, from left to right and from the outside in. What lies between marks is taken at once."""
    if not _MARK.search(line):
        return line
    out, at, ahead = [], 0, _Ahead(line)
    while m := _MARK.search(line, at):
        if m.start() > at:
            out.append(line[at : m.start()])
            at = m.start()
        c = line[at]
        if c == "`" and (end := ahead("`", at + 1)) > at + 1:
            out.append(style["code"].format(line[at + 1 : end]))
            at = end + 1
            continue
        if c == "[" and (middle := ahead("](", at + 2)) > 0 and ahead("]", at) >= middle and (end := ahead(")", middle + 3)) > 0:
            out.append(style["link"].format(inline(line[at + 1 : middle], style), line[middle + 2 : end]))
            at = end + 1
            continue
        mark = next((m for m in (line[at : at + 2], c) if m in _SPANS), "")
        if mark and (end := ahead(mark, at + len(mark) + 1)) > 0:  # a span holds a character at least
            out.append(style[_SPANS[mark]].format(inline(line[at + len(mark) : end], style)))
            at = end + len(mark)
            continue
        out.append(mark or c)
        at += len(mark) or 1
    out.append(line[at:])
    return "".join(out)


def _is_rule(line: str) -> bool:
    bare = line.strip()
    return len(bare) >= 3 and not bare.strip("-*_")


def _line(line: str, style: dict[str, str]) -> str:
    if _is_rule(line):
        return style["rule"]
    m = _LINE.match(line)
    if not m:
        return inline(line, style)
    rest = line[m.end() :]
    if not rest:
        return line
    if m["heading"] or m["quote"]:
        return style["heading" if m["heading"] else "quote"].format(inline(rest, style))
    return style["bullet" if m["bullet"] else "number"].format(m["indent"], m["bullet"] or m["number"], inline(rest, style))


def _lines(text: str, style: dict[str, str]) -> str:
    """Lines of a text without fences. Blank lines around a rule go, and in front of an item that is shown with a mark of its own."""
    out, blank = [], 0
    for line in text.split("\n"):
        rule = _is_rule(line)
        m = None if rule else _LINE.match(line)
        item = m is not None and bool(m["bullet"] or m["number"]) and "language" in style
        if (rule or item) and blank:
            del out[-blank:]
        if line.strip() or not out or blank >= 0:
            out.append(_line(line, style))
        blank = -1 if rule else 0 if line.strip() else blank if blank < 0 else blank + 1
    return "\n".join(out)


def render(text: str | None, style: dict[str, str]) -> str | None:
    """The whole text in ``style``, without white space around it."""
    if text is None:
        return None

    def parts() -> Iterator[str]:
        at = 0
        for m in _FENCE.finditer(text):
            yield _lines(text[at : m.start()], style)
            yield style["fence"].format(language=m["language"] or style.get("language", ""), code=m["code"], stripped=m["code"].strip())
            at = m.end()
        yield _lines(text[at:], style)

    shown = "".join(parts())
    return (re.sub("\n\n\n+", "\n\n", shown) if "language" in style else shown).strip()


def _column(c: Column, style: dict[str, str]) -> Column:
    @F.pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: render(t, style))

    return write(c)


def markdown_plain(c: Column) -> Column:
    """Markdown as plain text; items of lists keep their marks, links show their address in brackets."""
    return _column(c, PLAIN)


def markdown_decorated(c: Column) -> Column:
    """Markdown as plain text with brackets, bullets and rules."""
    return _column(c, DECORATED)


def code_blocks(c: Column) -> Column:
    """array of (language, code) of fenced blocks: ``text`` where none is named, the code without white space around it."""
    found = lambda group: F.regexp_extract_all(c, F.lit(r"(?s)```(\w*)\n(.*?)```"), F.lit(group))
    pair = lambda language, code: F.struct(F.coalesce(F.nullif(language, F.lit("")), F.lit("text")).alias("language"), F.regexp_replace(code, r"^\s+|\s+$", "").alias("code"))
    return F.zip_with(found(1), found(2), pair)


def inline_code(c: Column) -> Column:
    """array of what stands between single backticks, outside fenced blocks."""
    return F.regexp_extract_all(F.regexp_replace(c, r"(?s)```\w*\n.*?```", ""), F.lit("`([^`]+)`"), F.lit(1))
