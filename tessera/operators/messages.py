"""Messages: cut for channels with a length limit, limited to allowed tools, given context, restored from checkpoints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from .chunking import windows


def split_lines(text: Column, size: int = 2000) -> Column:
    """Lines packed into parts of up to ``size`` characters; longer lines are cut hard."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    one = lambda c: F.array(c).cast("array<string>")
    close = lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], one(acc["open"]))).otherwise(acc["done"])

    def step(acc, line):
        long = F.length(line) > size
        full = F.length(acc["open"]) + F.length(line) + 1 > size
        joined = F.when(acc["open"] != "", F.concat(acc["open"], F.lit("\n"), line)).otherwise(line)
        return F.struct(
            F.when(long, F.concat(close(acc), windows(line, size, 0))).when(full, F.concat(acc["done"], one(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(long, F.lit("")).when(full, line).otherwise(joined).alias("open"),
        )

    packed = F.aggregate(F.split(text, "\n"), start, step, close)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def split_natural(text: Column, size: int) -> Column:
    """Parts cut at the last line end before the limit, else after the last full stop, else hard.

    A cut at the very front takes nothing off, so such a place is passed over.
    """

    def cut(s: str | None) -> list[str]:
        parts, s = [], s or ""
        while len(s) > size:
            at = next((p for p in (s.rfind(mark, 0, size) for mark in ("\n", "。", ". ")) if p > 0), size)
            parts.append(s[:at])
            s = s[at:].strip()
        return [*parts, s] if s else parts

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return split(text)


#: Marks of Markdown, the style each stands for, and what is shown of it.
_MARKS = re.compile(
    r"(?ms)```\w*\n(?P<block>.*?)```|`(?P<code>[^`]+)`|\*\*(?P<bold>.+?)\*\*|__(?P<bold2>.+?)__|~~(?P<strikethrough>.+?)~~|\*(?P<italic>[^*\n]+)\*|_(?P<italic2>[^_\n]+)_"
    r"|\[(?P<underline>[^\]]+)\]\([^)]+\)|^#{1,6} (?P<heading>[^\n]+)\n?|^> (?P<quote>[^\n]+)\n?|^\s*[-*_]{3,}\s*$(?P<rule>)"
)
_STYLE = {"code": "bold", "bold": "bold", "bold2": "bold", "italic": "italic", "italic2": "italic", "heading": "bold", "strikethrough": "strikethrough", "underline": "underline"}
_SHOWN = {"block": "```\n{}\n```\n", "heading": "{}\n", "quote": "> {}\n", "rule": "\n─────────\n"}


def _segments(text: str | None) -> list[dict]:
    """Runs of one style, from left to right; marks that are not closed stay as they are."""
    runs: list[dict] = []

    def add(t: str, style: str) -> None:
        if t and runs and runs[-1]["style"] == style:
            runs[-1]["text"] += t
        elif t:
            runs.append({"text": t, "style": style})

    at, text = 0, text or ""
    for m in _MARKS.finditer(text):
        add(text[at : m.start()], "")
        add(_SHOWN.get(m.lastgroup, "{}").format(m.group(m.lastgroup).rstrip("\n")), _STYLE.get(m.lastgroup, ""))
        at = m.end()
    add(text[at:], "")
    return runs


def rich_segments(text: Column) -> Column:
    """Markdown as array of (text, style), neighbours of equal style joined."""

    @F.pandas_udf("array<struct<text:string,style:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(_segments)

    return split(text)


#: What stands for missing tools, cut results, and the request at the end.
NO_TOOL, CUT, NEEDS, ANSWER_NOW = "（无可用工具）", "\n... (内容已截断)", "我需要调用工具来获取信息：", "请基于上述工具执行结果，直接回答用户的问题。"


def allowed_calls(text: Column, calls: Column, allowed: list[str]) -> Column:
    """(text, calls): the calls (structs with a name) of allowed tools; a message left with neither call nor text says so."""
    kept = F.filter(calls, lambda c: c["name"].isin(*allowed))
    bare = (F.size(calls) > 0) & (F.size(kept) == 0) & (F.coalesce(text, F.lit("")) == "")
    return F.struct(F.when(bare, NO_TOOL).otherwise(text).alias("text"), kept.alias("calls"))


def by_mime(attachments: Column) -> Column:
    """(images, files): attachments (structs with a content_type) by kind; without a type they are files."""
    image = lambda a: F.startswith(F.coalesce(a["content_type"], F.lit("")), F.lit("image/"))
    return F.struct(F.filter(attachments, image).alias("images"), F.filter(attachments, lambda a: ~image(a)).alias("files"))


def insert_context(messages: DataFrame, contexts: DataFrame, thread: str, seq: str, role: str, text: str, human: str = "user") -> DataFrame:
    """Messages with a system message of the thread's context (thread, context) half a step before its first human message; ``seq`` becomes a double."""
    first = messages.where(F.col(role) == human).groupBy(thread).agg((F.min(seq) - 0.5).alias(seq))
    added = first.join(contexts.where(F.coalesce("context", F.lit("")) != ""), thread).select(thread, seq, F.lit("system").alias(role), F.col("context").alias(text))
    return messages.select(thread, F.col(seq).cast("double").alias(seq), role, text).unionByName(added)


def answer_thread(messages: DataFrame, thread: str, seq: str, role: str, text: str, calls: str, human: str = "user", tool: str = "tool", most: int = 2000) -> DataFrame:
    """(thread, part, seq, role, text): what a model is asked for a plain answer after its tools ran: the last question, the tools called, their results cut to ``most``, and the request.

    Threads without a question or without a tool call (names in the array ``calls``) give no rows.
    """
    called = messages.where(F.size(calls) > 0)
    asked = messages.where(F.col(role) == human).groupBy(thread).agg(F.max_by(F.struct(seq, text), seq).alias("last"))
    asked = asked.join(called.select(thread).distinct(), thread, "left_semi")
    row = lambda df, part, at, who, what: df.select(thread, F.lit(part).alias("part"), F.col(at).alias(seq), F.lit(who).alias(role), what.alias(text))
    parts = [
        row(called, 1, seq, "assistant", F.concat(F.lit(NEEDS), F.array_join(calls, ", "))),
        row(messages.where(F.col(role) == tool), 2, seq, tool, truncate(F.col(text), most, CUT)),
    ]
    open_threads = asked.select(thread)
    middle = parts[0].unionByName(parts[1]).join(open_threads, thread, "left_semi")
    return row(asked, 0, f"last.{seq}", human, F.col(f"last.{text}")).unionByName(middle).unionByName(row(asked, 3, f"last.{seq}", human, F.lit(ANSWER_NOW)))


def checkpoint_messages(checkpoints: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ord, role, content) of JSON checkpoints: ``messages``, else those of ``channel_values``, else those of ``state``; contents over 5 characters, cut to 200. Broken payloads give no rows."""
    shape = "array<struct<role string, content string>>"
    held = F.from_json(F.col(payload), f"messages {shape}, channel_values struct<messages {shape}>, state struct<messages {shape}>")
    rows = checkpoints.select(key, held.alias("c")).select(key, F.posexplode(F.coalesce("c.messages", "c.channel_values.messages", "c.state.messages")).alias("ord", "m"))
    return rows.where(F.length("m.content") > 5).select(key, "ord", "m.role", truncate(F.col("m.content"), 200).alias("content"))
