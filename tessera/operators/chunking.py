"""Chunkers: fixed windows, sentences, paragraphs; and where chunks lie in their text.

Packing goes once through the pieces of a text in Arrow batches; a chunk is joined when it closes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

#: Where sentences and paragraphs part.
_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[。！？.!?])\s+"), re.compile(r"\n\s*\n")


def windows(text: Column, size: int, overlap: int) -> Column:
    """array of substrings of ``size`` characters, ``size - overlap`` apart; none for an empty text."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


class _Open:
    """The pieces of the chunk that is being filled, and its size."""

    def __init__(self, glue: str):
        self.glue, self.pieces, self.used = glue, [], 0

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.used += len(piece) + len(self.glue)

    def takes(self, piece: str, size: int) -> bool:
        return self.used + len(piece) + len(self.glue) <= size

    def close(self) -> list[str]:
        """The chunk, if there is one, with a new one opened."""
        done = [self.glue.join(self.pieces)] if self.pieces else []
        self.pieces, self.used = [], 0
        return done


def _pieces(text: str, cut: re.Pattern) -> list[str]:
    return [p for p in (x.strip() for x in cut.split(text)) if p]


def _by_sentence(text: str, size: int, overlap: int) -> Iterator[str]:
    chunk = _Open("")
    for s in _pieces(text, _SENTENCE):
        if not chunk.takes(s, size):
            yield from chunk.close()
            if len(s) > size:
                yield from (s[i : i + size] for i in range(0, len(s), size - overlap))
                continue
        chunk.add(s)
    yield from chunk.close()


def _last(pieces: list[str], most: int) -> list[str]:
    """The last pieces whose lengths sum up to ``most`` at most."""
    first, left = len(pieces), most
    while first and len(pieces[first - 1]) <= left:
        first -= 1
        left -= len(pieces[first])
    return pieces[first:]


def _by_paragraph(text: str, size: int, overlap: int) -> Iterator[str]:
    if len(text) <= size:
        yield text
        return
    chunk = _Open("\n\n")
    for p in _pieces(text, _PARAGRAPH):
        if len(p) > size:
            yield from chunk.close()
            yield from _by_sentence(p, size, overlap)
            continue
        if not chunk.takes(p, size):
            head = chunk.glue.join(_last(chunk.pieces, overlap)) if overlap > 0 else ""
            yield from chunk.close()
            # a kept tail is one piece from here on, as the overlap of the next full chunk sees it
            if head:
                chunk.add(head)
            chunk.add(p)
            chunk.used -= len(chunk.glue)  # the size of a chunk that opened like this counts no glue behind it
            continue
        chunk.add(p)
    yield from chunk.close()


def _packed(text: Column, rule, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(rule(t, size, overlap)))

    return pack(text)


def sentences(text: Column, size: int, overlap: int) -> Column:
    """Sentences packed into chunks of up to ``size`` characters; a longer one is cut into windows. NULL stays NULL."""
    return _packed(text, _by_sentence, size, overlap)


def paragraphs(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Paragraphs packed into chunks of up to ``size`` characters.

    A text that fits is one chunk. The last paragraphs of a full chunk that fit ``overlap`` open the
    next one. A paragraph over ``size`` ends the open chunk and is packed by sentences. An empty text
    and NULL have no chunks.
    """
    packed = _packed(clean_text(text), _by_paragraph, size, overlap)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(packed)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000, overlap: int = 200, kind: str = "paragraphs") -> DataFrame:
    """(key, chunk_index, chunk_id, chunk) of every chunk."""
    by = {"paragraphs": paragraphs, "sentences": sentences, "windows": windows}[kind]
    rows = docs.select(key, F.posexplode(by(F.col(text), size, overlap)).alias("chunk_index", "chunk"))
    return rows.select(key, "chunk_index", F.concat_ws("_", key, "chunk_index").alias("chunk_id"), "chunk")


def offsets(text: Column, chunks: Column, probe: int = 30) -> Column:
    """Where each chunk starts: its first characters from the running position on, else anywhere, else the running position."""

    def step(acc, c):
        head = F.left(c, F.lit(probe))
        here, any_ = _locate(head, text, acc["at"]), _locate(head, text, F.lit(0))
        at = F.when(here >= 0, here).when(any_ >= 0, any_).otherwise(acc["at"])
        return F.struct(F.concat(acc["out"], F.array(at)).alias("out"), (at + F.length(c)).alias("at"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(chunks, start, step, lambda a: a["out"])


def _locate(part: Column, text: Column, at: Column) -> Column:
    """0-based place of ``part`` in ``text`` from ``at`` on, or -1."""
    return F.call_function("locate", part, text, at + 1) - 1
