"""Token estimates and the step functions that follow from a model's context length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halves(text: Column) -> Column:
    """Half the characters, rounded down."""
    return F.floor(F.length(text) / 2).cast("int")


def generous(text: Column) -> Column:
    """One and a half tokens a character, as a double."""
    return F.length(text).cast("double") * 1.5


def by_script(text: Column) -> Column:
    """1.5 for a CJK character, 0.5 for any other, rounded down a text."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}]", ""))
    return F.floor(cjk * F.lit(1.5) + (F.length(text) - cjk) * F.lit(0.5)).cast("int")


def document_estimate(text: Column) -> Column:
    return F.length(text).cast("double") * 0.6


#: Context length up to, chunk size, overlap.
CHUNK_STEPS = ((8192, 2000, 200), (32768, 4000, 400), (131072, 6000, 600))
CHUNK_REST = (8000, 800)


def chunk_config(context: Column) -> Column:
    """(size, overlap) for a context length."""
    size, overlap = F.lit(CHUNK_REST[0]), F.lit(CHUNK_REST[1])
    for limit, s, o in reversed(CHUNK_STEPS):
        size, overlap = F.when(context <= limit, s).otherwise(size), F.when(context <= limit, o).otherwise(overlap)
    return F.struct(size.alias("size"), overlap.alias("overlap"))


#: Context length up to, tokens for entities, relations and text.
FUSION_STEPS = ((8192, 1000, 1500, 4000), (32768, 2000, 3000, 8000))
FUSION_REST = (4000, 6000, 16000)


def fusion_budget(context: Column) -> Column:
    """(entities, relations, text) budgets for a context length."""
    out = []
    for k, name in enumerate(("entities", "relations", "text")):
        c = F.lit(FUSION_REST[k])
        for step in reversed(FUSION_STEPS):
            c = F.when(context <= step[0], step[k + 1]).otherwise(c)
        out.append(c.alias(name))
    return F.struct(*out)


def use_full_text(length: Column, context: int | None = None) -> Column:
    """Whether a document goes to the model whole: 60 % of its length fits 30 % of the context; under 2,000 characters without a model."""
    return length < 2000 if context is None else length * 0.6 < int(context * 0.3)


def full_text_threshold(context: Column) -> Column:
    return F.floor(F.floor(context * 0.3) / 0.6).cast("int")


def align_context(tokens: Column) -> Column:
    """Down to the next of 8K, 16K … 256K, 8K at least."""
    c = F.lit(8192)
    for k in (16384, 32768, 65536, 131072, 262144):
        c = F.when(tokens >= k, k).otherwise(c)
    return c


def truncation_limit(context: Column) -> Column:
    return F.greatest(F.lit(2000), F.least(F.floor(context * 0.9), F.lit(50000))).cast("int")
