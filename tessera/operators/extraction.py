"""Extraction of entities and relations from chunks: dictionary, patterns, a model's replies, and what is left to infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import llm_json
from .entities import best_per_name, occurrences, pattern_mentions, resolved

ENTITIES = "array<struct<name:string,type:string,confidence:double>>"
RELATIONS = "array<struct<source:string,target:string,relation:string,confidence:double>>"
#: Who is asked first.
SOURCES = ("dictionary", "pattern", "llm")


def replied(replies: DataFrame, key: str, reply: str, field: str, kind: str) -> DataFrame:
    """(key, ord, ...): the objects of one list of a model's JSON replies; replies that are none give no rows."""
    listed = F.try_variant_get(llm_json(F.col(reply)), f"$.{field}", kind)
    return replies.select(key, F.posexplode(listed).alias("ord", "x")).select(key, "ord", "x.*")


def model_mentions(texts: DataFrame, replies: DataFrame, dictionary: DataFrame, claimed: DataFrame, key: str, text: str, reply: str = "reply") -> DataFrame:
    """(key, term, type, start, end, confidence, source) of the names in a model's replies that no dictionary has.

    In the order of the reply each name takes its first occurrence that shares no character with
    ``claimed`` (key, start, end) or the names before it: a fold over one reply.
    """
    named = replied(replies, key, reply, "entities", ENTITIES).where("name <> ''")
    named = named.join(dictionary.select(F.col("term").alias("name")).distinct(), "name", "left_anti")
    facts = F.struct("ord", "name", F.coalesce("type", F.lit("未知")).alias("type"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(facts)).alias("names"))
    walls = claimed.groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("taken"))
    rows = texts.select(key, text).join(lists, key).join(walls, key, "left")
    spans = "array<struct<start:int,end:int>>"
    found = "array<struct<term:string,type:string,start:int,end:int,confidence:double>>"
    begin = F.struct(F.coalesce("taken", F.array().cast(spans)).alias("taken"), F.array().cast(found).alias("out"))

    def step(acc, x):
        places = F.transform(occurrences(F.col(text), x["name"]), lambda s: F.struct(s.alias("start"), (s + F.length(x["name"])).alias("end")))
        free = F.filter(places, lambda p: ~F.exists(acc["taken"], lambda t: (t["start"] < p["end"]) & (p["start"] < t["end"])))
        first = F.get(free, F.lit(0))
        hit = F.struct(x["name"].alias("term"), x["type"].alias("type"), first["start"].alias("start"), first["end"].alias("end"), x["confidence"].alias("confidence"))
        has = first.isNotNull()
        return F.struct(F.when(has, F.concat(acc["taken"], F.array(first))).otherwise(acc["taken"]).cast(spans).alias("taken"), F.when(has, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).cast(found).alias("out"))

    return rows.select(key, F.inline(F.aggregate("names", begin, step, lambda acc: acc["out"]))).withColumn("source", F.lit("llm"))


def extract(texts: DataFrame, dictionary: DataFrame, key: str, text: str, replies: DataFrame | None = None, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Entities (key, rank, term, type, start, end, confidence, source) and relations (key, rank, source, target, relation, confidence) of each chunk.

    Terms of the dictionary claim their characters first, then patterns, then the names of the
    model's ``replies`` (key, reply). Of equal names the surest stays, the first of equals. Entities
    stand by confidence, then by length of the name, then by source and place; the first ``k`` remain.
    Relations are the model's; a chunk with fewer than three of them gets pairs of its entities in
    that order besides, up to ``k`` in all.
    """
    own = ["term", "type", "start", "end", "confidence", "source"]
    known = resolved(texts, dictionary, key, text).select(key, *own)
    shaped = pattern_mentions(texts, key, text, known).select(key, *own)
    found = known.unionByName(shaped)
    if replies is not None:
        found = found.unionByName(model_mentions(texts, replies, dictionary, found, key, text).select(key, *own))
    turn = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    named = best_per_name(found.withColumn("_turn", turn), [key, "term"], ["_turn", "start"])
    order = [F.desc("confidence"), F.desc(F.length("term")), "_turn", "start", "term"]
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k + 1)
    entities = ranked.where(F.col("rank") <= k).select(key, "rank", *own)

    # of the first k pairs none needs an entity behind the first k + 1
    terms = ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    pairs = terms.select(key, "terms", F.posexplode("terms").alias("i", "source")).select(key, "i", "source", F.posexplode(F.expr("slice(terms, i + 2, size(terms))")).alias("j", "target"))
    inferred = pairs.select(key, F.lit(1).alias("_turn"), "i", "j", "source", "target", F.lit("CO_OCCUR").alias("relation"), F.lit(0.5).alias("confidence"))
    if replies is None:
        every = inferred
    else:
        said = replied(replies, key, "reply", "relations", RELATIONS)
        blank = F.lit("")
        said = said.select(key, F.lit(0).alias("_turn"), F.col("ord").alias("i"), F.lit(0).alias("j"), F.coalesce("source", blank).alias("source"), F.coalesce("target", blank).alias("target"), F.coalesce("relation", F.lit("RELATED")).alias("relation"), F.coalesce("confidence", F.lit(0.6)).alias("confidence"))
        enough = said.groupBy(key).count().where("count >= 3").select(key)
        every = said.unionByName(inferred.join(enough, key, "left_anti"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("_turn", "i", "j"))
    return entities, every.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "source", "target", "relation", "confidence")


def learned(entities: DataFrame, doc: str = "doc_id", least: float = 0.7) -> DataFrame:
    """(doc, type, term) for the private dictionary of each document: what a model named with more than ``least`` confidence."""
    return entities.where((F.col("source") == "llm") & (F.col("confidence") > least)).select(doc, "type", "term").distinct()


def entity_text(name, kind) -> F.Column:
    """What is embedded for an entity."""
    return F.concat(name, F.lit(" "), kind)


def relation_text(source, target) -> F.Column:
    """What is embedded for a relation."""
    return F.concat(source, F.lit(" 与 "), target, F.lit(" 相关"))


def zipped(a, b) -> F.Column:
    """array of (left, right) of two arrays by place, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("left"), y.alias("right")))
