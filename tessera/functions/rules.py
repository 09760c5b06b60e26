"""Predicates and small lookups: gates, permissions, routing, model sizes, memory facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import any_of, normalize_filename, strip

#: Words that make a message worth remembering.
MEMORABLE = ("喜欢", "爱好", "兴趣", "讨厌", "不喜欢", "我是", "我是做", "我的工作", "我的职业", "项目", "产品", "公司", "团队", "目标", "计划", "梦想", "愿望", "地址", "城市", "住在", "来自", "年龄", "生日", "出生", "学历", "学校", "专业", "联系方式", "邮箱", "电话")
#: What tells an embedding model by its name.
EMBEDDING_NAMES = ("embed", "bge", "gte", "m3e")
#: Model sizes by what a name contains, first match first; memory of the cache in MB for 1K tokens.
MODEL_SIZES = (("0.5b", "1B"), ("1b", "1B"), ("1.5b", "1B"), ("4b", "4B"), ("3b", "4B"), ("3.5b", "4B"), ("7b", "7B"), ("8b", "8B"), ("13b", "13B"), ("14b", "13B"), ("70b", "70B"), ("72b", "70B"))
CACHE_MB = {"1B": 18, "4B": 37, "7B": 64, "8B": 64, "13B": 120, "70B": 640}


def memorable(text: Column) -> Column:
    return any_of(text, MEMORABLE)


def is_embedding_model(name: Column) -> Column:
    return any_of(name, EMBEDDING_NAMES)


def model_size(name: Column) -> Column:
    """The size class that a model's name stands for; 7B if it tells nothing."""
    size, low = F.lit("7B"), F.lower(name)
    for part, value in reversed(MODEL_SIZES):
        size = F.when(F.contains(low, F.lit(part)), value).otherwise(size)
    return size


def affordable_context(name: Column, memory_gb: Column) -> Column:
    """Tokens of context that fit beside a model, not yet aligned."""
    size = model_size(name)
    weights = F.regexp_replace(size, "B", "").cast("double") * 0.5
    cache = F.create_map(*(x for k, v in CACHE_MB.items() for x in (F.lit(k), F.lit(v))))[size]
    return F.greatest(F.lit(0), F.floor((memory_gb - weights - 1) * 1024 / cache * 1024)).cast("long")


def stated_name(text: Column) -> Column:
    """The name in ``我叫…``, or NULL."""
    name = strip(F.regexp_extract(text, r"我叫\s*([^，。！？\n]{2,20})(?=[，。！？\n]|$)", 1))
    return F.when(F.length(name) >= 2, name)


def memory_lines(reply: Column) -> Column:
    """array of (category, fact) of the lines ``- [category] fact``."""
    pattern = r"(?m)^-\s*\[([^\]]+)\]\s*(.+)$"
    return F.arrays_zip(F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)).alias("category"), F.regexp_extract_all(reply, F.lit(pattern), F.lit(2)).alias("fact"))


def permitted(user: Column, allowed: list[str]) -> Column:
    """Whether a user is on the list; an empty list admits all."""
    return F.lit(True) if not allowed else user.isin(*allowed)


def route(text: Column, n_attachments: Column) -> Column:
    """Where a message goes: attachments first, then commands, then chat."""
    return F.when(n_attachments > 0, "attachment").when(F.startswith(text, F.lit("/")), "command").otherwise("chat")


def first_trigger(query: Column, triggers: DataFrame, queries: DataFrame, key: str, small: int = 10_000) -> DataFrame:
    """(key, skill): the first skill, in order of registration, one of whose triggers the query contains.

    ``triggers``: skill, ord, trigger. Up to ``small`` of them travel as one row; more are looked for
    like the terms of a dictionary, with the same result.
    """
    if triggers.limit(small + 1).count() > small:
        from ..operators.entities import contained_terms

        terms = triggers.select("ord", "skill", F.lower("trigger").alias("term"))
        texts = queries.select(key, F.lower(query).alias("_low"))
        held = contained_terms(texts, terms.select("term", F.lit("").alias("type")), key, "_low").join(terms, "term").select(key, "ord", "skill")
        always = terms.where("term = ''").groupBy().agg(F.min(F.struct("ord", "skill")).alias("a")).where("a IS NOT NULL")  # one row at most
        held = held.unionByName(texts.where("_low IS NOT NULL").crossJoin(F.broadcast(always)).select(key, "a.ord", "a.skill"))
        return held.groupBy(key).agg(F.min(F.struct("ord", "skill"))["skill"].alias("skill"))
    rows = triggers.agg(F.sort_array(F.collect_list(F.struct("ord", "skill", F.lower("trigger").alias("trigger")))).alias("all"))
    low = F.lower(query)
    found = queries.crossJoin(F.broadcast(rows)).withColumn("hit", F.filter("all", lambda t: F.contains(low, t["trigger"])))
    return found.where(F.size("hit") > 0).select(key, F.col("hit")[0]["skill"].alias("skill"))


def prefix_lookup(names: DataFrame, asked: DataFrame, name: str, prefix: str) -> DataFrame:
    """(prefix, name, n): the name that starts with a prefix, NULL if several do. Names meet prefixes by the prefixes' lengths."""
    lengths = [r[0] for r in asked.select(F.length(prefix)).distinct().collect()]  # at most as many as a name is long
    fronts = names.select(name, F.explode(F.array(*(F.left(name, F.lit(n)) for n in lengths) if lengths else [F.lit("")])).alias(prefix)).distinct()
    rows = asked.join(fronts, prefix).groupBy(prefix).agg(F.count("*").alias("n"), F.min(name).alias("one"))
    return rows.select(prefix, F.when(F.col("n") == 1, F.col("one")).alias(name), "n")


def matching_lines(docs: DataFrame, key: str, text: str, words: list[str], most: int = 10) -> DataFrame:
    """(key, line, text): the first lines that contain any of the words, whatever the case."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("line"))
    return lines.where(any_of(F.col("text"), words)).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def memory_sections(text: Column) -> Column:
    """The sections of a memory file from the first ``## `` heading on, without those on usage and format."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=## )")
    head = lambda s: F.substring_index(s, "\n", 1)
    keep = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~F.contains(head(s), F.lit("使用说明")) & ~F.contains(head(s), F.lit("格式")))
    return F.array_join(keep, "\n")


def eta(done: Column, total: Column, seconds: Column) -> Column:
    """Text of the time left at the speed so far."""
    left = F.when(done > 0, seconds / done * (total - done))
    return F.when(left < 60, F.format_string("%d s", left.cast("int"))).when(left < 3600, F.format_string("%d min", (left / 60).cast("int"))).otherwise(F.format_string("%.1f h", left / 3600))


def fused_context(entities: DataFrame, relations: DataFrame, key: str, entity_tokens: int = 2000, relation_tokens: int = 3000) -> DataFrame:
    """(key, context): lists of entities (ord, name, type, description) and relations (ord, src, relation, dst, description), each up to the first line that breaks its budget."""
    from ..operators.context import prefix_fit

    plain = F.concat_ws(" ", "src", "relation", "dst")
    lines = {
        "## 实体信息": (entities.select(key, "ord", F.format_string("- %s (%s): %s", "name", "type", "description").alias("line")), entity_tokens),
        "## 关系信息": (relations.select(key, "ord", F.concat(F.lit("- "), plain, F.when((F.coalesce("description", F.lit("")) != "") & (F.col("description") != plain), F.concat(F.lit(": "), F.col("description"))).otherwise("")).alias("line")), relation_tokens),
    }
    parts = None
    for i, (title, (rows, budget)) in enumerate(lines.items()):
        fit = prefix_fit(rows, [key], ["ord"], F.floor(F.length("line") / 2), F.lit(budget))
        own = fit.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("own"))
        own = own.select(key, F.lit(i).alias("i"), F.concat(F.lit(title + "\n"), F.array_join(F.transform("own", lambda x: x["line"]), "\n")).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("own")).select(key, F.array_join(F.transform("own", lambda x: x["part"]), "\n\n").alias("context"))


def assemble(*layers: tuple[str, Column]) -> Column:
    """Named layers as one prompt; empty ones are left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), c)) for name, c in layers))


def similar_name(name: Column, other: Column) -> Column:
    """How alike two file names are after normalising: twice the matching characters over all (Ratcliff and Obershelp)."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return ratio(normalize_filename(name), normalize_filename(other))


def answers(kind: Column, named: Column, only_named: bool) -> Column:
    """Whether a message is answered: in groups, with ``only_named``, only if it names the assistant."""
    return ~((kind == "group") & F.lit(only_named) & ~F.coalesce(named, F.lit(False)))
