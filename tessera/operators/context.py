"""Token budgets, compaction of conversations, and recall from memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import by_script


def suffix_fit(rows: DataFrame, by: list[str], order: str, cost: Column, budget: Column) -> DataFrame:
    """The newest rows that fit the budget: costs are not negative, so stopping at the first that does not fit is a running sum."""
    used = F.sum(cost).over(W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def prefix_fit(rows: DataFrame, by: list[str], order: list[str], cost: Column, budget: Column) -> DataFrame:
    """The first rows that fit the budget."""
    used = F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def knowledge_fit(rows: DataFrame, by: list[str], order: str, cost: Column, budget: Column) -> DataFrame:
    """Memories first, then knowledge rows, each up to the first that does not fit; the second starts from what the first used.

    ``rows`` has kind 'memory' or 'kb'.
    """
    memory = prefix_fit(rows.where("kind = 'memory'"), by, [order], cost, budget)
    spent = memory.groupBy(*by).agg(F.max("used").alias("spent"))
    kb = rows.where("kind = 'kb'").join(spent, by, "left").fillna(0.0, ["spent"])
    kb = prefix_fit(kb, by, [order], cost, budget - F.col("spent")).withColumn("used", F.col("used") + F.col("spent")).drop("spent")
    return memory.unionByName(kb)


def fit_layers(parts: DataFrame, key: str, max_tokens: int, working_share: float = 0.4) -> DataFrame:
    """Rows of (key, layer, kind, ord, cost) that make the context: the runtime layer whole, the newest working rows up to its share, knowledge in what is left."""
    runtime = parts.where("layer = 'runtime'")
    left = parts.select(key).distinct().join(runtime.groupBy(key).agg(F.sum("cost").alias("r")), key, "left").select(key, (max_tokens - F.floor(F.coalesce("r", F.lit(0.0)))).alias("left"))
    working = parts.where("layer = 'working'").join(left, key).where("left > 0")
    kept = suffix_fit(working, [key], "ord", F.col("cost"), F.least(F.lit(int(max_tokens * working_share)), F.col("left")))
    rest = left.join(kept.groupBy(key).agg(F.floor(F.max("used")).alias("w")), key, "left").select(key, (F.col("left") - F.coalesce("w", F.lit(0))).alias("rest"))
    knowledge = parts.where("layer = 'knowledge'").join(rest, key).where("rest > 0")
    fit = knowledge_fit(knowledge, [key], "ord", F.col("cost"), F.col("rest"))
    cols = [key, "layer", "kind", "ord", "cost"]
    return runtime.select(*cols).unionByName(kept.select(*cols)).unionByName(fit.select(*cols))


def compact(messages: DataFrame, thread: str, seq: str, role: str, keep: int = 10) -> DataFrame:
    """System messages and the last ``keep`` of the others."""
    system = F.col(role) == "system"
    recent = F.row_number().over(W.partitionBy(thread, system).orderBy(F.desc(seq)))
    return messages.withColumn("recent", recent).where(system | (F.col("recent") <= keep)).drop("recent")


def compaction_report(messages: DataFrame, thread: str, seq: str, role: str, text: str, keep: int = 10) -> DataFrame:
    """Messages and tokens of each thread before and after, and the ratio."""
    system = F.col(role) == "system"
    recent = F.row_number().over(W.partitionBy(thread, system).orderBy(F.desc(seq)))
    stays = system | (F.col("recent") <= keep)
    cost = by_script(F.col(text)).cast("long")
    rows = messages.withColumn("recent", recent).groupBy(thread).agg(F.count("*").alias("n_before"), F.count_if(stays).alias("n_after"), F.sum(cost).alias("tokens_before"), F.sum(F.when(stays, cost).otherwise(0)).alias("tokens_after"))
    ratio = F.when(F.col("tokens_before") > 0, F.col("tokens_after") / F.col("tokens_before")).otherwise(1.0)
    return rows.withColumn("ratio", ratio)


def needs_compaction(messages: DataFrame, thread: str, text: str, max_tokens: int, share: float = 0.8) -> DataFrame:
    """Threads that hold ``share`` of the budget or more."""
    return messages.groupBy(thread).agg(F.sum(by_script(F.col(text)).cast("long")).alias("tokens")).where(F.col("tokens") >= max_tokens * share)


def transcript(messages: DataFrame, thread: str, seq: str, role: str, text: str, line: str = "%s: %s", sep: str = "\n") -> DataFrame:
    """(thread, transcript): messages in order, each by its template."""
    own = F.sort_array(F.collect_list(F.struct(seq, F.format_string(line, F.col(role), F.col(text)).alias("line"))))
    return messages.groupBy(thread).agg(F.array_join(F.transform(own, lambda x: x["line"]), sep).alias("transcript"))


#: How an exported session shows the messages of each role, and how much of a system message.
EXPORTED = {"human": "**用户:** %s", "ai": "**助手:** %s", "system": "*[系统]* %s..."}
SYSTEM_CHARS = 100


def session_markdown(messages: DataFrame, thread: str, seq: str, role: str, text: str, exported: Column) -> DataFrame:
    """(thread, markdown): a session as a document, each message by its role's template; ``exported`` is the time it names."""
    who, what = F.col(role), F.coalesce(F.col(text), F.lit(""))
    line = F.concat(F.lit("*"), F.coalesce(who, F.lit("")), F.lit(":* "), what)
    for kind, template in EXPORTED.items():
        before, after = template.split("%s")
        shown = F.left(what, F.lit(SYSTEM_CHARS)) if kind == "system" else what
        line = F.when(who == kind, F.concat(F.lit(before), shown, F.lit(after))).otherwise(line)
    own = F.sort_array(F.collect_list(F.struct(seq, line.alias("line"))))
    rows = messages.groupBy(thread).agg(own.alias("own"))
    head = F.concat(F.lit("# 会话导出: "), F.col(thread).cast("string"), F.lit("\n\n导出时间: "), F.date_format(exported, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n---\n\n"))
    body = F.array_join(F.transform("own", lambda x: F.concat(x["line"], F.lit("\n\n"))), "")
    return rows.select(thread, F.concat(head, body, F.lit("---\n\n共 "), F.size("own").cast("string"), F.lit(" 条消息\n")).alias("markdown"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def keyword_score(query: Column, text: Column, importance: Column) -> Column:
    """The share of the query's distinct words that the text has, times its importance."""
    q = word_set(query)
    return F.size(F.array_intersect(q, word_set(text))) / F.greatest(F.size(q), F.lit(1)) * importance


def keyword_recall(memories: DataFrame, query: Column, k: int, text: str = "content", key: str = "id") -> DataFrame:
    scored = memories.withColumn("score", keyword_score(query, F.col(text), F.col("importance"))).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def hybrid_recall(by_vector: DataFrame, by_keyword: DataFrame, k: int, text: str = "content", key: str = "id") -> DataFrame:
    """Both kinds of finds, vector finds first among equal contents, the best ``k``."""
    both = by_vector.withColumn("source", F.lit("vector")).unionByName(by_keyword.withColumn("source", F.lit("keyword")))
    first = F.row_number().over(W.partitionBy(text).orderBy(F.when(F.col("source") == "vector", 0).otherwise(1), F.desc("score"), key))
    rows = both.withColumn("rn", first).where((F.col("rn") == 1) | (F.col("source") == "vector")).drop("rn")
    return rows.orderBy(F.desc("score"), key, "source").limit(k)


def simple_summary(messages: DataFrame, thread: str, role: str, text: str, short: int = 50) -> DataFrame:
    """(thread, summary) without a model: how many short messages of the user there were."""
    n = F.count_if((F.col(role) == "user") & (F.length(text) > 0) & (F.length(text) < short))
    rows = messages.groupBy(thread).agg(n.alias("n"))
    return rows.select(thread, F.when(F.col("n") > 0, F.concat(F.lit("讨论过 "), F.col("n").cast("string"), F.lit(" 个话题"))).otherwise("对话历史已压缩").alias("summary"))


def compacted(messages: DataFrame, summaries: DataFrame, thread: str, seq: str, role: str, text: str, max_tokens: int, share: float = 0.8, keep: int = 10) -> DataFrame:
    """Threads within ``share`` of the budget as they are; the others as their system messages, a message with their summary (thread, summary; none without one), and the last ``keep``."""
    due = needs_compaction(messages, thread, text, max_tokens, share).select(thread).distinct()
    same = messages.join(due, thread, "left_anti").select(thread, F.col(seq).cast("double").alias(seq), role, text)
    some = compact(messages.join(due, thread, "left_semi"), thread, seq, role, keep).select(thread, F.col(seq).cast("double").alias(seq), role, text)
    first = some.where(F.col(role) != "system").groupBy(thread).agg(F.min(seq).alias("_first"))
    note = summaries.join(due, thread, "left_semi").join(first, thread, "left").where("summary <> ''")
    note = note.select(thread, (F.coalesce("_first", F.lit(0.0)) - 0.5).alias(seq), F.lit("system").alias(role), F.col("summary").alias(text))
    return same.unionByName(some).unionByName(note)


def layer_tokens(parts: DataFrame, key: str, layer: str, text: str) -> DataFrame:
    """(key, layer, tokens): one and a half for each character, added up in a layer and then cut to a whole number."""
    return parts.groupBy(key, layer).agg(F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) * 1.5).cast("long").alias("tokens"))
