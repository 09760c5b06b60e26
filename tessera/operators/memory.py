"""Facts worth keeping: those that memory does not hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_fact


def new_facts(found: DataFrame, memories: DataFrame, fact: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """Rows of ``found`` whose fact, normalised, no memory of the same ``by`` holds; of equal facts the first by ``order``. NULL is no fact."""
    key = [*by, "_norm"]
    known = memories.select(*by, normalize_fact(F.col(fact)).alias("_norm")).where(F.col("_norm").isNotNull()).distinct()
    fresh = found.withColumn("_norm", normalize_fact(F.col(fact))).where(F.col("_norm").isNotNull())
    firsts = fresh.groupBy(*key).agg(F.min_by(F.struct(*found.columns), F.struct(*order)).alias("_row"))
    return firsts.join(known, key, "left_anti").select("_row.*")


#: The kinds of memory.
KINDS = ("semantic", "procedural", "episodic")


def counts_by_kind(memories: DataFrame, by: list[str], kind: str = "type") -> DataFrame:
    """A column for each kind of memory: how many there are."""
    return memories.groupBy(*by).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in KINDS))
