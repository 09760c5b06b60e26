"""The entity graph: co-occurrence edges, neighbourhoods, merges, and searches that expand through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .sessions import _written


def _members(mentions: DataFrame, chunk: str, name: str, order: str | list[str], cap: int) -> DataFrame:
    """(chunk, own): the first ``cap`` entities of each chunk in ``order``, as an array. More than that never travel from a task (a group limit)."""
    order = [order] if isinstance(order, str) else list(order)
    rank = F.row_number().over(W.partitionBy(chunk).orderBy(*order, name))
    first = mentions.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return first.groupBy(chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", name))), lambda x: x[name]).alias("own"))


def _pairs(own: DataFrame, chunk: str) -> DataFrame:
    heads = own.select(chunk, "own", F.posexplode("own").alias("i", "src"))
    return heads.select(chunk, "src", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("dst"))


def cooccurrence(mentions: DataFrame, chunk: str, name: str, order: str | list[str], cap: int = 20) -> DataFrame:
    """(chunk, src, dst): ordered pairs of the entities of a chunk.

    A chunk counts by its first ``cap`` entities in ``order`` (columns of ``mentions`` that say which
    come first, as ``strongest_first`` does), so it has at most ``cap * (cap - 1) / 2`` pairs. The only
    shuffle is by chunk.
    """
    return _pairs(_members(mentions, chunk, name, order, cap), chunk)


def strongest_first(mentions: DataFrame, confidence: str = "confidence", name: str = "name") -> tuple[DataFrame, list[str]]:
    """``mentions`` with the columns by which extraction picks entities of a chunk: confidence, then the longer name; and their names in order."""
    return mentions.withColumns({"_weak": -F.col(confidence), "_short": -F.length(name)}), ["_weak", "_short"]


def _chunks_of(mentions: DataFrame, entities: DataFrame, chunk: str, name: str, order, cap: int) -> DataFrame:
    """Members of the chunks that hold any of ``entities`` (name): two joins on keys, whatever the size of the corpus."""
    asked = entities.select(F.col("name").alias(name)).distinct()
    chunks = mentions.join(asked, name, "left_semi").select(chunk).distinct()
    return _members(mentions.join(chunks, chunk, "left_semi"), chunk, name, order, cap)


def edges_near(mentions: DataFrame, entities: DataFrame, chunk: str, name: str, order: str | list[str], cap: int = 20) -> DataFrame:
    """(src, dst, n): the weighted edges of ``cooccurrence`` that touch ``entities`` (name), from their chunks alone."""
    own = _chunks_of(mentions, entities, chunk, name, order, cap)
    asked = entities.select("name").distinct()
    pairs = _pairs(own, chunk)
    ends = pairs.join(asked.select(F.col("name").alias("src"), F.lit(True).alias("_a")), "src", "left").join(asked.select(F.col("name").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    return edge_weights(ends.where(F.coalesce("_a", "_b")).select(chunk, "src", "dst"))


def reach(mentions: DataFrame, entities: DataFrame, chunk: str, name: str, order: str | list[str], hops: int = 1, cap: int = 20) -> DataFrame:
    """(name, hop): what ``expand`` finds over all edges of ``cooccurrence``, chunk by chunk from ``entities`` without making the edges. Lineage is cut after each step."""
    seen = entities.select("name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        own = _chunks_of(mentions, front, chunk, name, order, cap)
        near = own.select(chunk, "own", F.explode("own").alias("name")).join(front.select("name"), "name", "left_semi")
        step = near.select(F.explode("own").alias("name")).distinct()
        front = step.join(seen, "name", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
        if hop < hops and mentions.sparkSession.conf.get("spark.checkpoint.dir", None):
            seen = seen.checkpoint()
            front = seen.where(F.col("hop") == hop)
    return seen


#: Mentions that a task pairs, on average.
TASK_MENTIONS = 100_000


def cooccurrence_weights(mentions: DataFrame, chunk: str, name: str, order: str | list[str], cap: int = 20, task_mentions: int = TASK_MENTIONS) -> DataFrame:
    """(src, dst, n): ``edge_weights`` of ``cooccurrence``, in tasks of bounded size.

    The number of tasks follows that of the mentions, not that of the cores. The chunks of one part are in one task; it counts the
    pairs of the part, and only these counts travel, so a pair of very many chunks is a row for each part.
    """
    n = max(1, -(-mentions.count() // task_mentions))
    order = [order] if isinstance(order, str) else list(order)
    rank = F.row_number().over(W.partitionBy(chunk).orderBy(*order, name))
    first = mentions.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    dealt = first.select(F.pmod(F.xxhash64(chunk), F.lit(8 * n)).alias("_part"), chunk, "_rank", name).repartition(n, "_part")
    own = dealt.groupBy("_part", chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", name))), lambda x: x[name]).alias("own"))
    heads = own.select("_part", "own", F.posexplode("own").alias("i", "src"))
    pairs = heads.select("_part", "src", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("dst"))
    counts = pairs.groupBy("_part", "src", "dst").agg(F.count("*").alias("n"))
    return counts.select("src", "dst", "n").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, n): chunks a pair is in."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end; self-loops once."""
    back = edges.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def neighbours(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that touch ``entities`` (name), turned so that src is the entity asked for."""
    return both_ways(edges).join(entities.select(F.col("name").alias("src")), "src")


def expand(edges: DataFrame, entities: DataFrame, hops: int = 1) -> DataFrame:
    """(name, hop): entities reached in up to ``hops`` steps, with the first step that reaches them. Lineage is cut after each step."""
    near = both_ways(edges).select("src", "dst").distinct()
    seen = entities.select("name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = near.join(front.select(F.col("name").alias("src")), "src").select(F.col("dst").alias("name")).distinct()
        front = step.join(seen, "name", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
        if hop < hops and edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            seen = seen.checkpoint()
            front = seen.where(F.col("hop") == hop)
    return seen


def documents_of(mentions: DataFrame, entities: DataFrame, name: str, doc: str) -> DataFrame:
    """Distinct documents of ``entities`` (name)."""
    return mentions.join(entities.select(F.col("name").alias(name)), name, "left_semi").select(doc).distinct()


def entity_card(mentions: DataFrame, edges: DataFrame, entities: DataFrame, name: str, kind: str, doc: str) -> DataFrame:
    """(name, type, n_docs, n_neighbours, n_edges) for each of ``entities``."""
    asked = entities.select("name")
    facts = mentions.withColumnRenamed(name, "name").join(asked, "name").groupBy("name").agg(F.min(kind).alias("type"), F.count_distinct(doc).alias("n_docs"))
    near = neighbours(edges, asked).groupBy(F.col("src").alias("name")).agg(F.count_distinct("dst").alias("n_neighbours"), F.sum("n").alias("n_edges"))
    return facts.join(near, "name", "left").fillna(0, ["n_neighbours", "n_edges"])


def related(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Names at the other end of edges that touch the entities whatever the case; names that equal one in lower case go."""
    asked = entities.select(F.lower("name").alias("low")).distinct()
    ends = edges.select(F.lower("src").alias("low"), F.col("dst").alias("name")).unionByName(edges.select(F.lower("dst").alias("low"), F.col("src").alias("name")))
    found = ends.join(asked, "low", "left_semi").select("name").distinct()
    return found.join(asked, F.col("name") == F.col("low"), "left_anti")


def search(mentions: DataFrame, reached: DataFrame, vectors: DataFrame, query, k: int, name: str, doc: str) -> DataFrame:
    """The ``k`` best documents of the entities ``reached`` (name; see ``expand`` and ``reach``), by similarity to ``query``; without a vector 0."""
    docs = documents_of(mentions, reached, name, doc)
    scored = docs.join(vectors.select(F.col("id").alias(doc), "embedding"), doc, "left")
    scored = scored.select(doc, F.coalesce(V.cosine(F.col("embedding"), V.literal(query)), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), doc).limit(k)


def merge_relations(relations: DataFrame, by: list[str], source: str = "source_id", listed: bool = True) -> DataFrame:
    """One row a relation: highest confidence, its ``sources`` (or, not ``listed``, only ``n_sources``, however many there are), longest description (first in order of the text among equals)."""
    longest = F.max(F.struct(F.length("description").alias("n"), "description"))["description"]
    sources = F.sort_array(F.collect_set(source)).alias("sources") if listed else F.count_distinct(source).alias("n_sources")
    return relations.groupBy(*by).agg(F.max("confidence").alias("confidence"), sources, longest.alias("description"))


def merge_descriptions(descriptions) -> F.Column:
    """A fold over an ordered array: equal or contained texts are absorbed, others joined."""

    def two(a, b):
        return (
            F.when(a == b, a).when(F.coalesce(a, F.lit("")) == "", b).when(F.coalesce(b, F.lit("")) == "", a)
            .when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.concat(a, F.lit("；"), b))
        )

    return F.aggregate(descriptions, F.lit(""), two)


def merge_entities(entities: DataFrame, by: list[str], source: str = "source_id", order: str = "ord", listed: bool = True) -> DataFrame:
    """One row an entity: its ``sources`` (or, not ``listed``, only ``n_sources``, however many there are), and its descriptions merged in order. A description that comes again is absorbed, so only its first place travels."""
    facts = [F.min(order).alias("_first")] + ([F.collect_set(source).alias("_sources")] if listed else [])
    firsts = entities.groupBy(*by, "description").agg(*facts)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_first", "description"))), lambda x: x["description"])
    sources = [F.sort_array(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("sources")] if listed else []
    rows = firsts.groupBy(*by).agg(*sources, ordered.alias("own"))
    rows = rows.withColumn("description", merge_descriptions(F.col("own"))).drop("own")
    if listed:
        return rows
    counts = entities.groupBy(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by))).agg(F.count_distinct(source).alias("n_sources"))
    same = [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)]
    return rows.join(counts, same).select(*by, "n_sources", "description")


def add_missing(existing: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` and the rows of ``more`` with a name that is in neither yet, whatever the case."""
    taken = existing.select(F.lower(key).alias("low")).distinct()
    rank = F.row_number().over(W.partitionBy(F.lower(key)).orderBy(order))
    fresh = more.withColumn("rn", rank).where("rn = 1").drop("rn").join(taken, F.lower(F.col(key)) == F.col("low"), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def entity_report(mentions: DataFrame, asked: DataFrame, name: str, kind: str, doc: str, order: list[str], status: str = "status", similarity: str = "similarity") -> DataFrame:
    """(name, type, n_docs, status, similarity) of the entities ``asked`` for: the type and the alignment seen first; unaligned ones are unknown, at 1."""
    first = F.min_by(F.struct(F.col(kind).alias("type"), F.col(status).alias("status"), F.col(similarity).alias("similarity")), F.struct(*order)).alias("f")
    rows = mentions.join(asked.select(name).distinct(), name).groupBy(name).agg(F.count_distinct(doc).alias("n_docs"), first)
    return rows.select(name, "f.type", "n_docs", F.coalesce("f.status", F.lit("unknown")).alias("status"), F.coalesce("f.similarity", F.lit(1.0)).alias("similarity"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links`` (a, b: longs); nodes that links join in any way share the smallest of them as root.

    Every round hangs larger neighbours below the smallest one around, then smaller ones, until all is stars;
    rounds grow with the logarithm of a component. Hubs are aggregated or joined, never gathered.
    """
    edges, before = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
