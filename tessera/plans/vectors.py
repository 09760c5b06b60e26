"""Queries over vectors. The query vector is that of vec_id 0; the forms named _many ask with every vec_id divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ivf
from ..operators import vectors as O
from .base import folder, query, table

SCORED = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) AS score FROM embeddings, q)"


def vector_of(spark, sf, vec_id: int = 0):
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0]


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(f"{SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    return _rounded(O.top_k(table(spark, sf, "embeddings"), vector_of(spark, sf), 10, "vec_id"))


@query(f"{SCORED} SELECT vec_id, label, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def vector_topk_per_collection(spark, sf):
    return _rounded(O.top_k_within(table(spark, sf, "embeddings"), vector_of(spark, sf), 5, ["label"], "vec_id"))


@query(f"{SCORED} SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 5 ORDER BY t.score DESC, vec_id LIMIT 5")
def vector_topk_merged(spark, sf):
    return _rounded(O.top_k_merged(table(spark, sf, "embeddings"), vector_of(spark, sf), 5, ["label"], "vec_id"))


@query(f"{SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label IN (1, 3, 5) ORDER BY s.score DESC, vec_id LIMIT 10")
def category_search(spark, sf):
    return _rounded(O.top_k(table(spark, sf, "embeddings").where(F.col("label").isin(1, 3, 5)), vector_of(spark, sf), 10, "vec_id"))


@query(f"{SCORED} SELECT vec_id, round(1 - (1 - score), 6) AS score, round(1 - score, 6) AS distance FROM s ORDER BY s.score DESC, vec_id LIMIT 5")
def collection_query(spark, sf):
    hits = O.top_k(table(spark, sf, "embeddings"), vector_of(spark, sf), 5, "vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"), F.round(1 - F.col("score"), 6).alias("distance"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS p FROM embeddings, q) SELECT vec_id, round(p, 6) AS product, round(1 / (1 + p), 6) AS score FROM s ORDER BY p DESC, vec_id LIMIT 5")
def inner_product_search(spark, sf):
    hits = O.inner_product_order(table(spark, sf, "embeddings").select("vec_id", "embedding"), vector_of(spark, sf), 5, "vec_id")
    return hits.select("vec_id", F.round("product", 6).alias("product"), F.round("score", 6).alias("score"))


@query("SELECT label, count(*) AS n, CAST(min(len(embedding)) AS INT) AS dims FROM embeddings GROUP BY label")
def collection_stats(spark, sf):
    return O.collection_stats(table(spark, sf, "embeddings"), "label", "embedding")


@query(f"{SCORED}, c AS (SELECT DISTINCT l_partkey AS vec_id FROM lineitem) SELECT c.vec_id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN s USING (vec_id) ORDER BY coalesce(s.score, 0) DESC, c.vec_id LIMIT 20")
def rerank_candidates(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vec_id")).distinct()
    return _rounded(O.rerank(c, table(spark, sf, "embeddings"), vector_of(spark, sf), 20, "vec_id"))


@query(f"{SCORED}, e AS (SELECT DISTINCT l_partkey % 500 AS vec_id FROM lineitem WHERE l_orderkey = -1) SELECT vec_id, round(score, 6) AS score FROM s WHERE (SELECT count(*) FROM e) = 0 OR vec_id IN (SELECT vec_id FROM e) ORDER BY s.score DESC, vec_id LIMIT 5")
def hybrid_fallback(spark, sf):
    """Graph candidates if the query has entities, else plain vector search."""
    found = table(spark, sf, "lineitem").where("l_orderkey = -1").select((F.col("l_partkey") % 500).alias("vec_id")).distinct()
    items = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _rounded(O.top_k_of_found(items, found, vector_of(spark, sf), 5, "vec_id"))


@query(f"{SCORED} SELECT 'chunk' AS kind, * FROM (SELECT vec_id, round(score, 6) AS score FROM s WHERE label < 4 ORDER BY s.score DESC, vec_id LIMIT 10) UNION ALL SELECT 'entity', * FROM (SELECT vec_id, round(score, 6) FROM s WHERE label BETWEEN 4 AND 6 ORDER BY s.score DESC, vec_id LIMIT 30) UNION ALL SELECT 'relation', * FROM (SELECT vec_id, round(score, 6) FROM s WHERE label > 6 ORDER BY s.score DESC, vec_id LIMIT 30)")
def dual_retrieval_mix(spark, sf):
    """Entities (local), relations (global) and chunks in one table."""
    items, q = table(spark, sf, "embeddings"), vector_of(spark, sf)
    parts = []
    for kind, cond, k in (("chunk", "label < 4", 10), ("entity", "label BETWEEN 4 AND 6", 30), ("relation", "label > 6", 30)):
        parts.append(O.top_k(items.where(cond), q, k, "vec_id").select(F.lit(kind).alias("kind"), "vec_id", F.round("score", 6).alias("score")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _mod(modulus: int, groups: int) -> str:
    total = "0"
    for i in range(groups):
        total = f"(({total}) * 65536 + CAST('0x' || substr(md5(gram), {4 * i + 1}, 4) AS BIGINT)) % {modulus}"
    return total


GRAMS = "WITH g AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: substr(lower(text), i::INT, 1)), list_transform(range(1, length(text)), lambda i: substr(lower(text), i::INT, 2)))) AS gram FROM benchmark)"
BINS = f"{GRAMS}, c AS (SELECT item_id, gram, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT item_id, CAST({_mod(384, 8)} AS INT) AS bin, sum({_mod(1000, 7)} / 1000e0 * n) AS weight FROM c GROUP BY ALL)"


@query(f"{BINS} SELECT item_id, bin, round(weight, 6) AS weight FROM b")
def hash_embedding_bins(spark, sf):
    return O.hash_bins(table(spark, sf, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query(f"{BINS}, n AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM b GROUP BY item_id), low AS (SELECT min(item_id) AS i FROM benchmark), d AS (SELECT b.item_id, sum(b.weight * q.weight) AS dot FROM b JOIN b q USING (bin) WHERE q.item_id = (SELECT i FROM low) GROUP BY b.item_id) SELECT d.item_id, round(dot / (n.norm * m.norm), 6) AS score FROM d JOIN n USING (item_id) JOIN n m ON m.item_id = (SELECT i FROM low) ORDER BY dot / (n.norm * m.norm) DESC, d.item_id LIMIT 10")
def hash_embedding_topk(spark, sf):
    items = table(spark, sf, "benchmark")
    bins = O.hash_bins(items, "item_id", "text")
    low = items.agg(F.min("item_id")).first()[0]
    scored = O.hash_similarity(bins, bins.where(F.col("item_id") == low), "item_id")
    return _rounded(scored.orderBy(F.desc("score"), "item_id").limit(10))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("score"))


MANY = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, label, list_dot_product(embedding::DOUBLE[], v) AS p, list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) AS score FROM embeddings, q)"""


def _best(k: int, where: str = "true", by: str = "query_id", order: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order} DESC, vec_id) AS rank FROM s WHERE {where} QUALIFY rank <= {k})"


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _many(spark, sf, k: int, where: str = "true", **how):
    return O.top_k_many(table(spark, sf, "embeddings").where(where), _asked(spark, sf), k, "vec_id", **how)


def _labelled(spark, sf, found):
    return found.join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


@query(f"{MANY} SELECT query_id, vec_id, label, round(score, 6) AS score FROM {_best(10)}")
def vector_topk_many(spark, sf):
    return _labelled(spark, sf, _many(spark, sf, 10))


@query(f"{MANY} SELECT query_id, vec_id, label, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {_best(5, by='query_id, label')}")
def vector_topk_per_collection_many(spark, sf):
    return _rounded(_many(spark, sf, 5, by=["label"])).select("query_id", "vec_id", "label", "score", "rank")


@query(f"{MANY} SELECT query_id, vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM {_best(5, by='query_id, label')}) WHERE r <= 5")
def vector_topk_merged_many(spark, sf):
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = _many(spark, sf, 5, by=["label"]).withColumn("rank", rank).where("rank <= 5")
    return _rounded(best).select("query_id", "vec_id", "label", "score")


@query(f"{MANY} SELECT query_id, vec_id, label, round(score, 6) AS score FROM {_best(10, 'label IN (1, 3, 5)')}")
def category_search_many(spark, sf):
    return _labelled(spark, sf, _many(spark, sf, 10, "label IN (1, 3, 5)"))


@query(f"{MANY} SELECT query_id, vec_id, round(1 - (1 - score), 6) AS score, round(1 - score, 6) AS distance FROM {_best(5)}")
def collection_query_many(spark, sf):
    return _many(spark, sf, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.round(1 - F.col("score"), 6).alias("distance"))


@query(f"{MANY} SELECT query_id, vec_id, round(p, 6) AS product, round(1 / (1 + p), 6) AS score FROM {_best(5, order='p')}")
def inner_product_search_many(spark, sf):
    found = _many(spark, sf, 5, score="product", product=True)
    return found.select("query_id", "vec_id", F.round("product", 6).alias("product"), F.round(1 / (1 + F.col("product")), 6).alias("score"))


@query(f"{MANY} SELECT 'chunk' AS kind, query_id, vec_id, round(score, 6) AS score FROM {_best(10, 'label < 4')} UNION ALL SELECT 'entity', query_id, vec_id, round(score, 6) FROM {_best(30, 'label BETWEEN 4 AND 6')} UNION ALL SELECT 'relation', query_id, vec_id, round(score, 6) FROM {_best(30, 'label > 6')}")
def dual_retrieval_mix_many(spark, sf):
    parts = []
    for kind, cond, k in (("chunk", "label < 4", 10), ("entity", "label BETWEEN 4 AND 6", 30), ("relation", "label > 6", 30)):
        parts.append(_many(spark, sf, k, cond).select(F.lit(kind).alias("kind"), "query_id", "vec_id", F.round("score", 6).alias("score")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{BINS}, n AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM b GROUP BY item_id), d AS (SELECT q.item_id AS query_id, b.item_id, sum(b.weight * q.weight) AS dot FROM b JOIN b q USING (bin) WHERE q.item_id % 20 = 0 GROUP BY ALL), r AS (SELECT query_id, d.item_id, dot / (n.norm * m.norm) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot / (n.norm * m.norm) DESC, d.item_id) AS rank FROM d JOIN n USING (item_id) JOIN n m ON m.item_id = query_id) SELECT query_id, item_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def hash_embedding_topk_many(spark, sf):
    bins = O.hash_bins(table(spark, sf, "benchmark"), "item_id", "text")
    asked = bins.where(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id")
    return _rounded(O.hash_similarity_many(bins, asked, "item_id", 10)).select("query_id", "item_id", "score")


@query(f"{MANY}, c AS (SELECT DISTINCT l_partkey AS vec_id FROM lineitem), a AS (SELECT query_id, c.vec_id, coalesce(s.score, 0) AS score FROM c CROSS JOIN (SELECT query_id FROM q) LEFT JOIN s USING (query_id, vec_id)) SELECT query_id, vec_id, round(score, 6) AS score FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a.score DESC, vec_id) <= 20")
def rerank_candidates_many(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vec_id")).distinct()
    return _rounded(O.rerank_many(c, table(spark, sf, "embeddings"), _asked(spark, sf), 20, "vec_id")).select("query_id", "vec_id", "score")


@query()
def vector_index_topk(spark, sf):
    """The ten best for every vec_id divisible by 20 through an inverted-file index of all vectors; its probes are fitted to a recall of 0.95."""
    index = ivf.Index(table(spark, sf, "embeddings"), folder(spark, "ivf"), "vec_id")
    index.fit_probes(_asked(spark, sf), 10)
    return index.search(_asked(spark, sf), 10).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


TREE = "'lib/' || (label % 2) || '/' || label || '/' || (vec_id % 3)"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, string_split({TREE}, '/') AS p FROM embeddings), q AS (SELECT e AS v FROM v WHERE vec_id = 0),
a AS (SELECT vec_id, e, array_to_string(p[1:i], '/') AS category FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM v)),
s AS (SELECT category, vec_id, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) AS score FROM a, q)
SELECT category, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY category ORDER BY s.score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def category_tree_search(spark, sf):
    """The five best of every folder, with all below it."""
    tree = F.concat(F.lit("lib/"), (F.col("label") % 2).cast("string"), F.lit("/"), F.col("label").cast("string"), F.lit("/"), (F.col("vec_id") % 3).cast("string"))
    items = O.with_ancestors(table(spark, sf, "embeddings").withColumn("folder", tree), "folder")
    return _rounded(O.top_k_within(items, vector_of(spark, sf, 0), 5, ["category"], "vec_id")).select("category", "vec_id", "score", "rank")
