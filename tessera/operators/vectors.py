"""Vector search: exact top-k over one or many collections, reranking, hash embeddings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .sessions import _written


def top_k(items: DataFrame, query, k: int, id_col: str = "id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """The ``k`` rows most like ``query`` (a list of numbers): only ids and vectors are ranked, ties by id."""
    scored = items.withColumn(score, V.cosine(F.col(vector), V.literal(query))).drop(vector)
    return scored.orderBy(F.desc(score), id_col).limit(k)


def top_k_of_found(items: DataFrame, found: DataFrame, query, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best of the rows that a graph search ``found`` (ids), or of all rows if it found none."""
    rows = items if found.isEmpty() else items.join(found, id_col, "left_semi")
    return top_k(rows, query, k, id_col, vector)


def top_k_within(items: DataFrame, query, k: int, by: list[str], id_col: str = "id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each collection. The rank filter becomes a group limit before the shuffle."""
    scored = items.withColumn(score, V.cosine(F.col(vector), V.literal(query))).drop(vector)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_merged(items: DataFrame, query, k: int, by: list[str], id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The best of each collection, then the best of those."""
    return top_k_within(items, query, k, by, id_col, vector).drop("rank").orderBy(F.desc("score"), id_col).limit(k)


def with_ancestors(items: DataFrame, folder: str, category: str = "category") -> DataFrame:
    """A row for each folder above a row's own (``a/b/c``: a, a/b, a/b/c), so that a category holds what its sub-folders hold, however deep. Slashes at the ends and doubled ones say nothing."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return items.withColumn(category, F.explode(F.when(F.size(parts) > 0, above)))


#: Queries of a block, shares that the rows are dealt to for each block, and rows that meet a block at once.
BLOCK_QUERIES, SHARES, BLOCK_ROWS = 16_384, 16, 4096
#: Scores that are held at once (16 MB), and how far below the k-th score a rounding error may put an equal one, as a share of both lengths.
SCORES, SLACK = 2_000_000, 1e-9


def _numbers(vectors: pa.Array) -> np.ndarray:
    lengths = pc.list_value_length(vectors)
    dim = lengths[0].as_py()
    if pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), dim)


class _Best:
    """The queries of a block, and for each the ``k`` best among the rows of one collection that have passed. Rows come in the order of their ids.

    Scores are added up in the order in which ``functions.vectors`` adds them, so they are the same doubles; a matrix
    product only tells which rows need that.
    """

    def __init__(self, names: pa.Array, vectors: np.ndarray, k: int, product: bool, together: int):
        self.names, self.k, self.product = names, k, product
        self.step = max(1, min(together, SCORES // len(names)))
        self.columns, self.length, self.near = self._prepared(vectors)
        self.clear()

    def _prepared(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns, total = np.ascontiguousarray(vectors.T), np.zeros(len(vectors))
        for c in columns:
            total += c * c
        length = np.sqrt(total)
        if self.product:
            return columns, length, vectors
        near = np.divide(vectors, length[:, None], out=np.zeros_like(vectors), where=length[:, None] > 0)
        near[~np.isfinite(length)] = np.nan  # only the exact score can tell
        return columns, length, near

    def clear(self) -> None:
        self.least = np.full(len(self.names), -np.inf)  # the k-th score of a query so far
        self.found, self.pending, self.passed = [], 0, 0

    def meet(self, ids: pa.Array, vectors: np.ndarray) -> None:
        for low in range(0, len(ids), self.step):
            self._slice(ids.slice(low, self.step), *self._prepared(vectors[low : low + self.step]))

    def _slice(self, ids: pa.Array, columns: np.ndarray, length: np.ndarray, near: np.ndarray) -> None:
        scores, least, slack = self.near @ near.T, self.least, SLACK
        if self.product:
            slack = np.nan_to_num(SLACK * self.length * length.max(), nan=0, posinf=0)
        if len(ids) > self.k and np.isneginf(least).any():
            at, unknown = len(ids) - self.k, np.isnan(scores)
            sure = np.where(unknown, -np.inf, scores) if unknown.any() else scores
            least = np.maximum(least, np.partition(sure, at, axis=1)[:, at])
        i, j = np.nonzero(~(scores < (least - slack)[:, None]))
        exact = np.zeros(len(i))
        for q, r in zip(self.columns, columns, strict=True):
            exact += q[i] * r[j]
        if not self.product:
            both = self.length[i] * length[j]
            exact = np.divide(exact, both, out=np.zeros_like(exact), where=both != 0)
        self.found.append((i, self.passed + j, exact, ids.take(pa.array(j))))
        self.passed += len(ids)
        self.pending += len(i)
        if self.pending >= len(self.names) * self.k:
            self._settle()

    def _settle(self) -> None:
        i, row, score = (np.concatenate([f[c] for f in self.found]) for c in range(3))
        ids = pa.concat_arrays([f[3] for f in self.found])
        height = np.where(np.isnan(score), np.inf, np.minimum(score, np.finfo("f8").max))  # as Spark orders them
        order = np.lexsort((row, -height, i))
        order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < self.k]
        i = i[order]
        self.found, self.pending = [(i, row[order], score[order], ids.take(pa.array(order)))], 0
        n = np.bincount(i, minlength=len(self.names))
        full = n == self.k
        self.least[full] = height[order][np.cumsum(n)[full] - 1]

    def best(self, by: list[pa.Array]) -> list[pa.Array]:
        """Columns (query, id, *by, score) of what was found; ``by``: the collection, an array of one value each."""
        self._settle()
        i, _, score, ids = self.found[0]
        self.clear()
        return [self.names.take(pa.array(i)), ids, *(v.take(pa.array(np.zeros(len(i), "i8"))) for v in by), pa.array(score)]


def _passing(k: int, by: list[str], product: bool, together: int, names: list[str]):
    """Rows of (_block, _kind, query_id, _vector, id, *by), ordered by block, kind, collection and id: the queries of a block are held, its rows pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, held, last = None, [], None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_block", "_kind", *by)), strict=True))
            for now, run in itertools.groupby(range(len(keys)), keys.__getitem__):
                at = list(run)
                piece = batch.slice(at[0], len(at))
                if held and now != key:
                    yield pa.RecordBatch.from_arrays(held.best(last), names=names)
                if key is None or now[0] != key[0]:
                    asked, held = [], None
                key = now
                vectors = _numbers(piece.column("_vector"))
                if now[1] == 0:
                    asked.append((piece.column("query_id"), vectors))
                elif asked:
                    held = held or _Best(pa.concat_arrays([a for a, _ in asked]), np.concatenate([v for _, v in asked]), k, product, together)
                    held.meet(piece.column(names[1]), vectors)
                    last = [piece.column(c).slice(0, 1) for c in by]
        if held:
            yield pa.RecordBatch.from_arrays(held.best(last), names=names)

    return run


def top_k_many(items: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", by: list[str] = (), score: str = "score", product: bool = False) -> DataFrame:
    """(query_id, id, *by, score, rank): for each row of ``queries`` (query_id, query) its ``k`` best rows, of each ``by``; ties by id.

    Each block of queries meets the rows in ``SHARES`` shares. A task holds one block and lets its share pass; only
    the ``k`` best of a share leave it, with their exact scores. So the rows travel once for every ``BLOCK_QUERIES``
    queries, the queries and what is found ``SHARES`` times, however many rows there are. Of equal vectors only the k first ids
    can count. Null vectors, and those with a null in them, have no score and are left out. ``product``: by inner product.
    """
    by = list(by)
    wide = {items.schema[vector].dataType.simpleString(), queries.schema["query"].dataType.simpleString()} != {"array<float>"}

    def whole(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(~F.exists(name, F.isnull))
        return rows.withColumn(name, V.doubles(F.col(name))) if wide else rows

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked, rows = whole(queries.select("query_id", "query"), "query"), whole(items.select(id_col, *by, vector), vector)
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    order = F.row_number().over(W.partitionBy(*by, vector).orderBy(id_col))
    rows = rows.withColumn("_copy", order).where(F.col("_copy") <= k)
    left = asked.withColumn("_share", each(SHARES)).withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    right = rows.withColumn("_q", each(blocks)).withColumn("_share", F.pmod(F.xxhash64(id_col), F.lit(SHARES)))
    block = (F.col("_q") * SHARES + F.col("_share")).cast("int").alias("_block")
    left = left.select(block, F.lit(0).alias("_kind"), "query_id", F.col("query").alias("_vector"))
    right = right.select(block, F.lit(1).alias("_kind"), F.col(vector).alias("_vector"), id_col, *by)
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(blocks * SHARES, "_block").sortWithinPartitions("_block", "_kind", *by, id_col)
    fields = [queries.schema["query_id"], *(items.schema[c] for c in (id_col, *by)), T.StructField(score, T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    scored = dealt.mapInArrow(_passing(k, by, product, BLOCK_ROWS, schema.names), schema)
    rank = F.row_number().over(W.partitionBy("query_id", *by).orderBy(F.desc(score), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dense(bins: DataFrame, id_col: str, dim: int = 384) -> DataFrame:
    """(id, vector): sparse rows (id, bin, weight) as vectors of ``dim`` numbers."""
    held = bins.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"))  # ``dim`` entries at most
    return held.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def hash_similarity_many(bins: DataFrame, queries: DataFrame, id_col: str, k: int, dim: int = 384) -> DataFrame:
    """(query_id, id, score, rank): cosine of sparse hash embeddings to every query's (query_id, bin, weight), the ``k`` best of each that share a bin with it.

    Weights are not negative, so rows that share a bin are those whose score is not 0. As dense vectors, in blocks.
    """
    asked = _written(dense(queries, "query_id", dim).withColumnRenamed("vector", "query"))
    return top_k_many(_written(dense(bins, id_col, dim)), asked, k, id_col, "vector").where("score > 0")


def rerank(candidates: DataFrame, vectors: DataFrame, query, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Candidates by similarity; those without a vector score 0. Without a query all score 1, in order of id."""
    if query is None:
        return candidates.withColumn("score", F.lit(1.0)).orderBy(id_col).limit(k)
    joined = candidates.join(vectors.select(id_col, vector), id_col, "left")
    scored = joined.withColumn("score", F.coalesce(V.cosine(F.col(vector), V.literal(query)), F.lit(0.0))).drop(vector)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def rerank_many(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the candidates by similarity to each query; those without a vector score 0, so only their k first ids can count."""
    held = vectors.select(id_col, vector).where(F.col(vector).isNotNull())
    found = top_k_many(held.join(candidates, id_col, "left_semi"), queries, k, id_col, vector).drop("rank")
    bare = candidates.select(id_col).join(held, id_col, "left_anti").orderBy(id_col).limit(k)
    rest = queries.where("query IS NOT NULL").select("query_id").crossJoin(F.broadcast(bare)).withColumn("score", F.lit(0.0))  # k rows
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)


def inner_product_order(items: DataFrame, query, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """By inner product, with the score 1 / (1 + product) that a flat index reports."""
    product = V.dot(F.col(vector), V.literal(query))
    return items.withColumn("product", product).drop(vector).orderBy(F.desc("product"), id_col).limit(k).withColumn("score", 1 / (1 + F.col("product")))


def hash_bins(texts: DataFrame, id_col: str, text: str, dim: int = 384) -> DataFrame:
    """(id, bin, weight): character 1- and 2-grams hashed and summed by bin."""
    grams = texts.select(id_col, F.explode(V.char_grams(F.col(text))).alias("gram"))
    per_gram = grams.groupBy(id_col, "gram").count()  # each distinct gram is hashed once a text
    return per_gram.groupBy(id_col, V.gram_bin(F.col("gram"), dim).alias("bin")).agg(F.sum(V.gram_weight(F.col("gram")) * F.col("count")).alias("weight"))


def hash_similarity(bins: DataFrame, query_bins: DataFrame, id_col: str) -> DataFrame:
    """Cosine of sparse hash embeddings to one query's (id, bin, weight), by an equi-join on the bin."""
    norms = bins.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    q = query_bins.select("bin", F.col("weight").alias("q"))
    q_norm = query_bins.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    dots = bins.join(q, "bin").groupBy(id_col).agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    length = F.col("norm") * F.col("q_norm")
    return dots.join(norms, id_col).crossJoin(F.broadcast(q_norm)).select(id_col, F.when(length == 0, 0.0).otherwise(F.col("dot") / length).alias("score"))  # one row


def collection_stats(items: DataFrame, by: str, vector: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("dims"))


def pair_similarity(a: Column, b: Column) -> Column:
    return V.cosine(a, b)
