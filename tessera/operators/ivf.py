"""An inverted-file index over vectors: many queries against many rows without meeting all of them.

Centres are fitted on a bounded sample (``SAMPLE`` vectors, by a hash of their ids) and every row goes to the list of
its nearest centre. Lists lie on the shared folder as Parquet, one folder a list; a list with very many rows
is spread over several parts. A query looks into the lists of its nearest centres. How many is measured:
``fit_probes`` compares with the exact search on a bounded sample of queries and doubles the
number until the wanted share of true neighbours is found; with all lists the search is exact.

Queries meet rows by (list, part), blocks of queries at a time; a block keeps k candidates a query, and only those
travel on. With about as many lists as the square root of the rows, n rows and a share of n as
queries cost n^1.5 products, not n^2. Vectors of no length are like no query (score 0) and go to list 0; null
vectors and queries are left out; ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import top_k_many

#: Vectors that centres are fitted on, rounds of the fit, most lists; rows of a part and queries of a block.
SAMPLE, ROUNDS, LISTS, PART_ROWS, BLOCK_QUERIES = 20_000, 12, 4096, 8192, 1024
#: Queries that recall is measured on, and the share of true neighbours aimed at.
ASKED, RECALL = 100, 0.95
#: Scores that are held at once (8 MB).
SCORES = 1_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """Runs of rows whose scores with ``columns`` others are about ``SCORES`` numbers."""
    step = max(1, SCORES // max(1, columns))
    return (slice(low, low + step) for low in range(0, rows, step))


def fit_centres(vectors: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Directions that the vectors gather around; empty ones are begun anew at the vectors least like their own."""
    x, rng = unit(vectors), np.random.default_rng(seed)
    if not len(x):
        return x
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    own, best = np.zeros(len(x), "i8"), np.zeros(len(x))
    for _ in range(ROUNDS):
        for some in _slices(len(x), len(centres)):
            scores = x[some] @ centres.T
            own[some], best[some] = scores.argmax(1), scores.max(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        centres = unit(total)
        centres[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
    return centres


class Index:
    """Written lists of (id, vector) and their centres."""

    def __init__(self, items: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS):
        spark = items.sparkSession
        rows = items.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        n = rows.count()
        self.lists = lists or max(1, min(LISTS, math.isqrt(n)))
        some = rows.select("id", F.xxhash64("id").alias("at")).orderBy("at", "id").limit(sample)
        learn = rows.join(F.broadcast(some.select("id")), "id", "left_semi").orderBy("id").limit(sample).select("vector").toPandas()  # ``sample`` vectors at most
        self.centres = fit_centres(np.array(learn["vector"].tolist(), "f8").reshape(len(learn), -1), self.lists) if len(learn) else np.zeros((0, 0))
        self.lists = max(1, len(self.centres))
        placed = rows.mapInArrow(self._place(1), "id " + rows.schema["id"].dataType.simpleString() + ", vector array<double>, list int")
        placed.write.parquet(f"{path}/placed")
        placed = spark.read.parquet(f"{path}/placed")
        parts = placed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).alias("parts"))  # a row a list, LISTS at most
        dealt = placed.join(F.broadcast(parts), "list").select("id", "vector", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        dealt.repartition("list", "part").write.partitionBy("list").parquet(f"{path}/lists")
        self.parts = parts
        self.rows = spark.read.schema("id " + rows.schema["id"].dataType.simpleString() + ", vector array<double>, part int, list int").parquet(f"{path}/lists")
        self.probes = self.lists

    def _place(self, probes: int):
        """Rows (id, vector) with the lists of the ``probes`` nearest centres, a row for each."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in _slices(len(batch), max(512, len(centres), 64 * probes)):  # a vector goes out for each probe
                    piece = batch.slice(some.start, some.stop - some.start)
                    x = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)
                    scores = unit(x) @ centres.T if len(centres) else np.zeros((len(piece), 1))
                    near = scores.argmax(1)[:, None] if probes == 1 else np.argpartition(-scores, min(probes, scores.shape[1]) - 1, axis=1)[:, :probes]
                    at = pa.array(np.repeat(np.arange(len(piece)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(1).take(at), pa.array(near.ravel(), pa.int32())], names=["id", "vector", "list"])

        return run

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) of the ``k`` best rows for each of ``queries`` (query_id, query), from the lists of its nearest centres."""
        asked = queries.select(F.col("query_id").alias("id"), F.col("query").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        q_type, id_type = asked.schema["id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()
        near = asked.mapInArrow(self._place(min(probes or self.probes, self.lists)), f"id {q_type}, vector array<double>, list int")
        blocks = near.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))  # a row a list
        near = near.join(F.broadcast(blocks), "list").join(F.broadcast(self.parts), "list")
        left = near.select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.col("id").alias("query_id"), F.col("vector").alias("query"))
        right = self.rows.join(F.broadcast(blocks), "list").select("list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "id", "vector")

        def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": q["query_id"][:0], "id": r["id"][:0], "score": np.zeros(0)})
            r = r.sort_values("id", kind="stable")
            items, asks, ids, out = unit(np.array(r["vector"].tolist(), "f8")), q["query_id"].to_numpy(), r["id"].to_numpy(), []
            for some in _slices(len(q), len(r)):
                scores = unit(np.array(q["query"][some].tolist(), "f8")) @ items.T
                least = np.partition(scores, len(r) - min(k, len(r)), axis=1)[:, [len(r) - min(k, len(r))]]
                i, j = np.nonzero(scores >= least - 1e-12)
                score = np.round(scores[i, j], 12)  # equal vectors may differ in the last bits
                order = np.lexsort((j, -score, i))  # of equal ones the first ids
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"query_id": asks[some][i[keep]], "id": ids[j[keep]], "score": score[keep]}))
            return pd.concat(out)

        key = ["list", "part", "block"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, f"query_id {q_type}, id {id_type}, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int, probes: int | None = None, asked: int = ASKED) -> float:
        """The share of the exact ``k`` best that ``search`` finds, on up to ``asked`` of the queries by a hash of their ids; 1 without any."""
        some = queries.select("query_id", "query").where("query IS NOT NULL").orderBy(F.xxhash64("query_id"), "query_id").limit(asked)
        exact = top_k_many(self.rows, some, k, "id", "vector").select("query_id", "id")
        held = exact.join(self.search(some, k, probes).select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
        n, found = held.agg(F.count("*"), F.count("found")).first()
        return found / n if n else 1.0

    def fit_probes(self, queries: DataFrame, k: int, least: float = RECALL, asked: int = ASKED) -> float:
        """Sets the number of lists that a search looks into to the first power of two that reaches ``least``; returns the recall it has."""
        self.probes = 1
        while (now := self.recall(queries, k, asked=asked)) < least and self.probes < self.lists:
            self.probes = min(self.lists, 2 * self.probes)
        return now
