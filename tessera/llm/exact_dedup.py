"""Exact deduplication by an extendible-hash index on shared files (operator 1).

Columns and SQL functions only: no Python runs on the executors.

1. Entries: every row leaves (rid, doc_id, hash) in a file of the shared folder.
2. Directory: the key counts of 2^16 hash prefixes (a table of fixed size) decide the depth. It
   starts with one bucket; a bucket over capacity splits by one more bit, and the directory doubles
   when the bucket is as deep as the directory. Buckets end as disjoint ranges of the key.
3. Owner tasks get contiguous key ranges with their texts and decide there, from the bytes of the
   text, which rows are equal, which of them stays and how many there are. Different texts of one key
   become links of its chain. Keys with very many rows are combined in the tasks that read them
   before they travel; fewer than ``HOT_KEYS`` keys can be as frequent, so their list may be broadcast.
4. The index (bucket, hash, chain, ...) is written in key order. No digest takes part in a decision.
5. Entries look up their link through the directory: slot, bucket, hash, and where a key has a chain
   of several links, the bytes of the text. The few very large classes (fewer than ``LARGE_CLASSES``)
   are looked up by broadcast, so no task gets the rows of one large group.

Equality is that of the normalised text: A-Z to a-z, nothing else. Null counts as empty. Of equal
texts the row with the largest doc_id stays, a null doc_id counting as the smallest; if that doc_id
is there more than once, one of its rows stays. Empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, free_name, save

PREFIX_BITS = 16
BUCKET_KEYS = 4096
#: Most buckets that the capacity aims at, whatever the number of keys.
BUCKETS = 16_384
#: A key is hot if it has over a millionth of all rows (and 1,000 rows), so there are fewer of them than this.
HOT_KEYS = 1_000_000
#: A class is large if it holds over a ten-thousandth of all rows (and 1,000 rows), so there are fewer of them than this.
LARGE_CLASSES = 10_000
LEAST_ROWS = 1000


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def directory(prefix_counts: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Extendible hashing over counted prefixes: the global depth and the buckets (prefix, local depth) in key order."""
    levels = [dict(prefix_counts)]  # counts by prefix, from the deepest up
    for _ in range(PREFIX_BITS):
        up: dict[int, int] = {}
        for p, n in levels[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        levels.append(up)
    depth, buckets, todo = 0, [], [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        if local < PREFIX_BITS and levels[PREFIX_BITS - local].get(prefix, 0) > capacity:
            depth = max(depth, local + 1)  # the directory doubles
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            buckets.append((prefix, local))
    return depth, buckets


def _slot(depth: int) -> F.Column:
    return F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)


def digest(norm) -> F.Column:
    return F.sha2(norm, 256)


class Index:
    """The index of one table: its files and the way to look rows up."""

    def __init__(self, docs: DataFrame, key=F.xxhash64, capacity: int = BUCKET_KEYS):
        """``docs``: rid (unique, the same whenever the table is read), doc_id, text. ``key`` hashes the normalised text to a long."""
        spark = docs.sparkSession
        rows = docs.select("rid", "doc_id", normalised(F.col("text")).alias("norm"))
        self.rows = rows.withColumn("hash", key(F.col("norm")))
        self.entries = save(self.rows.select("rid", "doc_id", "hash"), "entries")
        keys = save(self.entries.groupBy("hash").agg(F.count("*").alias("n")), "keys")

        prefixes = keys.groupBy(F.shiftrightunsigned("hash", 64 - PREFIX_BITS).cast("int").alias("prefix")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))
        held = prefixes.collect()  # 2^16 rows at most
        counts, total = {r.prefix: r["keys"] for r in held}, sum(r.rows for r in held)
        self.depth, self.buckets = directory(counts, max(capacity, sum(counts.values()) // BUCKETS))
        owners = min(len(self.buckets), int(spark.conf.get("spark.sql.shuffle.partitions")))
        slots = [(s, b, b * owners // len(self.buckets)) for b, (p, d) in enumerate(self.buckets) for s in range(p << (self.depth - d), (p + 1) << (self.depth - d))]
        self.directory = spark.createDataFrame(slots, "slot int, bucket int, owner int")  # 2^16 rows at most
        self.large = max(LEAST_ROWS, total // LARGE_CLASSES)

        hot = F.broadcast(keys.where(F.col("n") > max(LEAST_ROWS, total // HOT_KEYS)).select("hash", F.lit(True).alias("hot")))
        texts = self._placed(self.rows).join(hot, "hash", "left")
        stays = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid")).alias("stays")
        facts = [stays, F.count("*").alias("group_size")]
        cold = texts.where(F.col("hot").isNull()).repartition(owners, "owner").groupBy("owner", "bucket", "hash", "norm").agg(*facts).drop("owner")
        warm = texts.where("hot").groupBy("bucket", "hash", "norm").agg(*facts)
        links = cold.unionByName(warm).select("bucket", "hash", F.col("stays.doc_id").alias("keep_id"), F.col("stays.rid").alias("keep_rid"), "group_size", digest(F.col("norm")).alias("text_sha256"))
        own = W.partitionBy("bucket", "hash")
        chained = links.select("bucket", "hash", F.row_number().over(own.orderBy("keep_rid")).alias("chain"), F.count("*").over(own).alias("chain_size"), "keep_id", "keep_rid", "group_size", "text_sha256")
        self.table = save(chained.sortWithinPartitions("bucket", "hash", "chain"), "index")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (hash, ...) with bucket and owner, by their slot of the directory."""
        return rows.join(F.broadcast(self.directory), _slot(self.depth) == F.col("slot")).drop("slot")

    def look_up(self) -> DataFrame:
        """rid, doc_id, bucket, hash and the link of every entry."""
        at, cols = ["bucket", "hash"], ["rid", "doc_id", *self.table.columns]
        entries = self._placed(self.entries).drop("owner")
        single = self.table.where("chain_size = 1")
        large = F.col("group_size") > self.large
        first = entries.join(F.broadcast(single.where(large)), at, "left")
        found = first.where("chain IS NOT NULL").select(*cols)
        rest = first.where("chain IS NULL").select(*entries.columns)
        found = found.unionByName(rest.join(single.where(~large), at).select(*cols))
        several = self.table.where("chain_size > 1")
        if not several.limit(1).count():
            return found
        keys = several.select(*at).distinct()
        texts = self._placed(self.rows).drop("owner").join(keys, at, "left_semi")
        links = several.join(texts.select(F.col("rid").alias("keep_rid"), "norm"), "keep_rid")
        return found.unionByName(texts.join(links, [*at, "norm"]).select(*cols))  # by bytes


def mark(docs: DataFrame, key=F.xxhash64, capacity: int = BUCKET_KEYS, stored: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``stored``: ``docs`` is read straight from Parquet files, whose rows are known by their place there; else it is written first.
    """
    rid = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")) if stored else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), "doc_id", "text")
    found = Index(rows if stored else save(rows, "rows"), key, capacity).look_up()
    return found.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, of equal texts one row."""
    rid = free_name(docs, "rid")
    held = save(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    index = Index(held.select(F.col(rid).alias("rid"), "doc_id", "text"))
    kept = index.table.select(F.col("keep_rid").alias(rid))
    return held.join(kept, rid, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir), stored=True)


SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
