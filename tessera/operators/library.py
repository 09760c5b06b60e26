"""The register of indexed documents and the files of their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETED, FAILED = "completed", "failed"
ENTRY = "doc_id string, name string, file_path string, status string, model_name string, chunks_count int, entities_count int, progress double, message string, created_at double, started_at double, completed_at double, completed_chunks array<int>"


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a register kept as one JSON object, an entry a document; missing counts are 0, missing texts ''. No entries: no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", f"map<string,struct<{ENTRY}>>"))).alias("d")).select("d.*")
    return whole.fillna(0, ["chunks_count", "entities_count", "progress", "created_at"]).fillna("", ["message"]).withColumn("completed_chunks", F.coalesce("completed_chunks", F.array().cast("array<int>")))


def write_register(rows: DataFrame, path: str) -> None:
    """A line of JSON for each entry, in as many files as ``rows`` has partitions."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def load_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(path)


def without_document(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table (register, chunks, mentions, ...) without the rows of the documents ``gone`` (key)."""
    ids = gone.select(key).distinct()
    return {name: rows.join(ids, key, "left_anti") for name, rows in tables.items()}


def in_completed(rows: DataFrame, register: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents whose indexing is complete, with the document's name."""
    done = register.where(F.col("status") == COMPLETED).select(key, F.col("name").alias("document_name"))
    return rows.join(done, key)


def best_over_documents(found: DataFrame, register: DataFrame, k: int, order: list[str], score: str = "score") -> DataFrame:
    """The ``k`` best hits over all complete documents; ties by ``order``."""
    return in_completed(found, register).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), *order).limit(k)


def global_stats(per_document: DataFrame, register: DataFrame) -> DataFrame:
    """One row over the complete documents: sums of their counts (an entity counts in each document that has it), and the types that occur.

    ``per_document``: doc_id, documents, entities, relations, types.
    """
    rows = in_completed(per_document, register)
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("documents", "entities", "relations")))
    kinds = rows.select(F.explode("types").alias("type")).distinct().agg(F.sort_array(F.collect_list("type")).alias("entity_types"))  # as many as there are types
    return sums.crossJoin(F.broadcast(kinds))  # one row each


def progress(register: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, completed, failed, remaining and the share that is done, in per cent."""
    count = lambda s: F.count_if(F.col(status) == s)
    rows = register.agg(F.count("*").alias("total"), count(COMPLETED).alias("completed"), count(FAILED).alias("failed"))
    done = F.col("completed") + F.col("failed")
    return rows.withColumns({"remaining": F.col("total") - done, "percent": F.when(F.col("total") > 0, done * 100 / F.col("total"))})


def scan_outcome(indexed_before: Column, error: Column) -> Column:
    """What a scan does with a file: ``skipped`` if it is indexed already, else ``errors`` or ``indexed``."""
    return F.when(indexed_before, "skipped").when(error.isNotNull(), "errors").otherwise("indexed")


def scan_summary(files: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: how many files were indexed, skipped and failed."""
    return files.agg(*(F.count_if(F.col(outcome) == kind).alias(kind) for kind in ("indexed", "skipped", "errors")))


def save_index(mentions: DataFrame, relations: DataFrame, path: str, model: str) -> None:
    """The postings (name, type, doc_id) and the relations (source, target, relation, confidence, doc_id) of one model, in place of those before.

    Postings are rows, so a name in very many documents is no large value; a folder for each model.
    """
    postings(mentions).write.mode("overwrite").parquet(f"{path}/model={model}/postings")
    relations.select("source", "target", "relation", "confidence", "doc_id").write.mode("overwrite").parquet(f"{path}/model={model}/relations")


def load_index(spark: SparkSession, path: str, model: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/model={model}/{part}") for part in ("postings", "relations"))


def postings(mentions: DataFrame) -> DataFrame:
    """(name, type, doc_id), distinct; a name has the type that comes first in order of its documents and types."""
    kinds = mentions.groupBy("name").agg(F.min(F.struct("doc_id", "type"))["type"].alias("type"))
    return mentions.select("name", "doc_id").distinct().join(kinds, "name").select("name", "type", "doc_id")
