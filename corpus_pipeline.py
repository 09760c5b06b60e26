"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, benchmark
decontamination, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents`` (whatever these are called), whole texts of any length
included. Empty tables give empty results. ``run`` writes each stage as Parquet to the
shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, quality, sentencepiece_codec, simhash
from tessera.llm.common import documents, save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. Null and empty texts have the score of an empty text; repeated rows share their fate; without labels nothing can be told and nothing is kept."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z alike, null like empty) the row with the largest doc_id; a null doc_id is the smallest, and of several rows with the largest one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, a null one last; texts without words are one group."""
    return simhash.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages; those without words never are, equal rows share their fate."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them; null and empty texts have no ids. Other columns of ``docs`` are left out."""
    out = sentencepiece_codec.encode_decode(docs.select("doc_id", "text"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), "stage")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
