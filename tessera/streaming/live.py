"""Streams: incremental indexing, upserts, quotas with state, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.sessions import upsert


def index_directory(spark: SparkSession, source: str, schema: str, out: str, state: str, size: int = 2000, overlap: int = 200, kind: str = "paragraphs"):
    """Chunks every new Parquet file of ``source`` into ``out``, once; the checkpoint in ``state`` knows what is done. Runs until nothing is left."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = chunking.chunk_documents(batch, size=size, overlap=overlap, kind=kind)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def merge_stream(stream: DataFrame, path: str, state: str, key: list[str], version: str, read: Callable[[SparkSession, str], DataFrame | None]):
    """Keeps a table of the latest row a key: each batch makes a new generation of the table at ``path/<number>``."""

    def write(batch: DataFrame, number: int) -> None:
        old = read(batch.sparkSession, f"{path}/{number - 1}") if number else None
        if number and old is None:
            raise FileNotFoundError(f"generation {number - 1} of {path} is gone; only the first batch has none before it")
        new = batch if old is None else upsert(old, batch, key, version)
        upsert(new.limit(0), new, key, version).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest_generation(spark: SparkSession, path: str) -> DataFrame | None:
    """A generation of a merged table, if it is there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the first batch has none before it
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def quota_state(limit: int, seconds: float):
    """A state function for calls (key, ts, id): a window starts with the first call after the last has ended; gives (id, accepted)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, ends = state.get if state.exists else (0, float("-inf"))
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "id"], kind="stable")
            out = []
            for at in pdf["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
                if at > ends:
                    used, ends = 0, at + seconds
                out.append(used < limit)
                used += used < limit
            yield pd.DataFrame({"key": [key[0]] * len(out), "id": pdf["id"], "accepted": out})
        state.update((used, ends))

    return step


def quota_stream(calls: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(key, id, accepted) of a stream of calls (key, ts, id), with one small state a key."""
    return calls.groupBy("key").applyInPandasWithState(quota_state(limit, seconds), "key string, id long, accepted boolean", "used int, ends double", "append", "NoTimeout")


def counts_by_window(events: DataFrame, ts: str, by: str, late: str = "10 minutes", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums in event-time windows; later rows than the watermark are left out."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Which status may follow which.
TRANSITIONS = {"pending": ("running",), "running": ("completed", "failed"), "failed": ("running",), "completed": ()}


def replay_status(changes: DataFrame, key: str = "doc_id", order: str = "ts") -> DataFrame:
    """(key, status, broken): the last status a document, 'failed' if it was left running, and how many steps were not allowed."""
    from pyspark.sql import Window as W

    before = F.lag("status").over(W.partitionBy(key).orderBy(order))
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    rows = changes.withColumn("broken", before.isNotNull() & ~F.coalesce(F.array_contains(allowed[before], F.col("status")), F.lit(False)))
    last = F.max_by("status", order)
    return rows.groupBy(key).agg(F.when(last == "running", "failed").otherwise(last).alias("status"), F.count_if("broken").alias("broken"))
