"""What the operators of this subpackage share: shared folders, written tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once inside a task.
CHUNK_CHARS = 2_000_000
#: The same where all work on it is array passes.
BATCH_CHARS = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, a new one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_texts(df: DataFrame, text: str, out: list[tuple[str, str]], setup: Callable[[], Callable[[list[str]], list[list]]], arrow_text: bool = False) -> DataFrame:
    """Add the columns ``out`` (name, Spark type) to ``df``, made from its text column in tasks.

    ``setup`` runs once a task and gives a function from a list of texts (null: ''), or with
    ``arrow_text`` an Arrow column, to a list of columns. Texts come whole, in runs of about
    ``CHUNK_CHARS`` characters (``BATCH_CHARS`` in Arrow columns), whatever their length.
    """
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in out)])
    arrow = to_arrow_schema(schema)
    at = df.columns.index(text)
    new = [arrow.field(i) for i in range(len(df.columns), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for piece in slices(batch, at, BATCH_CHARS if arrow_text else CHUNK_CHARS):
                texts = pc.fill_null(piece.column(at), "")
                cols = work(texts if arrow_text else texts.to_pylist())
                made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.cast(pa.schema(list(arrow)[: len(piece.schema)])).columns, *made], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with about ``most`` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The slices of ``batch``, each with its texts (null: '')."""
    for part in slices(batch, at):
        yield part, [t or "" for t in part.column(at).to_pylist()]
