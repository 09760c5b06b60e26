"""Token ids in seekable binary files (operator 8).

A file is a row of independent zstandard frames, one for each document in ascending doc_id order,
then a skippable frame with the document ids, then the seek table of the public zstandard seekable
format (sizes and a checksum of every frame). A reader takes the table from the end of the file,
and fetches, verifies and decompresses the frames of the documents asked for, nothing else.
Any zstandard decoder reads the files too.

    frame          ids of one document, little-endian, 2 bytes each if the vocabulary allows, else 4
    skippable      0x184D2A50, size, JSON header line, null flags (1 byte each), doc_ids (int64 each)
    skippable      0x184D2A5E, size, (compressed size, size, low half of XXH64) each, then the footer:
                   number of frames, descriptor 0x80, 0x8F92EAB1

Work: tasks encode, ids travel once to the task that owns their range of doc_id (bounds from a
quantile sketch over the ids alone), owners sort and write. Only file names and totals reach the
driver, a row for each file. A task that runs again writes under a new name and the manifest names
the file that counts.

Results for odd inputs: a null or empty text has just the end id; null doc_ids come first; rows of
equal doc_id stand side by side in the order of their ids, or, if they fill several files, of a hash of
these; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .common import BATCH_CHARS, documents, fresh_path, slices

END_ID = 2
#: Bytes of text that a file holds at most, on average.
FILE_TEXT = 1 << 30
#: Where null doc_ids are sorted.
NULL_ID = -(1 << 63)
HEADER_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_encoders: dict[str, Encoder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's tokenizer behind a bounded memo of segments (``segments.Memo``).

    Texts with the literal of an added token go to the library whole, where it is that token.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.literals = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.type = "<u4" if self.model.get_vocab_size() > 1 << 16 else "<u2"
        vocabulary = self.model.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, "i8")
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character a byte in this vocabulary
        for i, token in self.model.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode())
        shape = json.loads(self.model.to_str())
        before = shape["pre_tokenizer"] or {}
        if shape["normalizer"] is not None or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: segments are those of a byte-level tokenizer that does not normalise")
        self.memo = segments.Memo(self._library)

    def _library(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each segment. The library takes them in lists of ready-made words; tokens cover the bytes of a list without gaps, so their lengths tell where each word ends."""
        out: list[bytes] = []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            (e,) = self.model.encode_batch_fast([[p.decode() for p in some]], is_pretokenized=True, add_special_tokens=False)
            ids, stops = np.array(e.ids, self.type), np.cumsum([len(p) for p in some])
            covered = np.cumsum(self.lengths[ids])
            ends = np.searchsorted(covered, stops, "right")
            if not np.array_equal(covered[ends - 1], stops):
                raise ValueError("tokens do not end where words end")
            raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def special(self, texts: pa.Array) -> list[int]:
        """Rows that hold the literal of an added token."""
        found = np.zeros(len(texts), bool)
        for literal in self.literals:
            found |= np.asarray(pc.match_substring(texts, literal))
        return np.flatnonzero(found).tolist()

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text (no nulls) as bytes of ``type``, with ``end`` behind them."""
        raw, at = segments.flat(texts)
        starts = segments.unit_starts(raw, at)
        codes, numbers = self.memo.column(segments.array(raw, starts))
        last = np.searchsorted(starts, at)  # the first segment of each text, and the end
        numbers = np.insert(np.asarray(numbers), last[1:], len(codes))
        data, places = segments.joined(pa.concat_arrays([codes, pa.array([end], codes.type)]), pa.array(numbers))
        bounds = places[last + np.arange(len(last))]
        odd = self.special(texts)
        if not odd and bounds[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype("i4")), data])
        view = memoryview(data)
        out = [view[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = self.whole(texts[i].as_py()) + end
        return pa.array(out, pa.binary())


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def file_system(path: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class Writer:
    """Writes one file, a document at a time."""

    def __init__(self, path: str, kind: str):
        import zstandard

        system, where = file_system(path)
        self.out = system.open_output_stream(where, compression=None)
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        self.kind, self.path, self.total = kind, path, 0
        self.table, self.ids = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.pack(ids)
        self.out.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.total += len(ids) // int(self.kind[2])

    def close(self) -> tuple[str, int, int]:
        body = json.dumps({"ids": self.kind, "documents": len(self.ids)}).encode() + b"\n"
        body += np.array([i is None for i in self.ids], "u1").tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes()
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC)
        for magic, content in ((HEADER_MAGIC, body), (TABLE_MAGIC, table)):
            self.out.write(struct.pack("<II", magic, len(content)) + content)
        self.out.close()
        return self.path, len(self.ids), self.total


class Reader:
    """Reads the table of one file, then single documents."""

    def __init__(self, path: str):
        import zstandard

        system, where = file_system(path)
        self.file, self.path = system.open_input_file(where), path
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or descriptor != 0x80:
            raise ValueError(f"{path}: no seek table")
        at = size - 9 - 12 * n
        self.packed, self.sizes, self.sums = np.frombuffer(self._at(at, 12 * n), "<u4").reshape(n, 3).astype("i8").T
        self.offsets = np.cumsum(self.packed) - self.packed
        frames = int(self.packed.sum())
        magic, length = struct.unpack("<II", self._at(frames, 8))
        line, rest = self._at(frames + 8, length).split(b"\n", 1)
        self.kind = json.loads(line)["ids"]
        ids = np.frombuffer(rest[n:], "<i8").tolist()
        self.doc_ids = [None if gone else i for i, gone in zip(ids, rest[:n], strict=True)]
        self.counts = self.sizes // int(self.kind[2])
        self.starts = np.cumsum(self.counts) - self.counts

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document, from its frame alone, after the checksum agrees."""
        import xxhash

        raw = self.unpack(self._at(int(self.offsets[k]), int(self.packed[k])), max_output_size=int(self.sizes[k])) if self.sizes[k] else b""
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"{self.path}: checksum of document {k}")
        return np.frombuffer(raw, self.kind).astype("<u4")


def owners(doc_ids: pa.Array, ids: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the range of ``edges`` it falls in, and its rank among rows of equal doc_id.

    The rank is 0 unless that doc_id fills several ranges (is an edge more than once); its rows are
    then dealt to these by a hash of their ids.
    """
    import xxhash

    key = np.asarray(pc.fill_null(doc_ids, NULL_ID))
    low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
    rank = np.zeros(len(key), "i8")
    exact = (key == NULL_ID) | (np.abs(key) < 1 << 53)  # edges are doubles
    for i in np.flatnonzero((high - low > 1) & exact):
        rank[i] = xxhash.xxh64_intdigest(ids[i].as_buffer()) >> 1
        low[i] += int(rank[i]) * int(high[i] - low[i] + 1) >> 63
    return low, rank


def encode(docs: DataFrame, bounds: list[float], model: str, end_id: int) -> DataFrame:
    """(part, doc_id, rank, ids) of each document: its ids as bytes, and its owner among the ranges of ``bounds``."""
    edges = np.array(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        end = np.array([end_id], e.type).tobytes()
        for batch in batches:
            for piece in slices(batch, 1, BATCH_CHARS):
                ids = e.encode(pc.fill_null(piece.column(1), ""), end)
                part, rank = owners(piece.column(0), ids, edges)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), piece.column(0), pa.array(rank), ids], names=["part", "doc_id", "rank", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, doc_id long, rank long, ids binary")


def write(docs: DataFrame, path: str, model: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) under the shared folder ``path``; returns the manifest (file, n_documents, n_tokens, start), a row a file."""
    spark, model = docs.sparkSession, model or default_model()
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).cast("double")
    bounds = docs.select(key.alias("key")).approxQuantile("key", [i / files for i in range(1, files)], max(1e-5, 1 / (8 * files))) if files > 1 else []
    bounds = sorted(bounds)
    system, where = file_system(path)
    system.create_dir(where, recursive=True)
    wide = encoder(model).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part, writer = [], None, None
        for batch in batches:
            for p, doc_id, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or p != part:
                    if writer:
                        done.append((part, *writer.close()))
                    part, writer = p, Writer(f"{path}/ids-{p:06d}-{uuid.uuid4().hex[:12]}.zst", wide)
                writer.add(doc_id, ids)
        if writer:
            done.append((part, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "n_documents", "n_tokens"])

    encoded = encode(docs, bounds, model, end_id)
    owned = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "rank", "ids")
    rows = owned.mapInArrow(run, "part int, file string, n_documents long, n_tokens long").collect()  # a row a file
    manifest, start = [], 0
    for r in sorted(rows):
        manifest.append((r.file, r.n_documents, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(manifest, "file string, n_documents long, n_tokens long, start long")


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files, or of ``doc_ids`` alone; ids as little-endian unsigned 32-bit integers."""
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(file)
                rows = [k for k, i in enumerate(r.doc_ids) if wanted is None or i in wanted]
                for at in range(0, len(rows), 2000):
                    some = rows[at : at + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.doc_ids[k] for k in some], pa.int64()), pa.array([base + int(r.starts[k]) for k in some], pa.int64()), pa.array([int(r.counts[k]) for k in some], pa.int64()), pa.array([r.ids(k).tobytes() for k in some], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, path: str, model: str | None = None) -> DataFrame:
    return read(write(docs, path, model)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), fresh_path(spark, "ids"))
