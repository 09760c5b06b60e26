"""Web pages as WARC 1.1 records in zstandard archives, written and read back (operator 12).

An archive begins with a skippable frame (0x184D2A5D) that holds its dictionary, zstandard-compressed
itself, then has one zstandard frame for each record (the published use of zstandard for WARC):

    frame     warcinfo
    frame     response: HTTP header and payload
    frame     revisit: HTTP header alone; WARC-Refers-To names the response with the same payload

Writing: pages of equal payload (SHA-256 and length, at least ``LEAST_PAYLOAD`` bytes) are found from digests
alone, combined before the shuffle; the one of largest page_id is the response. Pages meet the list of payloads that
several have by a join that adaptive execution broadcasts if it is small and splits where one payload is
very common; each task writes what it holds to archives of its own. A task that runs again writes
under a new name; the manifest is a written table, in which only rows of tasks that counted stand.

Reading: a task takes whole archives, loads the dictionary from the leading frame, and decodes one
frame a record, one record at a time in memory. Checked are: one record in a frame and nothing behind it, version, header
syntax, mandatory fields once each, date, Content-Length against the block, the closing blank lines,
HTTP Content-Length against the payload, and block and payload digests. ``strict`` raises at the first
problem; else the row says what is wrong and reading goes on at the next frame. ``offset`` of a row and ``fetch``
give a single record without the rest of the archive.

Results for odd inputs: null and empty html are the empty payload, a payload like others; a null url leaves out the target, other
urls are percent-encoded; null page_ids come last when a response is chosen; of rows that share the largest page_id one
is the response; repeated rows are records of their own; an empty table gives no archive and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, fresh_path, save, slices
from .token_files import file_system

#: Payloads of fewer bytes are never written as revisits.
LEAST_PAYLOAD = 0
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Pages that a dictionary is made from at most, bytes that each of them has at most, and bytes of a dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY = 400, 1 << 16, 1 << 16
LEVEL = 3
#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, b"\x28\xb5\x2f\xfd", range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 16
#: Bytes of archives that a reading task takes.
TASK_BYTES = 1 << 28


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing


def record(kind: str, record_id: str, date: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    """One WARC record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date} | fields | {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A page as a response, or as a revisit of the record ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", record_id, date, http + payload, fields)
    return record("revisit", record_id, date, http, fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to})


class Writer:
    """One archive: dictionary, warcinfo, then a frame for each record."""

    def __init__(self, path: str, dictionary: bytes, date: str):
        import zstandard

        system, where = file_system(path)
        self.out, self.path, self.records, self.size = system.open_output_stream(where, compression=None), path, 0, 0
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        kinds = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **kinds).compress
        info = b"format: WARC File Format 1.1\r\n"
        self._put(self.pack(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, info, {"Content-Type": "application/warc-fields"})))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.pack(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples, or their plain bytes where there is too little to train on; none without samples."""
    import zstandard

    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def payloads(pages: DataFrame, stored: bool = False) -> DataFrame:
    """(rid, page_id, url, payload, digest, size) of ``pages`` (page_id, url, html); ``stored``: read straight from Parquet files, whose rows are known by their place."""
    if not stored:
        pages = save(pages.select("page_id", "url", "html"), "pages")
    rid = F.concat_ws("-", F.lower(F.hex(F.xxhash64("_metadata.file_path"))), F.col("_metadata.row_index"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(rid.alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))


def with_responses(rows: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``rows`` of ``payloads`` with ``lead`` (page_id, rid): the response that a revisit refers to, null for responses."""
    first = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "rid")
    twins = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(first).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    lead = F.when(F.col("first.rid") != F.col("rid"), F.struct("first.page_id", "first.rid"))
    return rows.join(twins, ["digest", "size"], "left").select("rid", "page_id", "url", "payload", lead.alias("lead"))


def _name(page_id, rid) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), rid, F.lit(">"))


def write(pages: DataFrame, path: str, stored: bool = False, least: int = LEAST_PAYLOAD, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` to archives under the shared folder ``path``; returns the manifest (file, n_records, n_bytes), a row an archive."""
    spark, rows = pages.sparkSession, payloads(pages, stored)
    some = rows.where(F.col("size").between(1, SAMPLE_BYTES)).select("rid", F.xxhash64("page_id").alias("at")).orderBy("at", "rid").limit(SAMPLE_PAGES)
    names = F.broadcast(spark.createDataFrame([(r.rid,) for r in some.collect()], "rid string"))  # payloads are fetched once it is known which
    dictionary = train([bytes(r.payload) for r in rows.join(names, "rid", "left_semi").orderBy("rid").select("payload").collect()])  # SAMPLE_PAGES of SAMPLE_BYTES at most
    named = with_responses(rows, least).select(_name(F.col("page_id"), F.col("rid")).alias("id"), "url", "payload", F.when(F.col("lead").isNotNull(), _name(F.col("lead.page_id"), F.col("lead.rid"))).alias("refers_to"))
    system, where = file_system(path)
    system.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in batches:
            for piece in slices(batch, 2, CHUNK_CHARS):
                for record_id, url, payload, refers_to in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    writer = writer or Writer(f"{path}/pages-{uuid.uuid4().hex}.warc.zst", dictionary, date)
                    writer.add(page_record(record_id, url, payload, refers_to, date))
                    if writer.size >= archive_bytes:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["file", "n_records", "n_bytes"])

    return save(named.mapInArrow(run, "file string, n_records long, n_bytes long"), "manifest")


# Reading


class Broken(ValueError):
    """What is wrong with an archive or a record."""


@dataclass
class Record:
    kind: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int | None = None


def _fields(head: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "strict").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise Broken(f"{what} line {line[:60]!r}")
        if name.lower() in out:
            raise Broken(f"{what} field {name} twice")
        out[name.lower()] = value.strip(" \t")
    return out


def _length(fields: dict[str, str], what: str) -> int:
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise Broken(f"{what} without a length")
    return int(fields["content-length"])


def parse(raw: bytes) -> Record:
    """The one record that ``raw`` must hold, checked."""
    end = raw.find(b"\r\n\r\n")
    first, _, head = raw[: max(end, 0)].partition(b"\r\n")
    if end < 0 or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise Broken("no WARC header")
    try:
        fields = _fields(head, "WARC")
    except UnicodeDecodeError:
        raise Broken("WARC header is no UTF-8") from None
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise Broken(f"no {name}")
    if not re.fullmatch(r"<[^<>\s]+>", fields["warc-record-id"]):
        raise Broken("record id is no URI in brackets")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", fields["warc-date"]):
        raise Broken("date")
    length, rest = _length(fields, "WARC header"), raw[end + 4 :]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Broken(f"block of {len(rest) - 4} bytes, header says {length}")
    block = rest[:length]
    r = Record(fields["warc-type"], fields)
    _digest(fields.get("warc-block-digest"), block, "block")
    if r.kind in ("response", "revisit"):
        end = block.find(b"\r\n\r\n")
        status, _, head = block[: max(end, 0)].partition(b"\r\n")
        if end < 0 or not status.startswith(b"HTTP/"):
            raise Broken("no HTTP header")
        r.http = _fields(head, "HTTP")
        r.payload_bytes = _length(r.http, "HTTP header")
        if r.kind == "response":
            r.payload = block[end + 4 :]
            if len(r.payload) != r.payload_bytes:
                raise Broken(f"payload of {len(r.payload)} bytes, header says {r.payload_bytes}")
            _digest(fields.get("warc-payload-digest"), r.payload, "payload")
        elif len(block) != end + 4:
            raise Broken("revisit with a payload")
        elif fields.get("warc-profile") != PROFILE or not {"warc-refers-to", "warc-payload-digest"} <= fields.keys():
            raise Broken("revisit of nothing")
    return r


def _digest(stated: str | None, data: bytes, what: str) -> None:
    if stated is not None and stated.startswith("sha1:") and stated[5:] != sha1(data):
        raise Broken(f"{what} digest")


class Archive:
    """Reads the frames of one archive, one at a time."""

    def __init__(self, path: str):
        import zstandard

        system, where = file_system(path)
        self.file, self.path = system.open_input_file(where), path
        self.size, self.begin, dictionary = self.file.size(), 0, b""
        head = self._at(0, 8)
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            n = struct.unpack("<I", head[4:])[0]
            dictionary, self.begin = self._at(8, n), 8 + n
            if len(dictionary) != n:
                raise Broken(f"{path}: dictionary is cut off")
            if dictionary[:4] == FRAME_MAGIC:
                dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        self.unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, offset: int) -> tuple[bytes, int]:
        """The content of the frame at ``offset``, and where the next one begins."""
        import zstandard

        one, out, at = self.unpack.decompressobj(), [], offset
        while not one.eof:
            data = self._at(at, READ)
            if not data:
                raise Broken(f"frame at {offset} is cut off")
            try:
                out.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise Broken(f"frame at {offset}: {e}") from None
            at += len(data) - len(one.unused_data)
        return b"".join(out), at

    def next_frame(self, offset: int) -> int:
        """Where the next frame's mark stands from ``offset`` on, or the end."""
        while offset < self.size:
            data = self._at(offset, READ)
            if (k := data.find(FRAME_MAGIC)) >= 0:
                return offset + k
            if len(data) < READ:
                break
            offset += len(data) - 3
        return self.size

    def records(self, strict: bool = True) -> Iterator[tuple[int, int, Record | None, str | None]]:
        """(offset, length, record, what is wrong with it) of every frame that holds a record."""
        at = self.begin
        while at < self.size:
            head = self._at(at, 8)
            if len(head) == 8 and struct.unpack("<I", head[:4])[0] in SKIPPABLE:
                at += 8 + struct.unpack("<I", head[4:])[0]
                continue
            after = None
            try:
                raw, after = self.frame(at)
                yield at, after - at, parse(raw), None
            except Broken as e:
                if strict:
                    raise Broken(f"{self.path} at {at}: {e}") from None
                after = after or self.next_frame(at + 1)
                yield at, after - at, None, str(e)
            at = after


_TEXT, _LONG, _BYTES = ("string", pa.string()), ("long", pa.int64()), ("binary", pa.binary())
ROW = {"file": _TEXT, "offset": _LONG, "length": _LONG, "record_type": _TEXT, "record_id": _TEXT, "target_uri": _TEXT, "date": _TEXT, "payload_bytes": _LONG, "payload_digest": _TEXT, "refers_to": _TEXT, "payload": _BYTES, "problem": _TEXT}


def read(manifest: DataFrame, payload: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record of the archives in ``manifest`` (file, n_bytes); payloads only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = pa.schema([(name, kind) for name, (_, kind) in ROW.items()]), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for at, length, r, problem in Archive(file).records(strict):
                    f = r.fields if r else {}
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((file, at, length, r and r.kind, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), r and r.payload_bytes, digest, f.get("warc-refers-to"), r.payload if r and payload else None, problem))
                    held += len(rows[-1][10] or b"")
                    if len(rows) >= 2000 or held > CHUNK_CHARS:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    total = manifest.agg(F.count("*"), F.sum("n_bytes")).first()
    tasks = max(1, min(total[0], max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total[1] or 0) // TASK_BYTES)))
    return manifest.select("file").repartition(tasks).mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in ROW.items()))


def fetch(file: str, offset: int) -> Record:
    """The one record whose frame begins at ``offset`` of an archive."""
    return parse(Archive(file).frame(offset)[0])


def page_of(record_id) -> F.Column:
    """The page_id in a record id that ``write`` made."""
    return F.expr("try_cast(nullif(regexp_extract(%s, '^<urn:page:(-?[0-9]*):', 1), '') AS long)" % record_id)


def digests(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives."""
    rows = read(manifest).where(F.col("record_type").isin("response", "revisit"))
    return rows.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"), stored=True))


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM p WINDOW g AS (PARTITION BY html)
"""
