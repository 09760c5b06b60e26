"""The files of a vector store: a table of its SQLite database, read by subtrees of its B-tree, and its vectors.

``SqliteTable`` is a data source (``spark.dataSource.register(SqliteTable)``, format ``sqlite_table``, option
``table``). The driver reads the schema row and interior pages only; each partition is a subtree, whose leaf
pages are read in a task, one page at a time, with their overflow chains. Options ``low`` and ``high`` are
bounds of ``_rowid``: subtrees beyond them are never opened. The file must be checkpointed (a write-ahead log beside
it is not read) and have rowids.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Partitions that a table is cut into at least, if it has as many subtrees.
PARTITIONS = 64


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        system, where = fs.LocalFileSystem(), path
    return system.open_input_file(where)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` (seven bits a byte, the ninth whole) and where it ends."""
    n = 0
    for k in range(9):
        b = data[at + k]
        if k == 8:
            n = n << 8 | b
        else:
            n = n << 7 | b & 127
            if b < 128:
                return _signed(n), at + k + 1
    return _signed(n), at + 9


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


class Pages:
    """The pages of one database file."""

    def __init__(self, path: str):
        self.file, self.path = _open(path), path
        head = self.file.read(100)
        if len(head) < 100 or head[:16] != b"SQLite format 3\0":
            raise ValueError(f"{path}: no SQLite database")
        self.size = struct.unpack(">H", head[16:18])[0]
        self.size = 65536 if self.size == 1 else self.size
        self.usable = self.size - head[20]
        self.text = {1: "utf-8", 2: "utf-16-le", 3: "utf-16-be"}.get(struct.unpack(">I", head[56:60])[0], "utf-8")

    def page(self, number: int) -> bytes:
        self.file.seek((number - 1) * self.size)
        data = self.file.read(self.size)
        if len(data) < self.size:
            raise ValueError(f"{self.path}: page {number} is missing")
        return data

    def children(self, number: int) -> list[tuple[int, int | None]] | None:
        """(page, largest rowid in it; None if open) below an interior page; None for a leaf."""
        data, base = self.page(number), 100 if number == 1 else 0
        if data[base] == 13:
            return None
        if data[base] != 5:
            raise ValueError(f"{self.path}: page {number} is of no table with rowids")
        n = struct.unpack(">H", data[base + 3 : base + 5])[0]
        cells = struct.unpack(f">{n}H", data[base + 12 : base + 12 + 2 * n])
        out = [(struct.unpack(">I", data[c : c + 4])[0], varint(data, c + 4)[0]) for c in cells]
        return [*out, (struct.unpack(">I", data[base + 8 : base + 12])[0], None)]

    def rows(self, number: int) -> Iterator[tuple[int, list]]:
        """(rowid, values) below a page, leaf by leaf."""
        below = self.children(number)
        if below is not None:
            for child, _ in below:
                yield from self.rows(child)
            return
        data, base = self.page(number), 100 if number == 1 else 0
        n = struct.unpack(">H", data[base + 3 : base + 5])[0]
        for c in struct.unpack(f">{n}H", data[base + 8 : base + 8 + 2 * n]):
            length, at = varint(data, c)
            rowid, at = varint(data, at)
            yield rowid, self.values(self.payload(data, at, length))

    def payload(self, data: bytes, at: int, length: int) -> bytes:
        """A cell's bytes: what stands on the page, then its overflow pages."""
        most, least = self.usable - 35, (self.usable - 12) * 32 // 255 - 23
        local = length
        if length > most:
            local = least + (length - least) % (self.usable - 4)
            local = least if local > most else local
        parts, left = [data[at : at + local]], length - local
        following = struct.unpack(">I", data[at + local : at + local + 4])[0] if left else 0
        while left > 0:
            page = self.page(following)
            following = struct.unpack(">I", page[:4])[0]
            parts.append(page[4 : 4 + min(left, self.usable - 4)])
            left -= self.usable - 4
        return b"".join(parts)

    def values(self, raw: bytes) -> list:
        """The values of a record."""
        head, at = varint(raw, 0)
        kinds = []
        while at < head:
            kind, at = varint(raw, at)
            kinds.append(kind)
        out, at = [], head
        for kind in kinds:
            if kind in (0, 8, 9):
                out.append({0: None, 8: 0, 9: 1}[kind])
                continue
            n = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8, 7: 8}.get(kind) or (kind - 12) // 2
            data, at = raw[at : at + n], at + n
            out.append(struct.unpack(">d", data)[0] if kind == 7 else int.from_bytes(data, "big", signed=True) if kind < 7 else bytes(data) if kind % 2 == 0 else data.decode(self.text, "replace"))
        return out


def columns_of(sql: str) -> list[tuple[str, str, bool]]:
    """(name, Spark type, stands for the rowid) of the columns of a CREATE TABLE statement."""
    body, depth, parts = sql[sql.index("(") + 1 : sql.rindex(")")], 0, [""]
    for c in re.findall(r"\"[^\"]*\"|'[^']*'|`[^`]*`|\[[^\]]*\]|.", body, re.S):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for part in parts:
        m = re.match(r"\s*(\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|\w+)\s*(.*)", part, re.S)
        if not m or re.match(r"(?i)(primary|unique|check|foreign|constraint)\b", m[1]):
            continue
        rest = m[2].upper()
        kind = re.match(r"[A-Z ]*", re.split(r"\b(?:PRIMARY|NOT|NULL|DEFAULT|UNIQUE|CHECK|REFERENCES|COLLATE|GENERATED|AS|CONSTRAINT)\b", rest)[0])[0].strip()
        spark = "long" if "INT" in kind else "string" if re.search("CHAR|CLOB|TEXT", kind) else "binary" if not kind or "BLOB" in kind else "double" if re.search("REAL|FLOA|DOUB", kind) else "string"
        out.append((m[1].strip('"`[]'), spark, kind == "INTEGER" and "PRIMARY KEY" in rest))
    return out


def _as(kind: str, v):
    """A value as its column's type; SQLite columns may hold any."""
    if v is None:
        return None
    if kind == "binary":
        return v if isinstance(v, bytes) else str(v).encode()
    if kind == "string":
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else v if isinstance(v, str) else str(v)
    return (int if kind == "long" else float)(v) if isinstance(v, (int, float)) else None


@dataclass
class Subtrees(InputPartition):
    pages: list[int]


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _found(self) -> tuple[int, list[tuple[str, str, bool]]]:
        table = self.options["table"]
        for _, (kind, name, _, root, sql, *_) in Pages(self.options["path"]).rows(1):
            if kind == "table" and name.lower() == table.lower():
                if re.search(r"(?i)without\s+rowid\s*$", sql):
                    raise ValueError(f"{table} has no rowids")
                return root, columns_of(sql)
        raise ValueError(f"no table {table}")

    def schema(self) -> str:
        return ", ".join(["_rowid long", *(f"`{name}` {kind}" for name, kind, _ in self._found()[1])])

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, *self._found())


class SqliteReader(DataSourceReader):
    def __init__(self, options, root: int, columns: list[tuple[str, str, bool]]):
        self.path, self.root, self.columns = options["path"], root, columns
        bound = lambda k: int(options[k]) if k in options else None
        self.low, self.high, self.least = bound("low"), bound("high"), int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Subtrees]:
        """Neighbouring subtrees within the bounds, ``least`` partitions at least if there are as many leaves, and four times that at most."""
        pages, level = Pages(self.path), [self.root]
        while len(level) < self.least:
            below: list[int] = []
            for number in level:
                before, children = None, pages.children(number)
                if children is None:  # all leaves are equally deep
                    return [Subtrees([page]) for page in level]
                for page, last in children:
                    if (self.low is None or last is None or last >= self.low) and (self.high is None or before is None or before < self.high):
                        below.append(page)
                    before = last
            level = below
        each = -(-len(level) // (4 * self.least))
        return [Subtrees(level[i : i + each]) for i in range(0, len(level), each)]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        low = -(1 << 63) if self.low is None else self.low
        high = (1 << 63) - 1 if self.high is None else self.high
        pages = Pages(self.path)
        for number in partition.pages:
            for rowid, values in pages.rows(number):
                if low <= rowid <= high:
                    values += [None] * (len(self.columns) - len(values))
                    yield (rowid, *(rowid if own and v is None else _as(kind, v) for (_, kind, own), v in zip(self.columns, values)))


def read_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """(_rowid, columns...) of one table of a database file."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(table=table, **options).load(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of JSON files ``{id: [numbers], ...}``, cut at their brackets, so that they are read in parts however long a line is. What is no such entry raises an error."""
    parts = spark.read.option("lineSep", "]").text(path)
    entry = r'(?s)^\s*(?:[}]?\s*[{]|,)?\s*"((?:[^"\\]|\\.)*)"\s*:\s*\[([^\["]*)$'
    rest = F.regexp_extract("value", r"(?s)^\s*[{]?\s*[}]?\s*$", 0) == F.col("value")
    name = F.from_json(F.concat(F.lit('{"id":"'), F.regexp_extract("value", entry, 1), F.lit('"}')), "id string")["id"]
    vector = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", entry, 2), F.lit("]")), "array<double>")
    checked = F.when(F.col("value").rlike(entry), F.struct(name.alias("id"), vector.alias("vector"))).otherwise(F.raise_error(F.concat(F.lit("no entry of a vector file: "), F.left("value", F.lit(80)))))
    return parts.where(~rest).select(checked.alias("e")).select("e.id", "e.vector")


def read_store(spark: SparkSession, folder: str, collection: str, database: str = "vectors.db") -> DataFrame:
    """(id, text, metadata, vector) of one collection of a store: its table, with vectors where it has them."""
    safe = "".join(c if c.isalnum() else "_" for c in collection)
    rows = read_table(spark, f"{folder}/{database}", f"docs_{safe}").select("id", "text", F.from_json("metadata", "map<string,string>").alias("metadata"))
    return rows.join(read_vectors(spark, f"{folder}/vectors_{collection}.json"), "id", "left")
