"""Readers of files: documents, dictionaries, memories, skills, message histories; and what is written back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import front_matter, strip

EXTENSIONS = ("txt", "md", "pdf", "docx", "doc")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, extension, size, modified) of the files below ``root`` with one of the extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(F.col("extension").isin(*extensions)).orderBy("path")


def find_files(spark: SparkSession, root: str, part: str, extension: str | None = None, most: int = 50) -> DataFrame:
    """Files whose name has ``part``, whatever the case; at most ``most``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.contains(F.lower("name"), F.lit(part.lower())))
    if extension:
        rows = rows.where(F.endswith("name", F.lit("." + extension.lstrip("."))))
    return rows.orderBy("path").limit(most)


def categories(files: DataFrame, root: str) -> DataFrame:
    """Directories right below ``root`` that have directories of their own."""
    inside = F.regexp_extract("path", f"{root.rstrip('/')}/([^/]+)/[^/]+/", 1)
    return files.select(inside.alias("category")).where("category <> ''").distinct().orderBy("category")


def text_lenient(content: Column) -> Column:
    """UTF-8 with bad bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def text_strict(content: Column) -> Column:
    """The first of UTF-8, GBK, GB2312 and Latin-1 that reads every byte."""

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        def one(b):
            for name in ("utf-8", "gbk", "gb2312", "latin-1"):
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue

        return raw.map(lambda b: None if b is None else one(b))

    return read(content)


def _office(extension: str, raw: bytes) -> str | None:
    """Text of a .docx (its XML read with the standard library) or, if a reader is installed, a .pdf."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    if extension == "docx":
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        space = re.match(r"\{.*\}", root.tag)[0]
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    if extension == "pdf":
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            return None
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)
    return None


def read_documents(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, extension, text, reason): the text of each file by its suffix; NULL with a reason where it cannot be read."""

    @F.pandas_udf("string")
    def office(extension: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([_office(e, bytes(b)) for e, b in zip(extension, raw, strict=True)], dtype="object")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*extensions))
    plain = files.where(F.col("extension").isin("txt", "md")).withColumn("text", text_lenient(F.col("content")))
    other = files.where(~F.col("extension").isin("txt", "md")).withColumn("text", office("extension", "content"))
    rows = plain.unionByName(other)
    return rows.select("path", "extension", "text", F.when(F.col("text").isNull(), F.concat(F.lit("unreadable: "), F.col("extension"))).alias("reason"))


def head_lines(spark: SparkSession, path: str, most: int = 1000, keep: list[str] = ()) -> DataFrame:
    """(*keep, line, text) of the first lines of a file, or of each file of a folder; ``keep`` names partition columns."""
    return spark.read.text(path, wholetext=True).select(*keep, F.posexplode(F.slice(F.split("value", "\n"), 1, most)).alias("line", "text"))


def read_dictionaries(spark: SparkSession, root: str) -> DataFrame:
    """(dict_name, domain, type, term) from JSON files of ``{metadata, entities: {type: [term]}}``, one in a file or one in a line; what is no such JSON is left out."""
    kind = "metadata struct<name:string,version:string,domain:string,description:string>, entities map<string,array<string>>"
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    lines = F.filter(F.split("value", r"\R"), lambda x: x.rlike(r"\S"))
    by_line = F.forall(lines, lambda x: x.rlike(r"^\s*\{.*\}\s*$"))
    rows = raw.select(F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value"))
    rows = rows.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("d")).where("d.entities IS NOT NULL")
    rows = rows.select(F.col("d.metadata.name").alias("dict_name"), F.col("d.metadata.domain").alias("domain"), F.explode("d.entities").alias("type", "terms"))
    return rows.select("dict_name", "domain", "type", F.explode("terms").alias("term"))


#: Terms that a file of a dictionary holds, on average; larger dictionaries take several files.
FILE_TERMS = 100_000


def write_dictionary(dictionary: DataFrame, path: str, file_terms: int = FILE_TERMS) -> None:
    """JSON files in the form that ``read_dictionaries`` takes, one for each dictionary (dict_name, domain) and every ``file_terms`` of its distinct terms."""
    rows = dictionary.where(F.col("term").isNotNull() & F.col("type").isNotNull()).select("dict_name", "domain", "type", "term").distinct()
    files = rows.groupBy("dict_name", "domain").agg(F.ceil(F.count("*") / file_terms).alias("files"))
    same = (F.col("r.dict_name").eqNullSafe(F.col("f.dict_name"))) & (F.col("r.domain").eqNullSafe(F.col("f.domain")))
    dealt = rows.alias("r").join(files.alias("f"), same).select("r.*", F.pmod(F.xxhash64("type", "term"), F.col("files")).alias("file"))
    by_type = dealt.groupBy("dict_name", "domain", "file", "type").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    whole = by_type.groupBy("dict_name", "domain", "file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "terms")))).alias("entities"))
    rows = whole.select(F.struct(F.col("dict_name").alias("name"), "domain").alias("metadata"), "entities")
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def import_terms(dictionary: DataFrame, more: DataFrame, merge: bool = True) -> DataFrame:
    """``dictionary`` with ``more`` imported: its terms added to those that are there, or instead of them in the dictionaries that it names; no term twice under a type."""
    if merge:
        return dictionary.unionByName(more.select(*dictionary.columns)).dropDuplicates(["dict_name", "type", "term"])
    kept = dictionary.join(more.select("dict_name").distinct(), "dict_name", "left_anti")
    return kept.select(*dictionary.columns).unionByName(more.select(*dictionary.columns)).dropDuplicates(["dict_name", "type", "term"])


def add_terms(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    """The dictionary and the terms that it does not have yet under that type."""
    return dictionary.unionByName(more.join(dictionary, ["dict_name", "type", "term"], "left_anti").select(*dictionary.columns))


def read_memories(spark: SparkSession, root: str) -> DataFrame:
    """(id, type, content, importance, ts) of ``MEMORY.md`` and the files in ``memory/``, but ``projects.md``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = files.where(F.col("path").rlike(r"/MEMORY\.md$|/memory/[^/]+\.md$") & (stem != "projects"))
    m = front_matter(F.col("value"))
    field = lambda k: m["fields"][k]
    return rows.select(
        F.when(stem == "MEMORY", "main").otherwise(F.coalesce(field("id"), stem)).alias("id"), F.coalesce(field("type"), F.lit("semantic")).alias("type"), m["body"].alias("content"),
        F.coalesce(field("importance").cast("double"), F.lit(0.5)).alias("importance"), F.try_to_timestamp(field("timestamp")).alias("ts"),
    )


def memory_text(id_: Column, kind: Column, ts: Column, importance: Column, content: Column) -> Column:
    """A memory as the text that ``read_memories`` takes."""
    return F.concat(F.lit("---\nid: "), id_, F.lit("\ntype: "), kind, F.lit("\ntimestamp: "), ts.cast("string"), F.lit("\nimportance: "), importance.cast("string"), F.lit("\n---\n\n"), content)


def read_skills(spark: SparkSession, root: str) -> DataFrame:
    """(path, description, triggers, tools, prompt) of the skill files below ``root``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").withColumn("path", F.input_file_name())
    items = lambda name: F.filter(F.transform(F.split(F.regexp_extract("value", rf"(?im)^{name}\s*[:：]\s*\[?([^\]\n]*)", 1), "[,，]"), lambda x: F.regexp_replace(strip(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    return files.select("path", strip(F.regexp_extract("value", r"(?im)^description\s*[:：]\s*([^\n]*)", 1)).alias("description"), items("triggers").alias("triggers"), items("tools").alias("tools"), F.regexp_extract("value", r"(?s)```(?:prompt)?\n(.*?)```", 1).alias("prompt"))


MESSAGES = "array<struct<role:string,content:string,timestamp:double,metadata:map<string,string>>>"


def read_histories(spark: SparkSession, root: str) -> DataFrame:
    """(channel, user, session, seq, role, content, timestamp) from ``channel/user/session.json`` files; broken files give no rows."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("path", F.input_file_name())
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.json$", k)
    rows = files.select(part(1).alias("channel"), part(2).alias("user"), part(3).alias("session"), F.posexplode(F.from_json("value", MESSAGES)).alias("seq", "m"))
    return rows.select("channel", "user", "session", "seq", "m.role", "m.content", "m.timestamp")


def attachment_text(extracted: Column, most: int = 5000) -> Column:
    """The front of an attachment's text; error notes, which start with ``[``, stay whole."""
    return F.when(F.startswith(extracted, F.lit("[")), extracted).otherwise(F.left(extracted, F.lit(most)))
