"""Benchmark decontamination by winnowing (operator 4).

Both sides hash runs of ``GRAM`` words and keep, of any ``WINDOW - GRAM + 1`` runs in a row, the
smallest (the rightmost of equals). Equal windows of ``WINDOW`` words keep the same one, so the join
of the kept fingerprints meets every shared window. A fingerprint that an item has is then extended to the
windows that keep it: only those travel, and they meet the items' windows by the hash of all their
words and by the words themselves; overlapping hits become one span. So a run of a few words that many
items and many documents have, in other surroundings each, makes no rows at all. Items with fewer
words are a single window; for their lengths (below ``WINDOW``) every run of that many words is looked up.

Equal windows of items are one *place*; documents meet places, so a passage that many documents and
many items share is one row for each of its windows and documents. Documents with the same places share one
list of item ids.

While the items have at most ``LIMIT`` fingerprints, or windows (8 bytes each), tasks drop what no item has as they
scan. Beyond that, a semi-join of fingerprints comes first and tasks get the fingerprints of each
document with its row.

Results for odd inputs: null and empty texts have no words and no hits; items without words never
occur; items of equal item_id are one item, a null item_id counts as the id ''; a document is
judged row by row, repeated or not; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, map_texts, save

WINDOW, GRAM = 13, 5
LIMIT = 1_000_000
#: A-Z to a-z; digits, a-z and all beyond ASCII stay; the rest parts words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOWS = "array<struct<hash:long,start:int,size:int,words:string>>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words from the words' hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, "u8")
    acc = np.full(n, length, "u8")
    for j in range(length):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[j : j + n]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ acc >> np.uint64(29)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` hashes in a row the position of the smallest (rightmost) one."""
    if len(hashes) < width:
        return np.zeros(0, "i8")
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.arange(len(view)) + width - 1 - view.argmin(1)


def word_hashes(text_words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, text_words), "u8", len(text_words))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint that each window of words (hashes ``h``) keeps."""
    g = run_hashes(h, GRAM)
    return g[winnow(g, WINDOW - GRAM + 1)] ^ np.uint64(1)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def windows(text_words: list[bytes], at: np.ndarray, size: int, hashes: np.ndarray) -> list[dict]:
    """The windows of ``size`` words that start at ``at``, whose hashes are given."""
    return [{"hash": x, "start": i, "size": size, "words": b" ".join(text_words[i : i + size]).decode("utf-8", "replace")} for i, x in zip(at.tolist(), hashes.astype("i8").tolist(), strict=True)]


def item_windows(items: DataFrame) -> DataFrame:
    """(item, print, hash, start, size, words): the windows of the items (item_id, text) and the fingerprint each keeps; that of a short item is its own hash."""

    def setup():
        def work(texts):
            out = []
            for t in texts:
                w = words(t)
                h, size = word_hashes(w), min(WINDOW, len(w))
                own = run_hashes(h, size) if size else np.zeros(0, "u8")
                prints = fingerprints(h) if size == WINDOW else own
                out.append([r | {"print": p} for r, p in zip(windows(w, np.arange(len(own)), size, own), prints.astype("i8").tolist(), strict=True)])
            return [out]

        return work

    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("text"))
    rows = map_texts(items, "text", [("found", WINDOWS.replace("words:", "print:long,words:"))], setup)
    return rows.select("item", F.inline("found"))


class Known:
    """What tasks know of the items: sizes of short ones, and sorted fingerprints and windows where there are few enough."""

    def __init__(self, short: list[int], prints: np.ndarray | None, wide: np.ndarray | None):
        self.short, self.prints, self.wide = short, prints, wide

    def found(self, w: list[bytes], wanted: np.ndarray | None) -> list[dict]:
        """The windows of a document that an item may have."""
        h, out = word_hashes(w), []
        prints = self.prints if wanted is None else wanted
        if len(h) >= WINDOW:
            at = np.flatnonzero(among(fingerprints(h), prints))
            if len(at):
                out.append((at, WINDOW, run_hashes(h, WINDOW)[at]))
        for size in self.short:
            own = run_hashes(h, size)
            at = np.flatnonzero(among(own, prints))
            out.append((at, size, own[at]))
        if self.wide is not None:
            out = [(at[some], size, own[some]) for at, size, own in out for some in [among(own, self.wide)]]
        return [r for at, size, own in out for r in windows(w, at, size, own)]

    def all_prints(self, w: list[bytes]) -> list[dict]:
        h = word_hashes(w)
        own = np.unique(np.concatenate([fingerprints(h), *(run_hashes(h, size) for size in self.short)]))
        return [{"hash": x, "start": 0, "size": 0, "words": None} for x in own.astype("i8").tolist()]


def scan(docs: DataFrame, known: Known, wanted: str | None = None, also: str | None = None) -> DataFrame:
    """rid, doc_id, n_words and the windows found of ``docs`` (rid, doc_id, text): those whose fingerprint ``known`` has or the row's own column ``wanted``; with neither, all its fingerprints. ``also`` names a long column that comes along."""
    columns = [F.col(c) for c in ("rid", "doc_id", "text")] + ([F.col(wanted).alias("wanted")] if wanted else []) + ([F.col(also)] if also else [])
    schema = f"rid long, doc_id long, n_words long, found {WINDOWS}" + (f", {also} long" if also else "")
    struct = pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in batches:
            for piece, texts in pieces(batch, 2):
                own = piece.column(3).to_pylist() if wanted else [None] * len(texts)
                split = [words(t) for t in texts]
                if wanted:
                    found = [known.found(w, np.sort(np.array(o, "i8").view("u8"))) if o else [] for w, o in zip(split, own, strict=True)]
                else:
                    found = [known.all_prints(w) if known.prints is None else known.found(w, None) for w in split]
                extra = [piece.column(piece.num_columns - 1)] if also else []
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(map(len, split), pa.int64()), pa.array(found, pa.list_(struct)), *extra], names=["rid", "doc_id", "n_words", "found", *([also] if also else [])])

    return docs.select(*columns).mapInArrow(run, schema)


def _few(rows: DataFrame, column: str, limit: int) -> np.ndarray | None:
    """The distinct values of a long column, sorted as unsigned, if there are ``limit`` of them at most (8 bytes each)."""
    values = rows.select(column).distinct().limit(limit + 1).collect()
    return np.sort(np.array([r[0] for r in values], "i8").view("u8")) if len(values) <= limit else None


def hits(docs: DataFrame, items: DataFrame, limit: int = LIMIT, also: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows (rid, doc_id, n_words) of ``docs`` (rid, doc_id, text), the windows of theirs that items have (rid, place, start, size), and the items of each place (place, item)."""
    found = save(item_windows(items).select("item", "print", "hash", "size", "words").distinct(), "items")
    places = save(found.groupBy("hash", "size", "words").agg(F.first("print").alias("print")).withColumn("place", F.monotonically_increasing_id()), "places")
    short = sorted(r[0] for r in places.where(F.col("size") < WINDOW).select("size").distinct().collect())  # below WINDOW
    prints = _few(places, "print", limit)
    known = Known(short, prints, _few(places, "hash", limit))  # 16 MB at most; the session broadcasts what tasks carry once it is over 1 MB
    if prints is not None:
        scanned = scan(docs, known, also=also)
    else:
        docs = save(docs, "rows")  # both scans must see the same rid
        all_of = scan(docs, known).select("rid", F.explode("found.hash").alias("print"))
        wanted = all_of.join(places.select("print").distinct(), "print", "left_semi").groupBy("rid").agg(F.collect_list("print").alias("wanted"))
        scanned = scan(docs.join(wanted, "rid", "left"), known, "wanted", also)
    scanned = save(scanned, "scanned")
    met = scanned.select("rid", F.inline("found")).join(places.drop("print"), ["hash", "size", "words"]).select("rid", "place", "start", "size")
    return scanned.drop("found"), met, found.join(places, ["hash", "size", "words"]).select("place", "item")


def mark_rows(docs: DataFrame, items: DataFrame, limit: int = LIMIT, also: str | None = None) -> DataFrame:
    """rid, doc_id, n_words, n_hit, items (sorted ids), contaminated of ``docs`` (rid, doc_id, text)."""
    scanned, found, places = hits(docs, items, limit, also)
    # spans in order: each adds what lies behind the end of those before it
    covered = F.expr("aggregate(spans, struct(0 AS n, 0 AS end), (s, x) -> struct(s.n + greatest(0, x.start + x.size - greatest(x.start, s.end)) AS n, greatest(s.end, x.start + x.size) AS end)).n")
    by_doc = found.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("place")).alias("places"))
    by_doc = save(by_doc.select("rid", covered.cast("long").alias("n_hit"), "places"), "hits")
    lists = by_doc.select("places").distinct().select("places", F.explode("places").alias("place")).join(places, "place")
    lists = lists.groupBy("places").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = scanned.join(by_doc.join(lists, "places").drop("places"), "rid", "left")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def mark(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The contract's columns for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    rows = mark_rows(rows, items, limit)
    ids = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows.

    The verdict follows from the text alone, so rows are found again by doc_id and the text's hash:
    rows that agree in both share it.
    """
    key, name = free_name(docs, "text_key"), "text_key"
    hashed = lambda df, name: df.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = hashed(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text"), name)
    bad = mark_rows(rows, items, also=name).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col(name).alias("bad_key")).distinct()
    same = F.col(key).eqNullSafe(F.col("bad_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id"))
    return hashed(docs, key).join(bad, same, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
    SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark
), sizes AS (
    SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0
), theirs AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ours AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)
), hit AS (
    SELECT r, n, i, item FROM ours JOIN theirs USING (n, words)
), places AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256,
    coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
