"""Spelling variants of words, and the form that each belongs to (operator 13).

1. Words: runs of letters are found in the bytes of Arrow batches, lower-cased (A-Z alone) and, where the
   crc32 of "doc_id:run" is divisible by ``EVERY``, shortened by one letter. Words of ``LEAST`` code points
   are counted in the batch, summed by word, and kept from ``TWICE`` occurrences on.
2. Buckets: two words are near if one inserted, deleted or replaced code point parts them. Let L be the
   length of the shorter one and e their common prefix, 0 <= e <= L. For an interval P <= e < Q both
   begin with the same P code points and end with the same L - Q. So a word goes, for L its length and
   one less, to a bucket for each of ``PARTS`` intervals, keyed by those two ends; a pair meets in
   exactly one. Buckets with over ``WORK`` comparisons or ``ROWS`` words have their interval halved until it
   is one place, where one or two free letters are left; so no bucket grows with the table and none is cut.
3. Tiles: the words of a bucket stand in matrices of code points, padded to equal width, aligned at the
   front and at the back. Blocks of rows are compared with blocks, a column at a time; common prefix and
   suffix together reaching the longer length minus one is the test. Small buckets share a tile, row by row.
   A bucket gives each word its number of near words and the best one, never its pairs.
4. The form of a word is its near word of largest count (ties: smallest in code-point order) if that is
   ``TIMES`` its own at least. Counts grow tenfold with each form, so a chain is short; roots are found
   by pointer doubling.

Results for odd inputs: null and empty texts have no words; a null doc_id counts as an empty one; repeated
rows count again; runs of any length are whole words; a table without words gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .common import BATCH_CHARS, documents, save, slices
from .source_divergence import LOWER, word_bounds

LEAST, TWICE, EVERY, TIMES = 7, 2, 31, 10
#: Intervals of edit places that a word is keyed by at first, comparisons a bucket may need, and rows of a block.
PARTS, WORK, BLOCK = 3, 1 << 21, 1024
#: Buckets of so many words share tiles.
FEW = 24
#: Rows and bytes of words that are solved together, and cells of a matrix.
ROWS, BYTES, CELLS = 50_000, 32 << 20, 1 << 21
_CODES = np.arange(256)
ASCII_LETTER = (_CODES >= 65) & (_CODES <= 90) | (_CODES >= 97) & (_CODES <= 122)
#: Runs longer than this have their checksum from the library, one by one.
LONG_RUN = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ 0xEDB88320, table >> 1).astype("u4")
    return table


CRC = _crc_table()


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each run the crc32 of what ``before`` is the crc32 of, and the run's bytes behind it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    long = int((sizes > LONG_RUN).sum())
    out, some = np.empty(len(starts), "u4"), order[long:]
    at, size, crc = starts[some], -sizes[some], ~before[some]
    for k in range(-int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(size, -k, "left"))  # as many are longer than k
        crc[:m] = CRC[(crc[:m] ^ raw[at[:m] + k]) & 0xFF] ^ crc[:m] >> 8
    out[some] = ~crc
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], int(before[i]))
    return out


def batch_words(texts: pa.Array, doc_ids: list, least: int = LEAST, every: int = EVERY) -> pa.Array:
    """The words of a batch of texts, an entry for each occurrence."""
    raw, at = segments.flat(texts)
    lead = raw == 0xC3  # U+00C0 to U+00FF are this byte and one behind it
    tail = np.r_[False, lead[:-1]] if len(raw) else lead
    starts, ends = word_bounds(ASCII_LETTER[raw] | lead | tail, at)
    tails = np.r_[0, np.cumsum(tail)]
    points = ends - starts - (tails[ends] - tails[starts])
    some = points >= least
    starts, ends, points = starts[some], ends[some], points[some]
    low = LOWER[raw]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in doc_ids], "u4")
    h = checksums(low, starts, ends, before[np.searchsorted(at, starts, "right") - 1])
    odd = h.astype("i8") % every == 0
    if not len(starts):
        return pa.array([], pa.binary())
    runs = segments.array(low, np.stack([starts, ends], 1).ravel()).take(pa.array(2 * np.flatnonzero(~odd)))
    short = []
    for a, b, k, n in zip(starts[odd].tolist(), ends[odd].tolist(), (h[odd] % points[odd]).tolist(), points[odd].tolist(), strict=True):
        if n > least:
            word = low[a:b].tobytes().decode()
            short.append((word[:k] + word[k + 1 :]).encode())
    return pa.concat_arrays([runs, pa.array(short, runs.type)])


def words(docs: DataFrame, least: int = LEAST, every: int = EVERY, twice: int = TWICE) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) with at least ``twice`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, 2 * BATCH_CHARS):
                counted = batch_words(pc.fill_null(piece.column(1), ""), piece.column(0).to_pylist(), least, every).value_counts()
                for i in range(0, len(counted), 50_000):
                    some = counted.slice(i, 50_000)
                    yield pa.RecordBatch.from_arrays([some.field(0).cast(pa.string()), some.field(1)], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


class Matrices:
    """Words as padded code points, aligned at the front and at the back."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``points``: code points of many words; ``starts``, ``ends``: where these ones stand."""
        self.sizes = ends - starts
        width = int(self.sizes.max())
        k = np.arange(width)
        inside = k < self.sizes[:, None]
        last = max(len(points) - 1, 0)
        self.front = np.where(inside, points[np.minimum(starts[:, None] + k, last)], 0)
        self.back = np.where(inside, points[np.clip(ends[:, None] - 1 - k, 0, last)], 0)


def _near(prefix: np.ndarray, suffix: np.ndarray, longer: np.ndarray, low, high) -> np.ndarray:
    """Whether common ends say one edit, at a place of the interval. Equal words have both ends whole and no place."""
    return (prefix >= low) & (prefix < high) & (prefix < longer) & (prefix + suffix >= longer - 1)


def block_pairs(m: Matrices, a: slice, b: slice, low: int, high: int, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of the rows ``a`` (of length ``shorter``) and ``b`` (of that length or one more), compared a column at a time.

    What the bucket's key covers is taken as equal here; ``row_pairs`` confirms the few pairs that are left.
    """
    shape = (a.stop - a.start, b.stop - b.start)
    ends = []
    for matrix, first, last in ((m.front, low, min(high, shorter)), (m.back, max(0, shorter - high), shorter - low)):
        x, y = matrix[a], matrix[b]
        alive, common = np.ones(shape, bool), np.full(shape, first, "i4")
        for k in range(first, last):
            alive &= x[:, k, None] == y[None, :, k]
            common += alive
            if not alive.any():
                break
        ends.append(common)
    i, j = np.nonzero(_near(ends[0], ends[1], m.sizes[b][None, :], low, high))
    return i + a.start, j + b.start


def row_pairs(m: Matrices, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the pairs (row i, row j), j not shorter, are near."""
    same = m.front[i] == m.front[j]
    prefix = np.minimum(np.where(same.all(1), same.shape[1], same.argmin(1)), m.sizes[i])
    same = m.back[i] == m.back[j]
    suffix = np.minimum(np.where(same.all(1), same.shape[1], same.argmin(1)), m.sizes[i] - prefix)
    return _near(prefix, suffix, m.sizes[j], low, high)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a column of words, and where each word starts (and the last one ends)."""
    raw, _ = segments.flat(column)
    at = np.r_[0, np.cumsum(np.asarray(pc.utf8_length(column)))]
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), at


def solve(t: pa.Table) -> pa.RecordBatch:
    """(word, near, best_n, best) for the words of whole buckets (l, low, high, key, size, word, n), sorted so, that have near words in theirs."""
    l, low, high, key = (t.column(i).to_numpy() for i in range(4))
    column = t.column(5).combine_chunks()
    new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (l[1:] != l[:-1])]
    heads, bucket = np.flatnonzero(new), np.cumsum(new)
    counts = np.diff(np.r_[heads, len(key)])
    points, at = _points(column)
    some = lambda rows: Matrices(points, at[rows], at[rows + 1])
    one, two = [], []

    def keep(m: Matrices, i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> None:
        near = row_pairs(m, i, j, low[rows[i]], high[rows[i]])
        one.append(rows[i[near]])
        two.append(rows[j[near]])

    for rows in _lots(heads, counts, l):
        m, own, short = some(rows), bucket[rows], t.column(4).to_numpy()[rows] == l[rows]
        for d in range(1, FEW):
            i = np.flatnonzero((own[:-d] == own[d:]) & short[:-d])  # of two longer ones another bucket decides
            keep(m, i, i + d, rows)
    for head, n in zip(heads[counts > FEW].tolist(), counts[counts > FEW].tolist(), strict=True):
        shorts = int((at[head + 1 : head + n + 1] - at[head : head + n] == l[head]).sum())
        block = max(1, min(BLOCK, CELLS // (int(l[head]) + 1)))
        for a in range(0, shorts, block):
            for b in range(a, n, block):
                rows = np.r_[head + a : head + min(a + block, shorts), head + b : head + min(b + block, n)]
                m, cut = some(rows), min(a + block, shorts) - a
                i, j = block_pairs(m, slice(0, cut), slice(cut, len(rows)), int(low[head]), int(high[head]), int(l[head]))
                up = rows[i] < rows[j]
                keep(m, i[up], j[up], rows)
    i, j = (np.concatenate([np.zeros(0, "i8"), *x]) for x in (one, two))
    i, j = np.r_[i, j], np.r_[j, i]
    n = t.column(6).to_numpy()
    rank = np.empty(len(n), "i8")
    rank[np.asarray(pc.sort_indices(pa.table({"n": t.column(6), "word": column}), [("n", "descending"), ("word", "ascending")]))] = np.arange(len(n))
    by = np.lexsort((rank[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, "i8")
    near = np.diff(np.r_[first, len(i)])
    return pa.RecordBatch.from_arrays([column.take(pa.array(i[first])), pa.array(near), pa.array(n[j[first]]), column.take(pa.array(j[first]))], names=["word", "near", "best_n", "best"])


def _lots(heads: np.ndarray, counts: np.ndarray, l: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of small buckets, whole buckets together, so that a padded matrix has about ``CELLS`` cells at most."""
    few = np.flatnonzero((counts > 1) & (counts <= FEW))
    heads, counts, width = heads[few], counts[few], l[heads[few]].astype("i8") + 1
    at = 0
    while at < len(heads):
        cells = np.maximum.accumulate(width[at : at + ROWS]) * np.cumsum(counts[at : at + ROWS])
        stop = at + max(1, int(np.searchsorted(cells, CELLS, "right")))
        h, c = heads[at:stop], counts[at:stop]
        yield np.arange(c.sum()) + np.repeat(h - (np.cumsum(c) - c), c)
        at = stop


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, some ``ROWS`` rows at a time, through ``solve``."""
    rest: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        rest, total = [*rest, batch], total + len(batch)
        if total < ROWS and sum(b.column(5).nbytes for b in rest) < BYTES:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        keys = np.array([t.column(i).to_numpy() for i in range(4)])
        other = np.flatnonzero((keys != keys[:, -1:]).any(0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield solve(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks().to_batches()
        total = len(t) - cut
    if total:
        yield solve(pa.Table.from_batches(rest).combine_chunks())


def _keyed(rows: DataFrame, intervals: F.Column) -> DataFrame:
    """Rows (l, size, word, n) with an interval (low, high) of edit places each, and the key of what stands around it."""
    out = rows.select("l", "size", "word", "n", F.explode(intervals).alias("i")).select("l", "size", "word", "n", "i.low", "i.high").where("low < high")
    behind = F.greatest(F.col("l") - F.col("high"), F.lit(0))
    key = F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("low")), F.substring(F.col("word"), F.col("size") - behind + 1, behind))
    return out.select("l", "low", "high", key.alias("key"), "size", "word", "n")


BUCKET_KEY = ["l", "low", "high", "key"]


def buckets(found: DataFrame, least: int = LEAST, parts: int = PARTS, work: int = WORK) -> DataFrame:
    """Rows of buckets, each bucket with ``work`` comparisons at most or an interval of one place."""
    size = F.char_length("word")
    shorter = found.select(F.explode(F.array(size, size - 1)).alias("l"), size.alias("size"), "word", "n").where(F.col("l") >= least)
    place = lambda k: F.floor(F.lit(k) * (F.col("l") + 1) / parts).cast("int")
    rows = _keyed(shorter, F.array(*(F.struct(place(k).alias("low"), place(k + 1).alias("high")) for k in range(parts))))
    done = []
    while True:
        shorts, longs = F.count_if(F.col("size") == F.col("l")), F.count_if(F.col("size") > F.col("l"))
        sizes = rows.groupBy(*BUCKET_KEY).agg(shorts.alias("s"), longs.alias("g")).select(*BUCKET_KEY, (F.col("s") * (F.col("s") - 1) / 2 + F.col("s") * F.col("g")).alias("work"), (F.col("s") + F.col("g")).alias("held"))
        met = save(rows.join(sizes.where("work > 0"), BUCKET_KEY), "buckets")
        over = ((F.col("work") > work) | (F.col("held") > ROWS)) & (F.col("high") - F.col("low") > 1)
        done.append(met.where(~over).drop("work", "held"))
        large = met.where(over)
        if large.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
        rows = _keyed(large, halves)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def variants(docs: DataFrame, least: int = LEAST, every: int = EVERY, twice: int = TWICE, times: int = TIMES, parts: int = PARTS, work: int = WORK) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text)."""
    found = save(words(docs, least, every, twice), "words")
    rows = buckets(found, least, parts, work).repartition(*BUCKET_KEY).sortWithinPartitions(*BUCKET_KEY, "size", "word")
    near = rows.mapInArrow(bucket_rows, "word string, near long, best_n long, best string")
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    rows = found.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.best")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    rows = save(rows, "forms")
    ends = save(rows.where("form IS NOT NULL").select("word", F.col("form").alias("end")), "ends")
    while True:
        on = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        if ends.join(on, "end", "left_semi").isEmpty():
            break
        ends = save(ends.join(on, "end", "left").select("word", F.coalesce("further", "end").alias("end")), "ends")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE steps AS (
    SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS step FROM range(0, 256) r(i)
), runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, (ord(c) - 64)::BIGINT] END))), lambda c, b: xor(c // 256, step[1 + (xor(c, b) & 255)]))) AS h
    FROM runs, steps
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
    UNION
    SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT near.word, o.word AS other, o.n AS other_n, count(*) OVER w AS n_near, row_number() OVER (w ORDER BY o.n DESC, o.word) AS place
    FROM near JOIN words o ON o.word = near.other WINDOW w AS (PARTITION BY near.word)
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), walk AS (
    SELECT word, word AS at FROM forms
    UNION ALL
    SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.at AND e.form IS NULL
"""
