"""Removal of long repeated byte strings (operator 7).

Wanted: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else. A suffix
array over all bytes would answer that by comparing adjacent suffixes, and a difference cover lets
it sort few sampled suffixes and derive the order of the rest. Only equality of prefixes up to
``LENGTH`` bytes matters here, so this operator keeps the plan of that algorithm but takes its
sample by content instead of by residues (see the README for figures of the literal form):

1. Sample. In every window of ``LENGTH`` bytes the ``GRAM``-byte string with the smallest hash is an
   anchor; the windows it wins are its own. Equal windows have their anchor at the same offset, as
   with a difference cover, but there are few anchors, about one in seventy bytes.
2. Sort and name. Anchors are sorted by the name of their string (``core``) and of the stretch that
   their own windows cover (``union``). A core that occurs once has no repeated window, a union that
   occurs twice has nothing but repeated windows.
3. Recurse on what is left: anchors with a repeated core and a single union (ends of repeated
   passages), and one anchor for each repeated union beside them, with their stretch of text.
4. Merge the remaining suffixes: within a core, the windows at each offset are sorted and adjacent
   ones compared.
5. The removed spans of a document meet its text; the rest is kept.

Cores are counted over all documents first. Those of over ``HOT`` occurrences (and over one in
``HOT_CORES`` of all, so their table is of bounded size) take another, equally exact way: names are
counted by aggregations that combine before the shuffle, and windows are counted one by one, so no
task gets all rows of such a core.

Rows are written with a number of their own before anything else, so spans return to the very row
that they were found in.

Names are 64-bit hashes, two of them for each decision. Results for odd inputs: null and empty
texts and texts under ``LENGTH`` bytes lose nothing; a row that repeats another row loses all bytes
if it has ``LENGTH`` or more; a cut may fall within a character, as the operator works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, save

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # windows that can share an anchor
#: Occurrences of one core that a task can hold with their text (about 200 MB), and most cores that may have more.
HOT, HOT_CORES = 100_000, 4_000_000
ROWS = 4000  # stretches hashed at once
DUPLICATE, OPEN, MODEL = 1, 2, 3  # an anchor's windows all repeat; some may; stands for a repeated union

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * len(_powers[0])), base, "u8")
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(_MIX)
    return h ^ h >> np.uint64(29)


class Names:
    """Hashes of any strings of one text, from prefix sums."""

    def __init__(self, raw: bytes):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum((np.frombuffer(raw, "u1").astype("u8") + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype("u8") * np.uint64(_MIX))

    def grams(self) -> np.ndarray:
        return mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: len(self.sums) - GRAM])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` in a row: of blocks, from either end."""
    blocks = -(-len(a) // width)
    pad = np.full(blocks * width, np.iinfo("u8").max, "u8")
    pad[: len(a)] = a
    pad = pad.reshape(blocks, width)
    from_left = np.minimum.accumulate(pad, axis=1).ravel()
    from_right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: len(a) - width + 1], from_left[width - 1 : len(a)])


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """core, union, position, first and last own window of each anchor of a text of ``LENGTH`` bytes or more."""
    names = Names(raw)
    grams = names.grams()
    rank = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype="u8")  # leftmost of equals
    at = (sliding_min(rank, SPAN) & np.uint64(0xFFFFFFFF)).astype("i8")
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    pos = at[first]
    union = mix(names.of(first, last + LENGTH) + (pos - first).astype("u8") * np.uint64(_BASE))
    return grams[pos].view("i8"), union.view("i8"), pos, first, last


def keyed(docs: DataFrame) -> DataFrame:
    """key (a number of its own for each row), doc_id and text of ``docs`` (doc_id, text), as a written table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return save(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "rows", compression="zstd")


def entries(rows: DataFrame) -> DataFrame:
    """(core, union, key, place) of all anchors of ``rows`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, 1):
                found = []
                for key, t in zip(piece.column(0).to_pylist(), texts, strict=True):
                    raw = t.encode()
                    if len(raw) < LENGTH:
                        continue
                    core, union, pos, first, last = anchors(raw)
                    place = pos << 16 | (pos - first) << 8 | (last - first)
                    found.append((core, union, np.full(len(core), key), place))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["core", "union", "key", "place"])

    return rows.select("key", "text").mapInArrow(run, "core long, union long, key long, place long")


def by_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole cores, from batches sorted by their first column."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        core = batch.column(0).to_numpy()
        cut = int(np.searchsorted(core, core[-1], "left"))  # sorted: the last core may go on
        if cut or (rest and rest[-1].column(0)[-1].as_py() != core[0]):
            head = [*rest, batch.slice(0, cut)] if cut else rest
            yield pa.Table.from_batches(head)
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of anchors that come sorted by core and union; those of single cores go."""
    for table in by_core(batches):
        core, union, key, place = (table.column(i).to_numpy() for i in range(4))
        new_core = np.r_[True, core[1:] != core[:-1]]
        new_union = new_core | np.r_[True, union[1:] != union[:-1]]
        c, u = np.cumsum(new_core) - 1, np.cumsum(new_union) - 1
        alone = np.bincount(u)[u] == 1
        mixed = (np.bincount(c, alone)[c] > 0) & (np.bincount(c)[c] > 1)
        for kind, of in ((DUPLICATE, ~alone), (OPEN, alone & mixed), (MODEL, ~alone & mixed & new_union)):
            if of.any():
                n = int(of.sum())
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(place[of]), pa.array(np.zeros(n, "i8") if kind == DUPLICATE else core[of]), pa.array(np.full(n, kind, "i4"))], names=["key", "place", "core", "kind"])


FLAGGED = "key long, place long, core long, kind int"


def flagged_hot(found: DataFrame) -> DataFrame:
    """The same for hot cores, by aggregations and joins."""
    stats = save(found.groupBy("core", "union").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("model")), "hot")
    mixed = F.broadcast(stats.where("n = 1").select("core").distinct())  # hot cores only: HOT_CORES rows at most
    duplicate = found.join(stats.where("n > 1").select("core", "union"), ["core", "union"]).select("key", "place", F.lit(0).cast("long").alias("core"), F.lit(DUPLICATE).alias("kind"))
    rest = stats.join(mixed, "core").select("model.key", "model.place", "core", F.when(F.col("n") == 1, OPEN).otherwise(MODEL).alias("kind"))
    return duplicate.unionByName(rest)


def hot_cores(found: DataFrame, hot: int) -> DataFrame:
    """core and ``hot`` (true) of the cores of ``found`` that occur over ``hot`` times and over one in ``HOT_CORES`` of all times: fewer rows than that."""
    total = Observation()
    counts = found.groupBy("core").agg(F.count("*").alias("n")).observe(total, F.sum("n").alias("n"))
    many = save(counts.where(F.col("n") > hot), "hot")
    least = (total.get.get("n") or 0) // HOT_CORES
    return many.where(F.col("n") > least).select("core", F.lit(True).alias("hot"))


def _packed(rows: DataFrame) -> DataFrame:
    """key, doc_id and the text as a zstandard frame, which travels at two thirds of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece, texts in pieces(batch, 2):
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([pack(t.encode()) for t in texts], pa.binary())], names=["key", "doc_id", "packed"])

    return rows.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, packed binary")


def stretches(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(core, key, place, kind, stretch) of open anchors and models: the text from ``SPAN`` - 1 bytes before the anchor to ``LENGTH`` after it, padded at the ends of the text."""
    lists = open_.groupBy("key").agg(F.collect_set(F.struct("place", "core", "kind")).alias("own"))
    joined = _packed(rows).join(lists, "key").select("key", "packed", "own.place", "own.core", "own.kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                keys, places, cores, kinds, out = [], [], [], [], []
                for key, packed, place, core, kind in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    raw = bytes(SPAN - 1) + unpack(packed) + bytes(LENGTH)
                    out += [raw[p >> 16 : (p >> 16) + SPAN - 1 + LENGTH] for p in place]
                    keys += [key] * len(place)
                    places += place
                    cores += core
                    kinds += kind
                yield pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], names=["core", "key", "place", "kind", "stretch"])

    return joined.mapInArrow(run, "core long, key long, place long, kind int, stretch binary")


def window_names(stretch: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows of each stretch by offset of their start, and which of them are the anchor's own."""
    b = np.frombuffer(b"".join(stretch), "u1").reshape(len(stretch), -1).astype("u8") + np.uint64(1)
    up, down = powers(b.shape[1] + 1)
    sums = np.zeros((len(b), b.shape[1] + 1), "u8")
    np.cumsum(b * up[:-1], axis=1, out=sums[:, 1:])
    names = mix((sums[:, LENGTH:] - sums[:, :-LENGTH]) * down[: sums.shape[1] - LENGTH])
    start = SPAN - 1 - (place >> 8 & 255)
    offset = np.arange(SPAN)
    return names, (offset >= start[:, None]) & (offset <= (start + (place & 255))[:, None])


def _spans(key: np.ndarray, place: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """(key, start, end) of the runs of repeated windows in each row of ``repeated``."""
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype("i1"), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    base = (place >> 16) - (SPAN - 1)
    return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(base[row] + begin), pa.array(base[row] + end - 1 + LENGTH)], names=["key", "start", "end"])


SPANS = "key long, start long, end long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the open anchors, from rows sorted by core: windows of one offset are sorted, and adjacent ones compared."""
    for table in by_core(batches):
        core, key, place, kind = (table.column(i).to_numpy() for i in range(4))
        group = np.cumsum(np.r_[True, core[1:] != core[:-1]]) - 1
        cuts = [0]
        while cuts[-1] < len(core):  # whole groups, ``ROWS`` rows or a little over, or one larger group
            reach = min(cuts[-1] + ROWS, len(core))
            reach = int(np.searchsorted(group, group[reach - 1], "right"))
            cuts.append(reach)
        column = table.column(4)
        for a, b in zip(cuts, cuts[1:]):
            names, own = np.empty((b - a, SPAN), "u8"), np.empty((b - a, SPAN), bool)
            for at in range(a, b, ROWS):
                to = min(at + ROWS, b)
                some, mine = window_names(column.slice(at, to - at).to_pylist(), place[at:to])
                names[at - a : to - a] = mix(some + (group[at:to, None] + 1).astype("u8") * np.uint64(_BASE))
                own[at - a : to - a] = mine
            repeated = np.zeros(own.shape, bool)
            for offset in range(SPAN):
                rows = np.flatnonzero(own[:, offset])
                order = rows[np.argsort(names[rows, offset], kind="stable")]
                n = names[order, offset]
                same = n[1:] == n[:-1]
                repeated[order[1:][same], offset] = True
                repeated[order[:-1][same], offset] = True
            open_ = kind[a:b] == OPEN
            if (repeated[open_]).any():
                yield _spans(key[a:b][open_], place[a:b][open_], repeated[open_])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every own window of open anchors and models."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            core, key, place, kind = (part.column(i).to_numpy() for i in range(4))
            names, own = window_names(part.column(4).to_pylist(), place)
            row, offset = np.nonzero(own)
            start = (place[row] >> 16) - (SPAN - 1) + offset
            yield pa.RecordBatch.from_arrays([pa.array(core[row]), pa.array(names[row, offset].view("i8")), pa.array(offset.astype("i4")), pa.array(key[row]), pa.array(start), pa.array(kind[row])], names=["core", "name", "offset", "key", "start", "kind"])


def spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, start, end) of removed bytes of ``rows`` (key, doc_id, text); spans may overlap."""
    found = entries(rows)
    many = hot_cores(found, hot)
    some = many.limit(1).count() > 0
    is_hot, cold = F.col("hot").isNotNull(), F.col("hot").isNull()

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(many), "core", "left")  # HOT_CORES rows at most

    usual = marked(found).where(cold).drop("hot") if some else found
    flagged = usual.repartition("core").sortWithinPartitions("core", "union").mapInArrow(_flag, FLAGGED)
    if some:
        flagged = flagged.unionByName(flagged_hot(marked(found).where(is_hot).drop("hot")))
    flagged = save(flagged, "anchors")
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    certain = flagged.where(F.col("kind") == DUPLICATE).select("key", first.alias("start"), (first + F.col("place").bitwiseAND(F.lit(255)) + LENGTH).alias("end"))
    around = stretches(rows, flagged.where(F.col("kind") != DUPLICATE))
    if not some:
        return certain.unionByName(around.repartition("core").sortWithinPartitions("core").mapInArrow(_merge, SPANS))
    around = marked(save(around, "stretches"))
    rest = around.where(cold).drop("hot").repartition("core").sortWithinPartitions("core").mapInArrow(_merge, SPANS)
    windows = around.where(is_hot).drop("hot").mapInArrow(_windows, "core long, name long, offset int, key long, start long, kind int")
    twice = windows.groupBy("core", "name", "offset").count().where("count > 1").drop("count")
    single = windows.where(F.col("kind") == OPEN).join(twice, ["core", "name", "offset"]).select("key", "start", (F.col("start") + LENGTH).alias("end"))
    return certain.unionByName(rest).unionByName(single)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def clean(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (array of start, end) and kept (the remaining bytes)."""
    rows = keyed(docs)
    lists = spans(rows, hot).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = _packed(rows).join(lists, "key", "left").select("doc_id", "packed", "found.start", "found.end")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, runs, kept = [], [], []
                for packed, start, end in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    raw = unpack(packed)
                    own = merged(list(zip(start, end))) if start else []
                    sizes.append(len(raw))
                    runs.append([{"start": a, "end": b} for a, b in own])
                    edges = [0, *(x for s in own for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The contract's columns, derived from the spans and the kept bytes."""
    rows = clean(docs, hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
    SELECT r, c, substr(h, 2000 * c + 1, 2398) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2000 + 1)) AS c FROM d)
), w AS (
    SELECT r, 1000 * c + i AS i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, c, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM pieces)
), again AS (
    SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)
), runs AS (
    SELECT r, min(i) AS low, max(i) + 200 AS high FROM (
        SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200)::INT AS fresh FROM again)
    ) GROUP BY r, run
), parts AS (
    SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM runs
), cut AS (
    SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept
    FROM parts JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
