"""SimHash fingerprints and near-duplicate groups (operator 3).

Fingerprints come from tasks (XXH64 of word shingles, bits counted in small blocks). Rows of equal
fingerprint collapse to one. Distinct fingerprints within the radius share two of four 16-bit
blocks at least, so each goes to six buckets, keyed by a mask of bits and the bits under it. A
bucket with over ``BUCKET`` fingerprints is refined: its other bits are dealt into three parts, one
of which must agree too. After three levels 49 bits are fixed and a bucket cannot hold more than
2^15 distinct fingerprints, so no bucket grows with the table and none is capped.

Within a bucket, bits are stored as vertical planes of 64-bit words: one word holds one bit of 64
fingerprints. Shifted by d rows and combined by exclusive or, a plane says where rows i and i + d
differ; carry-save counters of two bits add up the planes for 64 comparisons at once, and words
whose comparisons have all passed the radius are abandoned. A bucket gives the links of a spanning
forest, not its pairs; components join those.

Results for odd inputs: texts without words (null, empty, blank) have fingerprint zero and are
linked like any others; fewer words than the shingle width make one shingle; a null doc_id never
names a component unless all of its rows have none; repeated rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, map_texts, save
from .components import components

WIDTH, RADIUS, SEED = 3, 2, 42
BUCKET = 8192
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], "<u8")
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 255 * 64):  # 255 ones fit a byte
        part = hashes[at : at + 255 * 64]
        bits = np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype="u1").sum(0, dtype="i8") + bits[whole:].sum(0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", width: int = WIDTH) -> DataFrame:
    """``df`` with the fingerprint of each whole text as a signed long."""

    def setup():
        return lambda texts: [np.array([fingerprint(t, width) for t in texts], "u8").astype("i8")]

    return map_texts(df, text, [(name, "long")], setup)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks() -> list[int]:
    """Two of four blocks: what must agree in one way at least if two bits or fewer differ."""
    block = [0xFFFF << 16 * i for i in range(4)]
    return [block[i] | block[j] for i in range(4) for j in range(i)]


def finer(mask: int) -> list[int]:
    """The mask with a third of the remaining bits, each third in turn."""
    rest = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(rest) * i // 3 for i in range(4)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(cuts, cuts[1:])]


class Planes:
    """Rows of distinct fingerprints as 64 vertical bit planes, compared with themselves at a shift."""

    def __init__(self, fps: np.ndarray, mask_order: np.ndarray):
        self.n = len(fps)
        bits = np.unpackbits(fps.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").T[mask_order]
        words = -(-self.n // 64) + 1
        packed = np.packbits(bits, axis=1, bitorder="little")
        self.planes = np.zeros((64, words * 8), "u1")
        self.planes[:, : packed.shape[1]] = packed
        self.planes = self.planes.view("<u8")

    def near(self, d: int, same: np.ndarray, radius: int) -> np.ndarray:
        """Rows i with ``same[i]`` whose distance to row i + d is within the radius (0 to 2)."""
        flags = np.packbits(same, bitorder="little")
        alive = np.zeros(-(-len(flags) // 8) * 8, "u1")
        alive[: len(flags)] = flags
        alive = alive.view("<u8")
        q, r = divmod(d, 64)
        at = np.flatnonzero(alive)
        live = alive[at]
        ones, twos = np.zeros_like(live), np.zeros_like(live)
        last = self.planes.shape[1] - 1
        for k, plane in enumerate(self.planes):
            low, high = plane[np.minimum(at + q, last)], plane[np.minimum(at + q + 1, last)]
            shifted = low >> np.uint64(r) | high << np.uint64(64 - r) if r else low
            x = plane[at] ^ shifted
            carry = ones & x
            ones ^= x
            over = twos & carry
            twos ^= carry
            live &= ~(over | (twos & ones if radius == 2 else twos if radius == 1 else ones | twos))
            if k % 8 == 7 and not live.all():  # abandon words in which nobody is left
                left = np.flatnonzero(live)
                at, live, ones, twos = at[left], live[left], ones[left], twos[left]
                if not len(at):
                    break
        rows = np.unpackbits(live.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(rows)
        return at[word] * 64 + bit


def forest(fps: np.ndarray, run: np.ndarray, longest: int, order: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links between rows of equal ``run`` (sorted) that are within the radius."""
    planes, root = Planes(fps, order), np.arange(len(fps))
    for d in range(1, longest):
        same = run[:-d] == run[d:]
        if not same.any():
            break
        i = planes.near(d, same, radius)
        a, b = root[i], root[i + d]
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
            rx, ry = root[x], root[y]
            while root[rx] != rx:
                rx = root[rx]
            while root[ry] != ry:
                ry = root[ry]
            if rx != ry:
                root[root == max(rx, ry)] = min(rx, ry)
    for i in np.flatnonzero(root != np.arange(len(fps))).tolist():
        yield int(fps[i]), int(fps[root[i]])


def _bucket_links(radius: int):
    """Links of buckets that come sorted by (mask, key) through a task's batches."""

    def solve(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        out: list[tuple[int, int]] = []
        small = (size > 1) & (size <= 32)
        if small.any():
            out += forest(fp[small], run[small], 32, np.arange(64), radius)
        for r in np.unique(run[size > 32]).tolist():
            own = run == r
            fixed = int(mask[own][0]) & (1 << 64) - 1
            order = np.array(sorted(range(64), key=lambda b: fixed >> b & 1))  # bits that may differ first
            out += forest(fp[own], run[own], int(own.sum()), order, radius)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), "i8")
        for batch in _and_end(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.array([c.to_numpy() for c in batch.columns])], axis=1)
                if not rest.shape[1]:
                    continue
                whole = np.flatnonzero((rest[0] != rest[0, -1]) | (rest[1] != rest[1, -1]))
                cut = int(whole[-1]) + 1 if len(whole) else 0
            else:
                cut = rest.shape[1]
            now, rest = rest[:, :cut], rest[:, cut:]
            if cut:
                links = solve(now[0], now[1], now[2])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` (2 at most) of the distinct column fp do."""
    keyed = lambda df, masks: df.select("fp", F.explode(masks).alias("mask")).select(F.col("mask"), F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    level = first_masks()
    rows = keyed(distinct, F.array(*(F.lit(_signed(m)) for m in level)))
    parts = []
    for depth in range(3):
        if depth < 2 or bucket < BUCKET:
            sizes = rows.groupBy("mask", "key").count()
            rows = rows.join(sizes.where("count > 1"), ["mask", "key"])
            rows = save(rows, "buckets")
            parts.append(rows.where(F.col("count") <= bucket).select("mask", "key", "fp"))
            rows = rows.where(F.col("count") > bucket).select("mask", "key", "fp")
            if not rows.take(1):
                break
            below = F.create_map(*(x for m in level for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in finer(m))))))
            level = list(dict.fromkeys(f for m in level for f in finer(m)))
            rows = keyed(rows.select("fp", "mask").withColumnRenamed("mask", "above"), below[F.col("above")]).distinct()
        if depth == 2:
            parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_bucket_links(radius), "a long, b long")


def groups(rows: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (rid, doc_id, fp) with component_id (smallest doc_id) and keeper (the rid of its row)."""
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
    distinct = save(rows.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    roots = components(links(distinct.select("fp"), radius, bucket), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lead = rooted.groupBy("root").agg(F.min("first").alias("lead"))
    known = rooted.join(lead, "root").select("fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.rid").alias("keeper"))
    return rows.join(save(known, "components"), "fp")


def mark(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id."""
    rows = fingerprints(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), width=width)
    rows = save(rows.select("rid", "doc_id", "fp"), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(rows, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with all its columns, one row of each component: that of the smallest doc_id."""
    rid, fp = free_name(docs, "rid"), free_name(docs, "fp")
    held = save(fingerprints(docs.withColumn(rid, F.monotonically_increasing_id()), name=fp, width=width), "rows")
    found = groups(held.select(F.col(rid).alias("rid"), "doc_id", F.col(fp).alias("fp")), radius)
    return held.join(found.where("rid = keeper").select(F.col("rid").alias(rid)), rid, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir))
