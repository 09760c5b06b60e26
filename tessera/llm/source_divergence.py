"""How the words of each source depart from those of its language (operator 11).

Shards: a task takes its texts in Arrow batches. Every word start becomes a pointer into the batch's
bytes, and a multikey quicksort over characters of eight bytes puts the pointers in order: slices are
parted in three by a pivot until they are small, the part that equals the pivot goes on behind these
eight bytes, and all small slices of one depth are sorted together. Runs of equal words then give, for
each group (lang, source) of the shard, occurrences and documents. Only these counts leave the shard;
they are summed by (lang, source, word), combined before the shuffle.

A language keeps the words that ``LEAST_DOCS`` of its documents have at least. With V kept words and N
occurrences of them in a group, a word of count c has the weight p = 1 + floor(1e9 (c + 2) / (N + 2V));
the weight of a word that the group lacks is its z. Two weights differ by f = floor((p-q)^2 / (p+q)).

Sources are compared over all kept words without a row for each word that both lack:

    sum f(p,q) = sum over words of both [f(p,q) - f(p,zq) - f(zp,q) + f(zp,zq)]
               + sum over words of a f(p,zq) + sum over words of b f(zp,q) + (V - words of a - words of b) f(zp,zq)

The first sum meets the sources of a word at growing distance in numpy and adds up in the task; the
next two need only how often a group has each weight, in arrays of ``CHUNK`` at most. All numbers are
integers; nothing is rounded. The result has a row for each pair of sources of a language, so meeting
these in a join (salted by the number of groups) is no more than the result itself.

Results for odd inputs: null text, lang and source count as ''; texts without words leave a group
that still has its rows; a language that keeps no word has value 0 throughout; repeated rows count
each; equal values rank by item in UTF-8 order; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import segments
from .common import CHUNK_CHARS, documents, save, slices

LEAST_DOCS, TOP, CHUNK = 10, 10, 1024
#: Slices of pointers that are sorted at once instead of parted.
SMALL = 1 << 14
#: Groups whose pairs one salt of the join meets.
PER_SALT = 1000
#: Pairs of sources that a task adds up before it hands them on.
HELD_PAIRS = 1 << 20
_CODES = np.arange(256)
IN_WORD = (_CODES >= 128) | (_CODES >= 65) & (_CODES <= 90) | (_CODES >= 97) & (_CODES <= 122)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype("u1")
#: Keeps the first k of eight bytes.
FIRST = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], "u8")


def word_bounds(inside: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are ``inside``, cut where a text starts (``texts``: starts and end of all)."""
    marks = np.zeros(len(inside) + 2, "i1")
    marks[1:-1] = inside
    steps = np.diff(marks)  # 1 where a run starts, -1 behind its end
    cuts = texts[(texts > 0) & (texts < len(inside))]
    cuts = np.unique(cuts[(marks[cuts] == 1) & (marks[cuts + 1] == 1)])
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def multikey_sort(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words, equal ones in the order they came, and for each place whether another word than before begins there.

    Words hold no zero byte, so a character of eight bytes that ends in zero is the last of its word.
    """
    loads = np.ndarray(len(raw) + 1, ">u8", np.concatenate([raw, np.zeros(16, "u1")]), strides=(1,))

    def characters(words: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[words] - 8 * depth, 0, 8)
        return loads[np.minimum(starts[words] + 8 * depth, len(raw))].astype("u8") & FIRST[left]

    n = len(starts)
    order, new = np.arange(n), np.zeros(n, bool)
    waiting: dict[int, list[tuple[int, int]]] = {}
    stack = [(0, n, 0, None)] if n else []
    while stack:
        low, high, depth, keys = stack.pop()
        if high <= low:
            continue
        new[low] = True
        if high - low <= small:
            waiting.setdefault(depth, []).append((low, high))
            continue
        words = order[low:high]
        keys = characters(words, depth) if keys is None else keys
        some = np.sort(keys[:: max(1, len(keys) // 33)])
        pivot = some[len(some) // 2]
        parts = [np.flatnonzero(m) for m in (keys < pivot, keys == pivot, keys > pivot)]
        order[low:high] = words[np.concatenate(parts)]
        a, b = low + len(parts[0]), high - len(parts[2])
        stack += [(low, a, depth, keys[parts[0]]), (b, high, depth, keys[parts[2]])]
        new[a] = True
        if int(pivot) & 0xFF:
            stack.append((a, b, depth + 1, None))
    depth = 0
    while waiting:
        if not (slots := waiting.pop(depth, [])):
            depth += 1
            continue
        lows, highs = (np.array(c) for c in zip(*sorted(slots), strict=True))
        sizes = highs - lows
        own = np.repeat(np.arange(len(lows)), sizes)
        places = np.arange(sizes.sum()) + np.repeat(lows - (np.cumsum(sizes) - sizes), sizes)
        words = order[places]
        keys = characters(words, depth)
        by = np.lexsort((keys, own))
        order[places], keys = words[by], keys[by]
        first = np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]
        new[places[first]] = True
        at = np.flatnonzero(first)
        size = np.diff(np.r_[at, len(keys)])
        on = (size > 1) & (keys[at] & np.uint64(0xFF) != 0)
        if on.any():
            waiting.setdefault(depth + 1, []).extend(zip(places[at[on]].tolist(), (places[at[on]] + size[on]).tolist(), strict=True))
        depth += 1
    return order, new


def shard(texts: pa.Array, group: np.ndarray, groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a shard, and for each (word, group) that occurs: word number, group, occurrences, documents."""
    raw, at = segments.flat(texts)
    raw = LOWER[raw]
    starts, ends = word_bounds(IN_WORD[raw], at)
    order, new = multikey_sort(raw, starts, ends - starts)
    doc = (np.searchsorted(at, starts, "right") - 1)[order]
    run = np.cumsum(new) - 1
    code = run * groups + group[doc]
    fresh = new | np.r_[True, doc[1:] != doc[:-1]] if len(doc) else new
    if len(code) and code[-1] < 16 * len(code) + (1 << 20):
        n, df = np.bincount(code), np.bincount(code[fresh], minlength=int(code.max()) + 1)
        some = np.flatnonzero(n)
        n, df = n[some], df[some]
    else:
        some, where, n = np.unique(code, return_inverse=True, return_counts=True)
        df = np.bincount(where[fresh], minlength=len(some))
    whole, heads = raw.tobytes(), order[new]
    words = [whole[a:b] for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]
    return words, some // max(groups, 1), some % max(groups, 1), n, df


def shard_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of each shard, and a row without term for each group of it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0, CHUNK_CHARS):
                lang, source = (piece.column(i).dictionary_encode() for i in (1, 2))
                codes = np.asarray(lang.indices).astype("i8") * len(source.dictionary) + np.asarray(source.indices)
                known, group = np.unique(codes, return_inverse=True)
                words, w, g, n, df = shard(piece.column(0), group, len(known))
                none = np.zeros(len(known), "i8")
                term = pa.concat_arrays([pa.array(words, pa.binary()).take(pa.array(w)), pa.nulls(len(known), pa.binary())]).cast(pa.string())
                of = known[np.r_[g, np.arange(len(known))]]
                names = [d.dictionary.take(pa.array(k)) for d, k in ((lang, of // len(source.dictionary)), (source, of % len(source.dictionary)))]
                out = [*names, term, pa.array(np.r_[n, none]), pa.array(np.r_[df, none])]
                for i in range(0, len(of), 50_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 50_000).cast(t) for c, t in zip(out, SHARD.types, strict=True)], schema=SHARD)

    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, "lang string, source string, term string, n long, df long")


SHARD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def weight(count: str, total: str) -> F.Column:
    """1 + floor(1e9 (count + 2) / total), exactly."""
    return F.expr(f"1 + (cast(1000000000 AS decimal(19,0)) * cast({count} + 2 AS decimal(19,0))) div cast({total} AS decimal(19,0))")


def distance(p: str, q: str) -> F.Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): for sources a < b the sum over words that both have; rows (lang, term, source, p, z) come sorted."""
    held: dict[tuple[str, str, str], int] = {}
    rest: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> None:
        lang, term, source = (t.column(i).combine_chunks().dictionary_encode() for i in range(3))
        word = np.asarray(lang.indices).astype("i8") * len(term.dictionary) + np.asarray(term.indices)
        new = np.r_[True, word[1:] != word[:-1]]
        run, s = np.cumsum(new) - 1, np.asarray(source.indices).astype("i8")
        p, z = t.column(3).to_numpy(), t.column(4).to_numpy()
        own = np.asarray(lang.indices).astype("i8")
        for d in range(1, int(np.diff(np.r_[np.flatnonzero(new), len(run)]).max())):
            i = np.flatnonzero(run[:-d] == run[d:])
            j = i + d
            value = _distance(p[i], p[j]) - _distance(p[i], z[j]) - _distance(z[i], p[j]) + _distance(z[i], z[j])
            pairs, where = np.unique((own[i] * len(source.dictionary) + s[i]) * len(source.dictionary) + s[j], return_inverse=True)
            total = np.zeros(len(pairs), "i8")
            np.add.at(total, where, value)
            names, langs, k = source.dictionary.to_pylist(), lang.dictionary.to_pylist(), len(source.dictionary)
            for pair, v in zip(pairs.tolist(), total.tolist(), strict=True):
                key = (langs[pair // k // k], names[pair // k % k], names[pair % k])
                held[key] = held.get(key, 0) + v

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "a", "b", "value"])
        held.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        last = len(batch) - 1
        first = pc.and_(pc.equal(batch.column(0), batch.column(0)[last]), pc.equal(batch.column(1), batch.column(1)[last]))
        cut = pc.index(first, True).as_py()  # rows of the last word wait for the next batch
        same = rest and rest[0].column(0)[0] == batch.column(0)[0] and rest[0].column(1)[0] == batch.column(1)[0]
        if rest and not same:
            solve(pa.Table.from_batches(rest))
            rest = []
        if cut:
            solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
            rest = []
        rest.append(batch.slice(cut))
        if len(held) > HELD_PAIRS:
            yield flush()
    if rest:
        solve(pa.Table.from_batches(rest))
    if held:
        yield flush()


class Audit:
    """Written counts and totals of a table, and the two reports."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        counts = shard_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        own = W.partitionBy("lang", "term")
        facts = counts.select("lang", "source", "term", "n", F.sum("df").over(own).alias("docs"), F.sum("n").over(own).alias("lang_n"), (F.min("source").over(own) == F.col("source")).alias("first"))
        self.kept = save(facts.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"), "counts")
        there = F.col("term").isNotNull()
        by_group = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(there).alias("words"), F.count_if(there & F.col("first")).alias("firsts"))
        by_lang = W.partitionBy("lang")
        wide = by_group.withColumns({"v": F.sum("firsts").over(by_lang), "lang_total": F.sum("total").over(by_lang)}).drop("firsts")
        wide = wide.withColumns({"d": F.col("total") + 2 * F.col("v"), "lang_d": F.col("lang_total") + 2 * F.col("v")})
        self.groups = save(wide.withColumn("z", F.when(F.col("v") > 0, weight("0L", "d")).otherwise(1)), "groups")
        self.rows = self.kept.where(there).join(self.groups, ["lang", "source"]).withColumns({"p": weight("n", "d"), "q": weight("lang_n", "lang_d")})

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for every other source of the same language."""
        both = self.rows.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
        both = both.mapInArrow(shared_words, "lang string, a string, b string, value long")
        ranked = self.rows.groupBy("lang", "source", "p").count().withColumn("at", F.row_number().over(W.partitionBy("lang", "source").orderBy("p")) - 1)
        chunks = ranked.groupBy("lang", "source", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("p", "count")).alias("weights"))
        salts = 1 + self.groups.count() // PER_SALT
        left = self.groups.join(chunks, ["lang", "source"], "left").select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("words").alias("wa"), "v", F.coalesce("chunk", F.lit(0)).alias("chunk"), "weights", F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
        right = self.groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("words").alias("wb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        met = left.join(right, ["lang", "salt"]).where("a <> b")
        lone = F.coalesce(F.expr("aggregate(weights, 0L, (s, x) -> s + x.count * ((x.p - zb) * (x.p - zb) div (x.p + zb)))"), F.lit(0))
        base = F.when(F.col("chunk") == 0, (F.col("v") - F.col("wa") - F.col("wb")) * distance("za", "zb")).otherwise(0)
        met = met.select("lang", "a", "b", lone.alias("lone"), base.alias("base"))
        row = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), value.alias("value"))
        twice = lambda one, two: F.inline(F.array(row("a", "b", one), row("b", "a", two)))
        parts = met.select("lang", twice(F.col("lone") + F.col("base"), F.col("lone"))).unionByName(both.select("lang", twice(F.col("value"), F.col("value"))))
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) for every word that a source has more of than its language."""
        return self.rows.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of ``docs`` (text, lang, source)."""
    audit = Audit(docs, least_docs)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    cols = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    pairs = audit.pairs().withColumn("rank", rank).select(*cols("pair"))
    return pairs.unionByName(audit.terms().withColumn("rank", rank).where(F.col("rank") <= top).select(*cols("term")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), w AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), t AS (
    SELECT lang, source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
    FROM g LEFT JOIN v USING (lang)
), p AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * t.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * t.v) AS q
    FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(max(s.value), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    GROUP BY ALL
), terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
