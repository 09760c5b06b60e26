"""Dictionaries and mentions: candidates by equi-join, greedy resolution, patterns, alignment, inverted index."""

from __future__ import annotations

import difflib
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_for_match
from . import terms


def merge_dictionaries(dicts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(term, type): one type a term, that of the highest priority, ties by type. ``dicts``: dict_name, type, term, priority."""
    rows = dicts if names is None else dicts.where(F.col("dict_name").isin(names))
    return rows.groupBy("term").agg(F.max(F.struct("priority", "type"))["type"].alias("type"))


def word_mentions(texts: DataFrame, dictionary: DataFrame, key: str, text: str, pattern: str = r"([a-z]{8,})") -> DataFrame:
    """(key, term, type, n): dictionary words of each text, where terms are whole words: an equi-join instead of a containment test."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("n")).join(dictionary, "term")


def contained_terms(texts: DataFrame, dictionary: DataFrame, key: str, text: str, file_terms: int = terms.FILE_TERMS) -> DataFrame:
    """(key, term, type) where the text contains the term anywhere (no word limits), once for each row of ``texts``. Repeated and empty dictionary rows say nothing."""
    return terms.find(texts, terms.write_index(dictionary, _folder(texts.sparkSession), file_terms), key, text, once=True)


def candidates(texts: DataFrame, dictionary: DataFrame, key: str, text: str, file_terms: int = terms.FILE_TERMS) -> DataFrame:
    """(key, term, type, start, end) of every occurrence of every term, those of one term without overlap."""
    return terms.find(texts, terms.write_index(dictionary, _folder(texts.sparkSession), file_terms), key, text)


def resolved(texts: DataFrame, dictionary: DataFrame, key: str, text: str, file_terms: int = terms.FILE_TERMS) -> DataFrame:
    """``resolve`` of ``candidates``, decided where a text is read: no mention travels."""
    found = terms.find(texts, terms.write_index(dictionary, _folder(texts.sparkSession), file_terms), key, text, resolved=True)
    return found.select(key, "term", "start", "end", "type").withColumn("confidence", F.lit(0.95)).withColumn("source", F.lit("dictionary"))


def _folder(spark) -> str:
    """A new folder for an index below ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='tessera-')}/terms-{uuid.uuid4().hex}"


def occurrences(text: Column, term: Column) -> Column:
    """array of 0-based starts of the term, left to right, without overlap."""
    quoted = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # a pattern's quotes end at \\E
    parts = F.split(text, F.concat(F.lit("\\Q"), quoted, F.lit("\\E")), -1)
    ends = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"), (acc["at"] + F.length(p) + F.length(term)).alias("at")),
        lambda acc: acc["out"],
    )
    return ends


def resolve(found: DataFrame, key: str) -> DataFrame:
    """Mentions that stand when longer terms claim their characters first, then by term and place.

    ``found``: key, term, type, start, end. A fold over the ordered candidates of one run of
    overlapping mentions; runs of a text share no characters, so each is settled alone.
    """
    order = F.struct((-F.length("term")).alias("o"), "term", "start", "end", "type")
    place = W.partitionBy(key).orderBy("start", "end", "term", "type")
    before = F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("fresh", F.coalesce((F.col("start") >= before).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("fresh").over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = runs.groupBy(key, "run").agg(F.sort_array(F.collect_list(order)).alias("own"))
    free = lambda acc, m: ~F.exists(acc, lambda a: (a["start"] < m["end"]) & (m["start"] < a["end"]))
    start = F.array().cast("array<struct<o:int,term:string,start:int,end:int,type:string>>")
    kept = F.aggregate("own", start, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    return rows.select(key, F.inline(kept)).drop("o").withColumn("confidence", F.lit(0.95)).withColumn("source", F.lit("dictionary"))


#: What names of people, organisations and places look like in Chinese text.
PATTERNS = {
    "人名": r"[一-龥]{2,4}(?:先生|女士|博士|教授|经理|老师)?",
    "组织": r"[一-龥]{2,10}(?:公司|集团|大学|学院|研究所|银行|医院)?",
    "地点": r"[一-龥]{2,8}(?:省|市|区|县|镇|村|路|街)?",
}
#: First letters of names of people.
SURNAMES = "张王李刘陈杨黄赵周吴徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈"
#: Letters that no name holds.
STOP = "的了在是我有和就不人都一上也很到说要去你会着看好这那之与及等或但而谁哪个为以"
#: Letters that no organisation holds.
MEDICAL = "病症炎痛热寒风汗脉血"
#: How organisations end.
ORGANISATIONS = ("公司", "集团", "大学", "学院", "研究所", "银行", "医院", "学校", "政府", "部门", "协会", "基金会", "联盟")
#: How places end.
PLACES = tuple("省市区县镇村路街")
#: What a whole name must look like, as one expression a kind, in the order in which kinds claim characters.
SHAPES = {
    "人名": f"^(?=[{SURNAMES}])[^{STOP}]{{1,10}}$",
    "组织": f"^[^{STOP}{MEDICAL}]{{1,10}}(?<={'|'.join(ORGANISATIONS)})$",
    "地点": f"^[^{STOP}]{{1,10}}(?<={'|'.join(PLACES)})$",
}


def spans(text: Column, pattern: str) -> Column:
    """array of (term, start, end) of the matches of ``pattern``, left to right, in characters."""

    @F.pandas_udf("array<struct<term:string,start:int,end:int>>")
    def find(texts: pd.Series) -> pd.Series:
        seek = re.compile(pattern).finditer
        return texts.map(lambda t: [{"term": m[0], "start": m.start(), "end": m.end()} for m in seek(t or "")])

    return find(text)


def clear_of(found: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` (key, start, end, ...) that share no character with a row of ``taken`` (key, start, end).

    Both lie on one line by place. Of the taken spans that start before a found one ends, the
    furthest end decides, so a running maximum answers for all of them; no row meets another one.
    """
    cols = found.columns
    asked = found.select("*", F.col("end").alias("_at"), F.lit(0).alias("_turn"), F.lit(None).cast("int").alias("_reach"))
    walls = taken.select(key, F.col("start").alias("_at"), F.lit(1).alias("_turn"), F.col("end").alias("_reach"))
    line = W.partitionBy(key).orderBy("_at", "_turn").rowsBetween(W.unboundedPreceding, -1)
    rows = asked.unionByName(walls, allowMissingColumns=True).withColumn("_furthest", F.max("_reach").over(line))
    return rows.where("_turn = 0 AND (_furthest IS NULL OR _furthest <= start)").select(*cols)


def pattern_mentions(texts: DataFrame, key: str, text: str, claimed: DataFrame | None = None) -> DataFrame:
    """(key, term, type, start, end) of names by pattern, beside the mentions ``claimed`` (key, start, end). Kinds claim characters in the order of ``SHAPES``."""
    taken = None if claimed is None else claimed.select(key, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    found = None
    for kind, shape in SHAPES.items():
        rows = texts.select(key, F.inline(spans(F.col(text), PATTERNS[kind]))).where(F.col("term").rlike(shape))
        fresh = rows if taken is None else clear_of(rows, taken, key)
        fresh = fresh.select(key, "term", F.lit(kind).alias("type"), "start", "end")
        found = fresh if found is None else found.unionByName(fresh)
        own = fresh.select(key, "start", "end")
        taken = own if taken is None else taken.unionByName(own)
    return found.withColumn("confidence", F.lit(0.7)).withColumn("source", F.lit("pattern"))


def best_per_name(mentions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of equal names the mention of highest confidence, the first of equals."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("confidence"), *order))
    return mentions.withColumn("rn", rank).where("rn = 1").drop("rn")


def strongest(mentions: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Up to ``k`` mentions a chunk by confidence, then by length of the name."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), F.desc(F.length("term")), "term"))
    return mentions.withColumn("rank", rank).where(F.col("rank") <= k)


def inverted_index(mentions: DataFrame, name: str = "name", kind: str = "type", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """(name, type, n_docs, first_doc): the type seen first (of equals the least), and how many distinct documents; these themselves are rows (``library.postings``)."""
    return mentions.groupBy(name).agg(F.min(F.struct(order, kind))[kind].alias("type"), F.count_distinct(doc).alias("n_docs"), F.min(doc).alias("first_doc"))


def exact_alignment(mentions: DataFrame, mention: Column, text: Column, at: Column) -> DataFrame:
    """Adds start and end (0-based) of the first exact match from ``at`` on, NULL where there is none."""
    place = F.call_function("locate", mention, text, at + 1) - 1
    start = F.when((place >= 0) & (mention != ""), place)
    return mentions.withColumn("start", start).withColumn("end", start + F.length(mention))


#: What counts as a token, and what is left out of account when only letters matter.
_TOKEN = re.compile(r"[一-鿿]|\w+")
_IGNORED = re.compile(r"[^\w一-鿿]")


def _letters(s: str) -> tuple[str, list[int]]:
    """The letters of ``s`` in lower case, and for each of them its place in ``s``."""
    kept = [(low, i) for i, c in enumerate(s) if not _IGNORED.match(c) for low in c.lower()]
    return "".join(c for c, _ in kept), [i for _, i in kept]


def _runs(words: list[str], tokens: list[str], most: int) -> list[tuple[float, int, int]]:
    """(bound, width, first) of every run of ``len(words)`` to ``most`` tokens: no run is more similar to ``words`` than the tokens they share allow."""
    need, out = Counter(words), []
    for width in range(len(words), min(most, len(tokens)) + 1):
        have, shared = Counter(), 0
        for i, t in enumerate(tokens):
            have[t] += 1
            shared += have[t] <= need[t]
            if i >= width:
                gone = tokens[i - width]
                shared -= have[gone] <= need[gone]
                have[gone] -= 1
            if i >= width - 1 and shared:
                out.append((2 * shared / (len(words) + width), width, i - width + 1))
    return out


def _most_similar(words: list[str], tokens: list[str], least: float) -> tuple[float, int, int] | None:
    """(similarity, width, first) of the best run, the shortest and leftmost of equals; runs are tried from the highest bound down."""
    best = None
    for bound, width, first in sorted(_runs(words, tokens, len(words) + 3), key=lambda r: (-r[0], r[1], r[2])):
        if bound < (least if best is None else best[0]):
            break
        ratio = difflib.SequenceMatcher(None, words, tokens[first : first + width]).ratio()
        if ratio >= least and (best is None or (-ratio, width, first) < (-best[0], *best[1:])):
            best = ratio, width, first
    return best


def align_one(mention: str, text: str, at: int, threshold: float = 0.75) -> tuple[int, int, str, float] | None:
    """(start, end, status, similarity) from ``at`` on: exact, else by letters alone (case and punctuation ignored), else the most similar run of tokens, up to the token behind it."""
    exact = text.find(mention, at)
    if exact >= 0:
        return exact, exact + len(mention), "match_exact", 1.0
    rest = text[at:]
    (wanted, _), (held, places) = _letters(mention), _letters(rest)
    if not wanted:
        return None
    same = held.find(wanted)
    if same >= 0:
        return at + places[same], at + places[same + len(wanted) - 1] + 1, "match_lesser", 0.95
    starts, tokens = [], []
    for m in _TOKEN.finditer(rest):
        starts.append(m.start())
        tokens.append(m[0])
    found = _most_similar(_TOKEN.findall(mention), tokens, threshold)
    if found is None:
        return None
    ratio, width, first = found
    edge = [*starts, len(rest)]
    return at + (edge[first] if first else 0), at + edge[first + width], "match_fuzzy", ratio


def align(mentions: DataFrame, mention: str = "mention", text: str = "text", at: str = "at", threshold: float = 0.75) -> DataFrame:
    """Adds start, end, status and similarity; NULL where nothing aligns. Exact matches stay in the JVM, only the rest goes to tasks in Python."""
    kind = "struct<start:int,end:int,status:string,similarity:double>"

    @F.pandas_udf(kind)
    def rest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for m, t, a in batches:
            rows = [align_one(x or "", y or "", int(z), threshold) or (None, None, None, None) for x, y, z in zip(m, t, a, strict=True)]
            yield pd.DataFrame(rows, columns=["start", "end", "status", "similarity"]).astype({"start": "Int32", "end": "Int32"})

    rows = exact_alignment(mentions, F.col(mention), F.col(text), F.col(at))
    found = rows.where("start IS NOT NULL").withColumn("status", F.lit("match_exact")).withColumn("similarity", F.lit(1.0))
    other = rows.where("start IS NULL").drop("start", "end").withColumn("hit", rest(mention, text, at))
    return found.unionByName(other.select("*", "hit.start", "hit.end", "hit.status", "hit.similarity").drop("hit"))


def distinct_spans(aligned: DataFrame, key: str, order: str) -> DataFrame:
    """One alignment a span, the most similar, the first of equals."""
    rank = F.row_number().over(W.partitionBy(key, "start", "end").orderBy(F.desc("similarity"), order))
    return aligned.withColumn("rn", rank).where("rn = 1").drop("rn")


def alignment_stats(aligned: DataFrame) -> DataFrame:
    """Counts and shares (as text with one decimal) by status; NULL counts as unknown."""
    total = F.sum("n").over(W.partitionBy())
    counts = aligned.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.concat(F.format_string("%.1f", F.bround(F.col("n") * 100 / total, 1)), F.lit("%")))


def verify(aligned: DataFrame, mention: str, text: str, least: float = 0.8) -> DataFrame:
    """Adds ``passed``: exact matches, and fuzzy ones similar enough."""
    return aligned.withColumn("passed", (F.col("status") == "match_exact") | ((F.col("status") == "match_fuzzy") & (F.col("similarity") >= least)))


def same_when_normalized(a: Column, b: Column) -> Column:
    return normalize_for_match(a) == normalize_for_match(b)
