"""Search hits: duplicates, relevance, merging of engines, fallbacks, counts.

A hit has query_id, engine, seq (order of arrival), url, title, snippet, score and optional author,
published_date and category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_title, normalize_url
from .graph import connected
from .sessions import _written, rank_rows

#: What trusted sources add to the score.
TRUST = {"arxiv": 0.1, "pubmed": 0.1, "wikipedia": 0.05, "baidu_baike": 0.05, "github": 0.05}
#: Engines by category, in order of preference.
ENGINES = {
    "academic": ("pubmed", "arxiv"),
    "code": ("github", "gitee"),
    "encyclopedia": ("baidu_baike", "wikipedia"),
    "general": ("tavily", "searxng", "serper", "bing", "brave", "duckduckgo"),
    "research": ("tavily", "searxng", "serper", "duckduckgo"),
}


def effective_score(score: Column) -> Column:
    """A missing score, and a score of 0, count as 0.5."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(0.5))


def first_by(hits: DataFrame, key: Column, by: list[str], order: str = "seq") -> DataFrame:
    """Of hits with equal ``key`` the first."""
    rank = F.row_number().over(W.partitionBy(*by, key).orderBy(order))
    return hits.withColumn("rn", rank).where("rn = 1").drop("rn")


#: Hits of one component that a task decides in a round.
TOGETHER = 20_000


def greedy(hits: DataFrame, by: str = "query_id", order: str = "seq", min_score: float | None = None, together: int = TOGETHER) -> DataFrame:
    """Hits in order, without those whose URL or title an accepted hit has. Rejected hits reject nobody. With ``min_score`` only
    hits of at least that score take part; without it all do, whatever their score.

    Acceptance depends on what was accepted before, but only on hits that are joined by URLs and titles,
    one to the next. So hits fall into components (found in logarithmic rounds), and a task decides the first
    ``together`` of each component in their order; that settles all components up to this size. Of larger ones,
    hits that are accepted reject others, and the rest falls into components anew.
    """
    rows = hits.where(F.col(by).isNotNull())
    if min_score is not None:
        rows = rows.where(effective_score(F.col("score")) >= min_score)
    rows = rows.withColumns({"u": normalize_url(F.coalesce("url", F.lit(""))), "t": normalize_title(F.coalesce("title", F.lit("")))})
    left = _written(rows.groupBy(by, "u", "t").agg(F.min(order).alias(order)))
    kinds, accepted = {c: left.schema[c].dataType.simpleString() for c in left.columns}, []
    while not left.isEmpty():
        rooted = left.withColumn("root", F.lit(0))
        if left.limit(together + 1).count() > together:  # else all of it is one task's share
            ends = left.withColumns({"a": F.xxhash64(by, F.lit(1), "u"), "b": F.xxhash64(by, F.lit(2), "t")})
            rooted = ends.join(connected(ends.select("a", "b")).withColumnRenamed("node", "a"), "a").select("root", *left.columns)
        place = F.row_number().over(W.partitionBy("root").orderBy(order, "u", "t"))
        first = _written(rooted.withColumn("place", place).where(F.col("place") <= together))
        dealt = first.repartition("root").sortWithinPartitions("root", "place")
        now = _written(dealt.select("root", *left.columns).mapInPandas(_first_come(by), "".join(f"{c} {k}, " for c, k in kinds.items())[:-2]))
        accepted.append(now.select(by, order))
        if first.groupBy("root").count().where(F.col("count") >= together).isEmpty():
            break  # whole components
        settled = first.select(by, "u", "t").unionByName(now.select(by, "u", "t")).distinct()
        left = left.join(settled, [by, "u", "t"], "left_anti").join(now.select(by, "u"), [by, "u"], "left_anti").join(now.select(by, "t"), [by, "t"], "left_anti")
        left = _written(left.select(*kinds))
    if not accepted:
        return hits.where("false")
    kept = accepted[0]
    for more in accepted[1:]:
        kept = kept.unionByName(more)
    return hits.join(kept, [by, order], "left_semi")


def _first_come(by: str):
    """Rows that come sorted by root and place, without those whose URL or title a row of that root before them took."""

    def run(frames):
        root, urls, titles = None, set(), set()
        for frame in frames:
            keep = []
            for r, key, u, t in zip(frame["root"], frame[by], frame["u"], frame["t"], strict=True):
                if r != root:
                    root, urls, titles = r, set(), set()
                fresh = (key, u) not in urls and (key, t) not in titles
                keep.append(fresh)
                if fresh:
                    urls.add((key, u))
                    titles.add((key, t))
            yield frame[keep].drop(columns="root")

    return run


def relevance(query: Column, boosted: tuple[str, ...] = ()) -> Column:
    """The score of a hit for a query: matches in title and snippet, category, source, author and date add up, to 1 at most."""
    q, title, snippet = F.lower(query), F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("snippet", F.lit("")))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    trust = F.coalesce(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))[F.col("engine")], F.lit(0.0))
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = effective_score(F.col("score")) + plus(F.contains(title, q), 0.3) + plus(title == q, 0.2) + plus(F.contains(snippet, q), 0.1)
    if boosted:
        score += plus(F.col("category").isin(*boosted), 0.15)
    return F.least(F.lit(1.0), score + trust + plus(has("author"), 0.05) + plus(has("published_date"), 0.03))


def rank(hits: DataFrame, query: Column, boosted: tuple[str, ...] = (), by: list[str] = ("query_id",)) -> DataFrame:
    """Hits with relevance (6 decimals) and rank; equal ones in order of arrival."""
    scored = hits.withColumn("relevance", F.round(relevance(query, boosted), 6)).withColumn("_down", -F.col("relevance"))
    return rank_rows(scored, list(by), ["_down", "seq"], "rank").drop("_down")


def stats(hits: DataFrame) -> DataFrame:
    """(kind, value, n): counts by source, by category, and in all, in one pass."""
    sets = hits.groupingSets([["engine"], ["category"], []], "engine", "category").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "category").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce(F.when(F.col("g") == 1, F.col("engine")).when(F.col("g") == 2, F.col("category")), F.lit("")).alias("value"), "n")


def round_robin(hits: DataFrame, per_engine: int = 5, by: list[str] = ("query_id",)) -> DataFrame:
    """The engines' hits in turn, by place and then by engine, the first of equal URLs; ``place`` numbers them."""
    rows = hits.where(F.col("engine_rank") <= per_engine)
    order = ["engine_rank", "engine_ord"]
    first = F.row_number().over(W.partitionBy(*by, normalize_url(F.col("url"))).orderBy(*order))
    rows = rows.withColumn("rn", first).where("rn = 1").drop("rn")
    return rank_rows(rows, list(by), order, "place")


def early_stop(hits: DataFrame, n: int, by: list[str] = ("query_id",)) -> DataFrame:
    """Whole engines in order of preference until ``n`` hits are there, then the first ``n``."""
    counts = hits.groupBy(*by, "engine_ord").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy(*by).orderBy("engine_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("before", before).where(F.col("before") < n).select(*by, "engine_ord", "before")
    rows = hits.join(used, [*by, "engine_ord"]).withColumn("place", F.col("before") + F.row_number().over(W.partitionBy(*by, "engine_ord").orderBy("engine_rank")))
    return rows.where(F.col("place") <= n).drop("before")


def with_fallback(queries: DataFrame, hits: DataFrame, fallback: DataFrame, key: str = "query_id") -> DataFrame:
    """Hits, and fallback hits for the queries that have none."""
    empty = queries.select(key).distinct().join(hits.select(key).distinct(), key, "left_anti")
    return hits.unionByName(fallback.join(empty, key, "left_semi"), allowMissingColumns=True)


def engines(spark) -> DataFrame:
    """(category, ord, engine), the table of preferences."""
    return spark.createDataFrame([(c, i, e) for c, names in ENGINES.items() for i, e in enumerate(names)], "category string, ord int, engine string")


def engine_counts(hits: DataFrame, most: int | None = None) -> DataFrame:
    """(category, ord, engine, n, first) for every engine of the table of preferences: its hits in that category, and whether it is the first that has any; engines beyond the first ``most`` of a category are left out."""
    known = engines(hits.sparkSession)
    known = known if most is None else known.where(F.col("ord") < most)
    counts = known.join(hits.groupBy("category", "engine").agg(F.count("*").alias("n")), ["category", "engine"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.min(F.when(F.col("n") > 0, F.col("ord"))).over(W.partitionBy("category"))
    return counts.select("category", "ord", "engine", "n", F.coalesce(F.col("ord") == first, F.lit(False)).alias("first"))


def report_line(place: Column) -> Column:
    """A hit as text."""
    return F.concat_ws("\n", F.format_string("%d. **%s** [%s]", place, F.col("title"), F.col("engine")), F.concat(F.lit("   "), F.col("url")), F.concat(F.lit("   "), F.replace("snippet", F.lit("\n"), F.lit(" "))))


def research_report(ranked: DataFrame, topics: DataFrame, key: str = "query_id", most: int = 5) -> DataFrame:
    """(key, report): a Markdown report for each of ``topics`` (key, topic) on its best ``most`` hits (rank, title, url, snippet); a topic without hits has its title alone."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") - "), F.left("snippet", F.lit(100)), F.lit("..."))
    lines = ranked.where(F.col("rank") <= most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return topics.join(lines, key, "left").select(key, F.concat_ws("\n\n", F.concat(F.lit("# "), "topic", F.lit(" 研究报告")), body).alias("report"))


def by_category(hits: DataFrame, n: int, by: list[str] = ("query_id", "category")) -> DataFrame:
    """Several categories searched at once: each keeps its own results, until it has ``n``; the union, keyed by category."""
    return early_stop(hits, n, by)
