"""Hand-made cases for the operators whose rules SQL does not show."""

import difflib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import markdown as MD
from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.functions import vectors as V
from tessera.operators import chunking as C
from tessera.operators import context as X
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import hits as H
from tessera.operators import messages as M
from tessera.operators import sessions as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


def pack_sentences(par, size, overlap):
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[。！？.!?])\s+", par)):
        if not s:
            continue
        if len(cur) + len(s) > size:
            out += [cur] if cur else []
            cur = ""
            if len(s) > size:
                out += [s[i : i + size] for i in range(0, len(s), size - overlap)]
            else:
                cur = s
        else:
            cur += s
    return out + ([cur] if cur else [])


def pack(text, size, overlap):
    if not text:
        return []
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", re.sub(r"[ \t]+", " ", text))).strip()
    if len(text) <= size:
        return [text]
    out, cur, used = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > size:
            out += ["\n\n".join(cur)] if cur else []
            cur, used = [], 0
            out += pack_sentences(p, size, overlap)
        elif used + len(p) + 2 > size:
            out += ["\n\n".join(cur)] if cur else []
            tail, n = [], 0
            for c in reversed(cur):
                if n + len(c) > overlap:
                    break
                tail.insert(0, c)
                n += len(c)
            kept = "\n\n".join(tail) if overlap > 0 else ""
            cur = [kept, p] if kept else [p]
            used = len("\n\n".join(cur))
        else:
            cur.append(p)
            used += len(p) + 2
    return out + (["\n\n".join(cur)] if cur else [])


def test_paragraph_chunks_equal_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    words = ["ab.", "cde", "f!", "ghij", "\n\n", "\n\n\n\n", " \t", "中文。", "\r\n", "klmno?"]
    texts = ["", "short", "x" * 50, "x" * 51, "a b. " * 60] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((50, 10), (30, 0), (80, 40)):
        got = {r.i: r.c for r in df.select("i", C.paragraphs(F.col("text"), size, overlap).alias("c")).collect()}
        assert got == {i: pack(t, size, overlap) for i, t in enumerate(texts)}


def test_chunk_offsets(spark):
    text = "aaa bbb. ccc ddd. aaa bbb. eee"
    chunks = ["aaa bbb.", "ccc ddd.", "aaa bbb.", "zzz"]
    df = spark.createDataFrame([(text, chunks)], "t string, c array<string>")
    assert df.select(C.offsets(F.col("t"), F.col("c")).alias("o")).first().o == [0, 9, 18, 26]


def test_resolution_prefers_longer_terms(spark):
    terms = spark.createDataFrame([("麻黄", "药"), ("麻黄汤", "方"), ("柴胡汤", "方"), ("小柴胡汤", "方"), ("R", "语言")], "term string, type string")
    texts = spark.createDataFrame([(1, "小柴胡汤与麻黄汤，麻黄 R RR"), (2, "nothing"), (3, None)], "doc_id int, text string")
    for small in (5000, 1):
        assert {(r.doc_id, r.term) for r in E.contained_terms(texts, terms, "doc_id", "text", small).collect()} == {(1, t) for t in ("麻黄", "麻黄汤", "柴胡汤", "小柴胡汤", "R")}
    ways = [sorted(tuple(r) for r in E.candidates(texts, terms, "doc_id", "text", small).collect()) for small in (5000, 1)]
    assert ways[0] == ways[1]
    got = sorted((r.start, r.term) for r in E.resolve(E.candidates(texts, terms, "doc_id", "text"), "doc_id").collect())
    assert got == [(0, "小柴胡汤"), (5, "麻黄汤"), (9, "麻黄"), (12, "R"), (14, "R"), (15, "R")]


def test_patterns(spark):
    texts = spark.createDataFrame([(1, "张三先生, 北京大学, 河北省, 头痛医院, 的确公司"), (2, "latin only")], "doc_id int, text string")
    got = {(r.term, r.type) for r in E.pattern_mentions(texts, "doc_id", "text").collect()}
    assert got == {("张三先生", "人名"), ("北京大学", "组织"), ("河北省", "地点")}
    claimed = spark.createDataFrame([(1, 0, 4)], "doc_id int, start int, end int")
    assert ("张三先生", "人名") not in {(r.term, r.type) for r in E.pattern_mentions(texts, "doc_id", "text", claimed).collect()}


def test_alignment(spark):
    text = "Alpha beta, gamma delta. alpha BETA gamma"
    rows = [(1, "gamma", text, 0), (2, "gamma", text, 20), (3, "ALPHA beta", text, 0), (4, "gamma delta alpha omega", text, 0), (5, "unrelated words", text, 0), (6, "", text, 3)]
    df = spark.createDataFrame(rows, "i int, mention string, text string, at int")
    got = {r.i: (r.start, r.end, r.status) for r in E.align(df).collect()}
    assert got[1] == (12, 17, "match_exact") and got[2] == (36, 41, "match_exact")
    assert got[3] == (0, 10, "match_lesser") and got[4][2] == "match_fuzzy" and got[5] == (None, None, None)
    assert difflib.SequenceMatcher(None, "gamma delta alpha omega".split(), "gamma delta alpha BETA".split()).ratio() == 0.75


def test_greedy_duplicates_keep_later_hits_of_rejected_ones(spark):
    hits = [
        (0, 1, "http://a.org/x/", "One", None), (0, 2, "https://www.a.org/x", "Two", 0.9), (0, 3, "http://b.org", "One - Wikipedia", 0.5), (0, 4, "http://b.org/", "Three", 0.4),
        (0, 5, "", "Four", 0.0), (0, 6, "", "Five", 0.7), (1, 1, "http://a.org/x", "One", 0.2),
    ]
    df = spark.createDataFrame(hits, "query_id int, seq int, url string, title string, score double")
    assert sorted((r.query_id, r.seq) for r in H.greedy(df).collect()) == [(0, 1), (0, 4), (0, 5), (1, 1)]
    assert sorted(r.seq for r in H.greedy(df, min_score=0.5).where("query_id = 0").collect()) == [1, 5]


def test_relevance_adds_up_to_one(spark):
    df = spark.createDataFrame([("arxiv", "Deep Nets", "on deep nets", None, "A", "2020", "code"), ("x", "other", "other", 0.0, "", None, "general")], "engine string, title string, snippet string, score double, author string, published_date string, category string")
    got = [r.r for r in df.select(F.round(H.relevance(F.lit("deep nets"), ("code",)), 6).alias("r")).collect()]
    assert got == [1.0, 0.5]


def test_merges(spark):
    fold = lambda xs: one(spark, G.merge_descriptions(F.array(*(F.lit(x) for x in xs))), z=1)
    assert fold(["a", "a", "", "ab", "c"]) == "ab；c" and fold(["long text", "text"]) == "long text"
    rel = spark.createDataFrame([("a", "b", 0.5, "d1", "x"), ("a", "b", 0.9, "d2", "xyz"), ("b", "a", 0.1, "d1", "q")], "src string, dst string, confidence double, source_id string, description string")
    got = {(r.src, r.dst): (r.confidence, r.sources, r.description) for r in G.merge_relations(rel, ["src", "dst"]).collect()}
    assert got == {("a", "b"): (0.9, ["d1", "d2"], "xyz"), ("b", "a"): (0.1, ["d1"], "q")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "name string")
    assert {(r.name, r.hop) for r in G.expand(edges, start, 2).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert G.neighbours(edges, spark.createDataFrame([("c",)], "name string")).count() == 2  # the self-loop counts once


def test_hash_embedding_grams(spark):
    import hashlib

    for g in ("a", "th", "é", "漢字"):
        h = int(hashlib.md5(g.encode()).hexdigest(), 16)
        assert one(spark, V.gram_bin(F.col("g")), g=g) == h % 384
        assert one(spark, V.gram_weight(F.col("g")), g=g) == pytest.approx(((h >> 16) % 1000) / 1000)
    assert one(spark, V.char_grams(F.col("t")), t="AbC") == ["a", "b", "c", "ab", "bc"]
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), z=1) == 0.0
    v = one(spark, V.random_projection(8)(F.col("t")), t="x")
    assert sum(x * x for x in v) == pytest.approx(1)


def test_text_functions(spark):
    assert one(spark, T.normalize_url(F.col("u")), u="https://WWW.a.B/p//") == "www.a.b/p"
    assert one(spark, T.normalize_url(F.col("u")), u="http://www.A.b/?q=1") == "a.b/?q=1"
    assert one(spark, T.normalize_title(F.col("t")), t="  A  b | GitHub x") == "a b"
    assert one(spark, T.clean_html(F.col("h")), h="<b>x</b>&amp;lt;&quot;") == 'x<"'
    assert one(spark, T.html_to_text(F.col("h")), h="<HTML><SCRIPT>a</SCRIPT><p>b &amp; <i>c</i></p>") == "b &amp; c"
    assert one(spark, T.llm_json(F.col("s")).isNull(), s="no json")
    assert one(spark, T.jsonp(F.col("s")), s='cb({"s":["a"]});') == '{"s":["a"]}'
    assert tuple(one(spark, T.command(F.col("s")), s="/Help  me now")) == ("/help", "me now")
    assert one(spark, T.tool_reference(F.col("s")), s="mcp://x") is None
    assert [tuple(x) for x in one(spark, MD.code_blocks(F.col("s")), s="a\n```py\nx=1\n```\n")] == [("py", "x=1")]
    assert one(spark, MD.markdown_decorated(F.col("s")), s="## T\n\n\n\n- **b**\n> q\n---") == "【T】\n• 【b】\n> q\n\n━━━━━━━━━━━━"
    assert one(spark, T.byte_size(F.col("n")), n=1280) == "1.2KB"
    assert one(spark, K.by_script(F.col("t")), t="漢字abc") == 4
    assert tuple(one(spark, K.chunk_config(F.col("c")), c=40_000)) == (6000, 600)
    assert one(spark, K.align_context(F.col("c")), c=140_000) == 131_072
    fm = one(spark, T.front_matter(F.col("s")), s="---\nid: 5\ntype: a: b\n---\n\nbody\n")
    assert fm.fields == {"id": "5", "type": "a: b"} and fm.body == "body"


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab。. \n", max_size=60), st.integers(3, 12))
def test_message_splits(spark, text, size):
    def lines(s):
        if len(s) <= size:
            return [s]
        out, cur = [], ""
        for p in s.split("\n"):
            if len(p) > size:
                out += [cur] if cur else []
                cur = ""
                out += [p[i : i + size] for i in range(0, len(p), size)]
            elif len(cur) + len(p) + 1 > size:
                out.append(cur)
                cur = p
            else:
                cur = f"{cur}\n{p}" if cur else p
        return out + ([cur] if cur else [])

    assert one(spark, M.split_lines(F.col("t"), size), t=text) == lines(text)
    parts = one(spark, M.split_natural(F.col("t"), size), t=text)
    assert all(len(p) <= size for p in parts) and re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)


def test_budgets(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([30.0, 50.0, 10.0, 20.0])], "q int, ord int, cost double")
    keep = lambda df: sorted(r.ord for r in df.collect())
    assert keep(X.suffix_fit(rows, ["q"], "ord", F.col("cost"), F.lit(35.0))) == [2, 3]
    assert keep(X.prefix_fit(rows, ["q"], ["ord"], F.col("cost"), F.lit(79.0))) == [0]
    kinds = rows.withColumn("kind", F.when(F.col("ord") < 2, "memory").otherwise("kb"))
    assert keep(X.knowledge_fit(kinds, ["q"], "ord", F.col("cost"), F.lit(45.0))) == [0, 2]


def test_anchored_quota(spark):
    calls = [(1, "a", 0), (2, "a", 5), (3, "a", 6), (4, "a", 10), (5, "a", 11), (6, "b", 3)]
    df = spark.createDataFrame(calls, "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.accepted for r in S.anchored_quota(df, "key", "ts", 2, 10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}  # 10 still belongs to the first window


def test_row_numbers_and_rolling_mean(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("o"), (F.col("id") % 13).cast("double").alias("v"))
    numbered = S.number_rows(df, ["o"], "n").collect()
    assert all(r.n == r.o for r in numbered)
    means = {r.o: r["mean"] for r in S.rolling_mean(df, ["o"], "v", 10).collect()}
    value = {r.o: r.v for r in df.collect()}
    for o in (0, 3, 9, 10, 499, 500, 501, 4999):
        own = [value[x] for x in range(max(0, o - 9), o + 1)]
        assert means[o] == pytest.approx(sum(own) / len(own))
    assert len(means) == 5000
