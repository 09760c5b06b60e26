from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, hits, memory, messages, sessions

MESSAGES = "thread int, seq int, role string, text string, calls array<string>"


def test_new_facts(spark):
    found = spark.createDataFrame([(1, "用户: Likes Tea"), (2, "likes tea!"), (3, "Has a cat"), (4, None)], "n int, fact string")
    held = spark.createDataFrame([("HAS A CAT.",), (None,)], "fact string")
    assert [tuple(r) for r in memory.new_facts(found, held, "fact", ["n"]).collect()] == [(1, "用户: Likes Tea")]
    assert memory.new_facts(found.limit(0), held, "fact", ["n"]).count() == 0 and memory.new_facts(found, held.limit(0), "fact", ["n"]).count() == 2


def test_json_text(spark):
    cases = {'{"title": "a", "content": [["b", {"text": "c", "href": "x"}], 7, null]}': "abc", "plain": "plain", "[]": "", '{"text": 3}': "", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.out for r in rows.select("t", T.json_text(F.col("t")).alias("out")).collect()} == cases


def test_answer_thread(spark):
    rows = [(1, 0, "user", "old", []), (1, 1, "user", "q", []), (1, 2, "assistant", "", ["a", "b"]), (1, 3, "tool", "x" * 5, []), (2, 0, "user", "no tools", []), (3, 0, "assistant", None, ["a"]), (3, 1, "tool", None, None)]
    out = messages.answer_thread(spark.createDataFrame(rows, MESSAGES), "thread", "seq", "role", "text", "calls", most=3).orderBy("thread", "part", "seq").collect()
    assert [(r.thread, r.part, r.role) for r in out] == [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "tool"), (1, 3, "user")]
    assert out[0].text == "q" and out[1].text.endswith("a, b") and out[2].text == "xxx" + messages.CUT


def test_context_is_before_the_first_question(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "user", "q2"), (2, 0, "assistant", "a")], "thread int, seq int, role string, text string")
    contexts = spark.createDataFrame([(1, "ctx"), (2, "unused"), (3, None)], "thread int, context string")
    out = messages.insert_context(rows, contexts, "thread", "seq", "role", "text").orderBy("thread", "seq").collect()
    assert [r.text for r in out] == ["s", "ctx", "q", "q2", "a"]


def test_attachments_and_calls(spark):
    rows = spark.createDataFrame([([("image/png", "a"), (None, "b"), ("text/plain", "c")], [("rm",)], None)], "att array<struct<content_type string, url string>>, calls array<struct<name string>>, text string")
    r = rows.select(messages.by_mime(F.col("att")).alias("m"), messages.allowed_calls(F.col("text"), F.col("calls"), ["ls"]).alias("c")).first()
    assert [a.url for a in r.m.images] == ["a"] and [a.url for a in r.m.files] == ["b", "c"]
    assert r.c.text == messages.NO_TOOL and r.c.calls == []


def test_listings_and_reports(spark):
    rows = spark.range(12).select(F.lit("u").alias("by"), F.format_string("session%02d", "id").alias("k"), F.lit(2).alias("n"), F.timestamp_seconds(F.col("id") * 60).alias("seen"))
    lines = sessions.session_list(rows, "by", "k", "n", "seen").first().listing.split("\n")
    assert len(lines) == 11 and lines[0] == "session1: 2条消息 | 01-01 00:11" and lines[-1].startswith("... 还有 2")
    found = spark.createDataFrame([(1, 2, "B", "u2", "s"), (1, 1, "A", "u1", "s" * 150)], "query_id int, rank int, title string, url string, snippet string")
    topics = spark.createDataFrame([(1, "t"), (2, "none")], "query_id int, topic string")
    reports = {r.query_id: r.report for r in hits.research_report(found, topics).collect()}
    assert reports == {1: f"# t 研究报告\n\n- [A](u1) - {'s' * 100}...\n- [B](u2) - s...", 2: "# none 研究报告"}


def test_entity_report(spark):
    rows = spark.createDataFrame([("a", "T", 1, 1, None, None), ("a", "S", 2, 0, "exact", 0.9), ("b", "T", 1, 0, None, None)], "name string, kind string, doc int, ord int, status string, similarity double")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "name string")
    got = sorted(tuple(r) for r in graph.entity_report(rows, asked, "name", "kind", "doc", ["ord"]).collect())
    assert got == [("a", "S", 2, "exact", 0.9), ("b", "T", 1, "unknown", 1.0)]
