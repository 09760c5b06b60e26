import json
import zipfile

import pytest

from pyspark.sql import functions as F

from tessera.sources import files, payloads
from tessera.streaming import live


def test_documents_and_scans(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.TXT").write_bytes(b"ab\xffc")
    (tmp_path / "a" / "b" / "y.md").write_text("# 题\nz")
    (tmp_path / "skip.bin").write_bytes(b"0")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>x</w:t></w:p></w:d>')
    rows = {r.path.split("/")[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["x.TXT"].text == "abc" and rows["y.md"].text == "# 题\nz" and rows["good.docx"].text == "one two\nx"
    assert rows["bad.docx"].text is None and rows["bad.docx"].reason and len(rows) == 4
    assert files.scan(spark, str(tmp_path)).count() == 4
    assert [r.category for r in files.categories(files.scan(spark, str(tmp_path)), str(tmp_path)).collect()] == ["a"]
    assert [r.name for r in files.find_files(spark, str(tmp_path), "GOOD").collect()] == ["good.docx"]
    strict = spark.createDataFrame([(b"\xc4\xe3",), ("é".encode(),)], "b binary").select(files.text_strict(F.col("b")).alias("t")).collect()
    assert [r.t for r in strict] == ["你", "é"]


def test_dictionaries_memories_histories(spark, tmp_path):
    d = tmp_path / "dict"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"metadata": {"name": "n", "domain": "m"}, "entities": {"t": ["x", "y"], "u": ["z"]}}))
    (d / "bad.json").write_text("{not json")
    rows = files.read_dictionaries(spark, str(d))
    assert {(r.dict_name, r.type, r.term) for r in rows.collect()} == {("n", "t", "x"), ("n", "t", "y"), ("n", "u", "z")}
    files.write_dictionary(rows, str(tmp_path / "out"))
    assert files.read_dictionaries(spark, str(tmp_path / "out")).count() == 3
    assert files.add_terms(rows, rows).count() == 3
    m = tmp_path / "ws" / "memory"
    m.mkdir(parents=True)
    (tmp_path / "ws" / "MEMORY.md").write_text("main facts")
    (m / "p1.md").write_text("---\nid: e1\ntype: episodic\nimportance: 0.9\n---\n\nsaw it")
    (m / "projects.md").write_text("left out")
    got = {r.id: (r.type, r.content, r.importance) for r in files.read_memories(spark, str(tmp_path / "ws")).collect()}
    assert got == {"main": ("semantic", "main facts", 0.5), "e1": ("episodic", "saw it", 0.9)}
    h = tmp_path / "h" / "qq" / "u1"
    h.mkdir(parents=True)
    (h / "s1.json").write_text(json.dumps([{"role": "human", "content": "hi", "timestamp": 1.0}, {"role": "ai", "content": "yo", "timestamp": 2.0}]))
    (h / "s2.json").write_text("broken")
    assert [(r.channel, r.user, r.session, r.seq, r.role) for r in files.read_histories(spark, str(tmp_path / "h")).orderBy("seq").collect()] == [("qq", "u1", "s1", 0, "human"), ("qq", "u1", "s1", 1, "ai")]


def test_payloads(spark):
    replies = {
        "serper": {"organic": [{"title": "T", "link": "u", "snippet": "<b>s</b> &amp;"}]}, "brave": {"web": {"results": [{"title": "T", "url": "u", "description": "s &"}]}},
        "bing": {"webPages": {"value": [{"name": "T", "url": "u", "snippet": "s &"}]}}, "tavily": {"results": [{"title": "T", "url": "u", "content": "s &"}]},
        "searxng": {"results": [{"title": "T", "url": "u", "content": "s &"}]}, "github": {"items": [{"full_name": "T", "html_url": "u", "description": "s &"}]},
        "wikipedia": {"query": {"search": [{"title": "T", "pageid": "u", "snippet": "s &amp;"}]}},
    }
    for engine, reply in replies.items():
        df = spark.createDataFrame([(1, json.dumps(reply)), (2, "{}")], "query_id int, payload string")
        r = payloads.hits(df, engine).collect()
        assert [(x.query_id, x.title, x.url, x.snippet, x.score, x.engine_rank) for x in r] == [(1, "T", "u", "s &", 1.0, 1)], engine
    atom = "<feed><entry><id>i</id><title>A\n b</title><summary>s</summary><published>2020-01-02T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author></entry></feed>"
    r = payloads.hits(spark.createDataFrame([(1, atom)], "query_id int, payload string"), "arxiv").first()
    assert (r.title, r.url, r.author, r.published_date) == ("A b", "i", "X, Y", "2020-01-02")
    med = "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList><Journal><JournalIssue><PubDate><Year>2021</Year><Month>May</Month></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></S>"
    r = payloads.hits(spark.createDataFrame([(1, med)], "query_id int, payload string"), "pubmed").first()
    assert (r.title, r.author, r.published_date, r.url[-3:]) == ("T", "F L", "2021-May", "/7/")


def test_incremental_index(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    docs = spark.createDataFrame([(1, "a. " * 10), (2, "b")], "doc_id long, text string")
    docs.write.parquet(source)
    run = lambda: live.index_directory(spark, source, "doc_id long, text string", out, state, 20, 5).awaitTermination()
    run()
    first = spark.read.parquet(out).count()
    docs.where("doc_id = 2").write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == first + 1


def test_merge_quota_and_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, x string, v int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, x string, v int").parquet(source)
    live.merge_stream(stream, str(tmp_path / "t"), str(tmp_path / "s"), ["id"], "v", live.latest_generation).awaitTermination()
    assert {(r.id, r.x) for r in spark.read.parquet(str(tmp_path / "t" / "0")).collect()} == {(1, "b"), (2, "c")}

    calls = str(tmp_path / "calls")
    spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", 6), (4, "a", 11), (5, "b", 1)], "id long, key string, s long").select("id", "key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(calls)
    q = live.quota_stream(spark.readStream.schema("id long, key string, ts timestamp").parquet(calls), 2, 10).writeStream.format("memory").queryName("quota").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.accepted) for r in spark.table("quota").collect()} == {(1, True), (2, True), (3, False), (4, True), (5, True)}

    events = str(tmp_path / "events")
    spark.createDataFrame([(0, "v", 1.0), (60, "v", 2.0), (400, "v", 4.0)], "s long, kind string, value double").select(F.timestamp_seconds("s").alias("ts"), "kind", "value").coalesce(1).write.parquet(events)
    agg = live.counts_by_window(spark.readStream.schema("ts timestamp, kind string, value double").parquet(events), "ts", "kind")
    q = agg.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("windows").collect()) == [(1, 4.0), (2, 3.0)]


def test_status_replay(spark):
    rows = [("a", "pending", 1), ("a", "running", 2), ("a", "completed", 3), ("b", "pending", 1), ("b", "completed", 2), ("c", "pending", 1), ("c", "running", 2)]
    got = {r.doc_id: (r.status, r.broken) for r in live.replay_status(spark.createDataFrame(rows, "doc_id string, status string, ts int")).collect()}
    assert got == {"a": ("completed", 0), "b": ("completed", 1), "c": ("failed", 0)}


def test_a_lost_generation_is_an_error(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "t", "s"))
    kind = "id long, x string, v int"
    run = lambda: live.merge_stream(spark.readStream.schema(kind).parquet(source), out, state, ["id"], "v", live.latest_generation).awaitTermination()
    spark.createDataFrame([(1, "a", 1)], kind).write.parquet(source)
    run()
    (tmp_path / "t" / "0").rename(tmp_path / "gone")
    spark.createDataFrame([(2, "b", 1)], kind).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="is gone"):
        run()
