"""Queries that cover their whole input, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import hits as H
from tessera.operators import sessions as S
from tessera.operators import vectors as O


def run(spark, name, sf):
    return registry.queries()[name](spark, str(sf)).collect()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 words in three documents each and one in all 60, beside a word inside a longer one."""
    name = lambda i: "word" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = {d: "everywhere overeverywhere " + " ".join(name(i) for i in range(300) if i % 20 == d % 20) for d in range(60)}
    sf = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, "en") for d, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "everywhere " + name(7)), (2, "overeverywheres")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    words = {d: re.findall("[a-z]{8,}", t) for d, t in texts.items()}
    df = Counter(w for own in words.values() for w in set(own))
    return sf, texts, words, {w for w, n in df.items() if n >= 3}


def test_dictionary_keeps_every_term(spark, corpus):
    sf, texts, words, terms = corpus
    assert len(terms) == 302
    assert sum(r.n for r in run(spark, "dictionary_stats", sf)) == 302
    assert {(r.doc_id, r.term): r.n for r in run(spark, "dictionary_candidates", sf)} == {(d, w): n for d, own in words.items() for w, n in Counter(own).items()}
    assert {r.term: r.n_docs for r in run(spark, "mention_counts", sf)}["everywhere"] == 60
    assert {r.doc_id: r.n for r in run(spark, "terms_per_document", sf)} == {d: sum(w in t for w in terms) for d, t in texts.items()}
    assert {(r.item_id, r.term) for r in run(spark, "query_entities", sf)} == {(i, w) for i, t in ((1, "everywhere wordhaaa"), (2, "overeverywheres")) for w in terms if w in t}
    assert {r.term: r.type for r in run(spark, "dictionary_merge", sf)} == {w: "en" for w in terms} | dict.fromkeys(("everywhere", "wordhaaa", "overeverywheres"), "private")


def test_mentions_and_overlap_use_every_term(spark, corpus):
    sf, texts, words, terms = corpus
    assert Counter(r.term for r in run(spark, "mentions_resolved", sf)) == Counter(w for own in words.values() for w in own)
    best = run(spark, "overlap_search", sf)
    assert len(best) == 10 and {round(r.score, 6) for r in best} == {round(17 / 302, 6)}


@pytest.mark.parametrize("small", [1, 5000])
def test_resolution_by_runs(spark, small):
    texts = spark.createDataFrame([(1, "abcdefghij abcdefgh"), (2, "cdefghijabcdefgh")], "doc_id long, text string")
    terms = spark.createDataFrame([(t, "x") for t in ("abcdefgh", "cdefghij", "abcdefghij")], "term string, type string")
    found = defaultdict(list)
    for r in E.resolve(E.candidates(texts, terms, "doc_id", "text", small), "doc_id").collect():
        found[r.doc_id].append((r.start, r.term))
    assert {d: sorted(v) for d, v in found.items()} == {1: [(0, "abcdefghij"), (11, "abcdefgh")], 2: [(0, "cdefghij"), (8, "abcdefgh")]}


def test_reports_facts_and_rewrites_are_whole(spark, tmp_path):
    long = "find every paper on the containment of terms"
    talk = [(1, 0, "user", "the first fact"), (1, 1, "assistant", "the third fact"), (1, 2, "user", "the second fact"), (2, 0, "user", "The  third fact"), (2, 1, "user", "the first fact")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k,) for k in range(1, 21)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, k * 100, 1, 1, 1.0, "R", "O", 0.1) for k in range(1, 21)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_returnflag string, l_linestatus string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.conv_id, r.turn) for r in run(spark, "new_facts", tmp_path)) == [(1, 0), (1, 2)]
    assert [(r.papers, r.code) for r in run(spark, "query_rewrites", tmp_path)] == [(f"cat:cs.CL AND all:{long}", f"{long} language:python")]
    assert sorted(r.l_partkey for r in run(spark, "verification_report", tmp_path)) == list(range(1, 21))


@pytest.mark.parametrize("by", [[], ["label"]])
def test_many_queries_against_brute_force(spark, monkeypatch, by):
    monkeypatch.setattr(O, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(O, "BLOCK_ROWS", 7)
    rows = [(i, i % 2, [float(x) for x in ((1, 2, 3) if i < 15 else (i % 5, i % 3, i % 7))]) for i in range(45)]
    items = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    asked = items.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    got = {(r.query_id, r.vec_id) for r in O.top_k_many(items, asked, 4, "vec_id", by=by).collect()}
    want = set()
    for q, _, v in rows:
        for own in [[0], [1]] if by else [[0, 1]]:
            if q % 20 == 0:
                want |= {(q, i) for _, i in sorted((-cosine(v, e), i) for i, label, e in rows if label in own)[:4]}
    assert {q for q, _ in got} == {0, 20, 40}
    assert got == want


def shuffled(spark, since=-1):
    """The last stage so far, and the rows that the stages after ``since`` gave to a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    held = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in held), default=-1), sum(s.shuffleWriteRecords() for s in held if s.stageId() > since)


def test_many_queries_shuffle_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 50)
    rng = random.Random(5)
    moved = []
    for n in (1000, 4000):
        rows = [(i, i % 10, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
        items = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        asked = items.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
        since, _ = shuffled(spark)
        assert len(O.top_k_many(items, asked, 5, "vec_id", by=["label"]).collect()) == n // 20 * 10 * 5
        moved.append(shuffled(spark, since)[1])
    assert moved[1] < 5 * moved[0]  # not with what each pair of blocks keeps, which grows as rows times queries


@pytest.mark.parametrize("product", [False, True])
def test_many_queries_of_odd_vectors(spark, monkeypatch, product):
    """Equal vectors, opposite and zero ones, lengths far apart, missing collections and names as text."""
    monkeypatch.setattr(O, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(O, "BLOCK_ROWS", 20)
    rng = random.Random(6)
    rows = []
    for i in range(120):
        v = [rng.choice((1e-6, 1.0, 1e6)) * rng.choice((-1, 1)) * x for x in (rng.random(), rng.random(), rng.random())]
        v = [0.0] * 3 if i % 17 == 0 else [1.0, -2.0, 0.5] if i % 5 == 0 else None if i % 19 == 0 else [1.0, None, 2.0] if i % 23 == 0 else v
        rows.append((f"v{i:03}", None if i % 7 == 0 else ("a", "b")[i % 2], v))
    items = spark.createDataFrame(rows, "name string, kind string, embedding array<double>")
    monkeypatch.setattr(type(items), "repartitionById", lambda rows, n, at: rows.repartition(3, at))  # several blocks in a task
    asked = items.where("substr(name, 3) % 4 = 0").selectExpr("name AS query_id", "embedding AS query")
    whole = [(n, kind, v) for n, kind, v in rows if v and None not in v]

    def worth(a, b):
        dot = total(x * y for x, y in zip(a, b, strict=True))
        both = math.sqrt(total(x * x for x in a)) * math.sqrt(total(x * x for x in b))
        return dot if product else dot / both if both else 0.0

    def total(numbers):
        s = 0.0
        for x in numbers:  # one after the other, as Spark adds them
            s += x
        return s

    want = set()
    for q, _, v in whole:
        for kind in (None, "a", "b"):
            best = sorted((-worth(e, v), n) for n, own, e in whole if own == kind)[:4]
            want |= {(q, n, kind, -s, rank) for rank, (s, n) in enumerate(best, 1)} if int(q[2:]) % 4 == 0 else set()
    got = [tuple(r) for r in O.top_k_many(items, asked, 4, "name", by=["kind"], product=product).collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_greedy_in_rounds(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, f"http://a.b/{rng.randrange(60)}", f"title {rng.randrange(60)}", 1.0) for i in range(400)]
    rows += [(2, i, f"http://c.d/{(i + 1) // 2}", f"title {i // 2}", 1.0) for i in range(9)]  # every hit but the first hangs on the one before
    df = spark.createDataFrame(rows, "query_id long, seq long, url string, title string, score double")
    want, seen = [], set()
    for q, i, u, t, _ in rows:
        if not {(q, u), (q, t)} & seen:
            seen |= {(q, u), (q, t)}
            want.append((q, i))
    for together in (20_000, 60):  # larger components take several rounds
        out = H.greedy(df, together=together)
        assert sorted((r.query_id, r.seq) for r in out.collect()) == sorted(want)
    assert H.greedy(df.where("false")).count() == 0


def test_an_index_stays_in_its_file(spark, tmp_path):
    import tracemalloc

    from tessera.operators import terms

    n = 200_000
    words = spark.range(n).selectExpr("concat('term', hex(id * 7919)) AS term", "'t' AS type")
    files = terms.write_index(words, str(tmp_path / "index"))
    tracemalloc.start()
    held = terms.Terms(files[0])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(files) == 1 and len(held.term) == n
    assert most < 40 * n  # bytes; the codes, hashes and bitmap of every row took over 300 each


def test_greedy_keeps_hits_of_negative_score(spark):
    rows = [(0, i, f"http://a.b/{i % 3}", f"title {i}", 1 - 0.4 * i) for i in range(6)]  # below 0 from the fourth on
    df = spark.createDataFrame([*rows, (0, 6, "http://a.b/6", "title 6", -2.0)], "query_id long, seq long, url string, title string, score double")
    assert {r.seq for r in H.greedy(df).collect()} == {0, 1, 2, 6}
    assert {r.seq for r in H.greedy(df, min_score=0.0).collect()} == {0, 1, 2}


def test_a_long_chain_of_hits(spark, monkeypatch):
    from tessera.operators import graph

    n, rounds, written = 10_000, [], graph._written
    monkeypatch.setattr(graph, "_written", lambda rows: rounds.append(1) or written(rows))
    df = spark.range(n).selectExpr("0 AS query_id", "id AS seq", "concat('http://c.d/', (id + 1) div 2) AS url", "concat('title ', id div 2) AS title", "1.0D AS score")
    assert {r.seq for r in H.greedy(df, together=n - 1).collect()} == set(range(0, n, 2))
    assert 5 < len(rounds) < 40  # components twice, each in logarithmic rounds


def test_connected_equals_a_walk(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1300)]
    got = {r.node: r.root for r in G.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in links)}


def walked(calls, limit, span):
    out, open_ = {}, {}
    for i, key, t in sorted(calls, key=lambda c: (str(c[1]), c[2], c[0])):
        until, used = open_.get(key, (None, 0))
        if until is None or t > until:
            until, used = t + span, 0
        out[i], open_[key] = used < limit, (until, used + 1)
    return out


def test_quotas_of_a_hot_key_over_many_blocks(spark):
    rng = random.Random(8)
    for seed, (n, wide) in enumerate([(4000, 40_000), (4000, 900), (3000, 10)]):
        calls = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(wide)) for i in range(n)]
        df = spark.createDataFrame([(*c, 1) for c in calls], "id int, key string, s long, us int").withColumn("ts", F.timestamp_seconds("s"))
        out = S.anchored_quota(df, "key", "ts", 3, 60, ["ts", "id"])
        assert out.columns == [*df.columns, "accepted"]
        assert {r.id: r.accepted for r in out.collect()} == walked(calls, 3, 60), seed
    assert S.anchored_quota(df.where("false"), "key", "ts", 3, 60).count() == 0


def test_ranks_and_means_within_keys(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, float(rng.randrange(50))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.i: (r["rank"], r["mean"]) for r in S.rank_rows(S.rolling_mean(df, ["i"], "v", 5, ["k"]), ["k"], ["v", "i"], "rank").collect()}
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key]
        for place, r in enumerate(sorted(own, key=lambda r: (r[2], r[1])), 1):
            before = [x[2] for x in own if x[1] <= r[1]][-5:]
            assert got[r[1]] == (place, pytest.approx(sum(before) / len(before)))


def test_equal_descriptions_travel_once(spark):
    rows = [(1, i, ["red", "green", "red", None][i % 4], i) for i in range(400)]
    df = spark.createDataFrame(rows, "name long, source_id long, description string, ord long")
    out = G.merge_entities(df, ["name"])
    r = out.first()
    assert r.description == "red；green" and r.sources == list(range(400))
    assert "min(ord" in out._jdf.queryExecution().optimizedPlan().toString()
