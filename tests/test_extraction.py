"""Extraction from chunks, dictionaries both ways, graph walks from their seeds, alignment by letters."""

import json
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tessera.functions import markdown as MD
from tessera.functions import rules as R
from tessera.operators import entities as E
from tessera.operators import extraction as EX
from tessera.operators import graph as G
from tessera.operators import library as L


@pytest.mark.parametrize("small", [1, 5000])
def test_dictionary_rows_mean_the_same_both_ways(spark, small):
    terms = spark.createDataFrame([("ab\\Ecd", "x"), ("ab\\Ecd", "x"), ("ab\\Ecd", "y"), ("zz", None), ("", "x")], "term string, type string")
    texts = spark.createDataFrame([(1, "ab\\Ecd ab\\Ecdzzz \\Q"), (2, None), (3, "")], "doc_id int, text string")
    assert Counter((r.term, r.type) for r in E.contained_terms(texts, terms, "doc_id", "text", small).collect()) == Counter([("ab\\Ecd", "x"), ("ab\\Ecd", "y"), ("zz", None)])
    found = sorted((r.start, r.term, r.type or "") for r in E.candidates(texts, terms, "doc_id", "text", small).collect())
    assert found == [(0, "ab\\Ecd", "x"), (0, "ab\\Ecd", "y"), (7, "ab\\Ecd", "x"), (7, "ab\\Ecd", "y"), (13, "zz", "")]


@pytest.mark.parametrize("file_terms", [7, 5000])
def test_terms_are_found_wherever_they_stand(spark, file_terms):
    rng = random.Random(2)
    letters = ["a", "b", "é", "漢", "😀", " "]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = {word(rng.randint(1, 12)) for _ in range(200)} | {"a" * k for k in range(1, 20)}
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(80, "a" * 200), (81, None), (82, "")]
    found = E.candidates(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, term int"), spark.createDataFrame([(t, "x") for t in terms], "term string, type string"), "doc_id", "text", file_terms)
    want = set()
    for i, text in texts:
        for term in terms:
            at = (text or "").find(term)
            while at >= 0:
                want.add((i, term, "x", at, at + len(term)))
                at = text.find(term, at + len(term))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    texts, terms = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t, k) for t in terms for k in "xy"[: 1 + len(t) % 2]], "term string, type string")
    one, two = E.resolved(texts, terms, "doc_id", "text", file_terms), E.resolve(E.candidates(texts, terms, "doc_id", "text"), "doc_id")
    assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    texts = [tuple(r) for r in texts.collect()]
    assert E.candidates(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "term string, type string"), "doc_id", "text").count() == 0


def test_a_dictionary_of_a_million_terms(spark):
    terms = spark.range(1_000_000).selectExpr("concat('term', hex(id * 7919), 'x') AS term", "'t' AS type")
    texts = spark.range(2000).selectExpr("id AS doc_id", "concat('some words term', hex(id * 7919), 'x and term', hex(id * 7919 + 1), 'x') AS text")
    rows = E.candidates(texts, terms, "doc_id", "text", 300_000)
    assert rows.count() == 2000 and rows.where("start <> 11").count() == 0


def test_walks_from_seeds_equal_walks_over_all_edges(spark):
    rng = random.Random(6)
    rows = [(c, rng.randrange(40), k) for c in range(120) for k in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "chunk int, name int, ord int")
    asked = spark.createDataFrame([(3,), (17,), (99,)], "name int")
    for cap in (20, 4):
        edges = G.edge_weights(G.cooccurrence(df, "chunk", "name", "ord", cap))
        want = {(r.src, r.dst, r.n) for r in edges.collect() if {r.src, r.dst} & {3, 17, 99}}
        assert {tuple(r) for r in G.edges_near(df, asked, "chunk", "name", "ord", cap).select("src", "dst", "n").collect()} == want
        for hops in (1, 2):
            assert {tuple(r) for r in G.reach(df, asked, "chunk", "name", "ord", hops, cap).collect()} == {tuple(r) for r in G.expand(edges, asked, hops).collect()}


def test_alignment_by_letters_keeps_places(spark):
    text = "... (Well), the Co-operative -- Society's End; of it all."
    start, end, status, similarity = E.align_one("cooperative societys", text, 0)
    assert (text[start:end], status, similarity) == ("Co-operative -- Society's", "match_lesser", 0.95)
    assert E.align_one("--", "no letters here", 0) is None
    words, tokens = "a b c d".split(), "x b a c d b c d a b c d".split()
    ratio, width, first = E._most_similar(words, tokens, 0.5)
    assert (ratio, width, first) == (1.0, 4, 8)


def test_fuzzy_alignment_equals_trying_every_run():
    import difflib

    rng = random.Random(8)
    for _ in range(150):
        words, tokens = ([rng.choice("abcde") for _ in range(rng.randint(1, n))] for n in (5, 25))
        best = None
        for width in range(len(words), min(len(words) + 3, len(tokens)) + 1):
            for i in range(len(tokens) - width + 1):
                ratio = difflib.SequenceMatcher(None, words, tokens[i : i + width]).ratio()
                if ratio >= 0.6 and (best is None or ratio > best[0]):
                    best = ratio, width, i
        assert E._most_similar(words, tokens, 0.6) == best


def test_spans_clear_of_others(spark):
    rng = random.Random(9)
    made = lambda n: [(rng.randrange(3), s, s + rng.randint(1, 6)) for s in (rng.randrange(60) for _ in range(n))]
    found, taken = made(80), made(15)
    schema = "k int, start int, end int"
    got = Counter(tuple(r) for r in E.clear_of(spark.createDataFrame(found, schema), spark.createDataFrame(taken, schema), "k").collect())
    assert got == Counter(f for f in found if not any(t[0] == f[0] and t[1] < f[2] and f[1] < t[2] for t in taken))


def plain_extract(text, terms, reply, k=20):
    """Dictionary (no overlaps in these texts), then the reply's names in order."""
    taken, found = [], []
    free = lambda a, b: not any(x < b and a < y for x, y in taken)
    places = lambda name: [i for i in range(len(text)) if text.startswith(name, i)]
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        for i in places(term):
            if free(i, i + len(term)):
                taken.append((i, i + len(term)))
                found.append((term, terms[term], i, 0.95, "dictionary"))
    for e in (reply or {}).get("entities", []):
        name = e.get("name")
        if name and name not in terms:
            at = next((i for i in places(name) if free(i, i + len(name))), None)
            if at is not None:
                taken.append((at, at + len(name)))
                found.append((name, e.get("type") or "未知", at, e.get("confidence") or 0.7, "llm"))
    best = {}
    for f in sorted(found, key=lambda f: (EX.SOURCES.index(f[4]), f[2])):
        if f[0] not in best or f[3] > best[f[0]][3]:
            best[f[0]] = f
    ranked = sorted(best.values(), key=lambda f: (-f[3], -len(f[0]), EX.SOURCES.index(f[4]), f[2], f[0]))
    said = [(r.get("source", ""), r.get("target", ""), r.get("relation") or "RELATED", r.get("confidence") or 0.6) for r in (reply or {}).get("relations", [])]
    if len(said) < 3:
        said += [(a[0], b[0], "CO_OCCUR", 0.5) for i, a in enumerate(ranked) for b in ranked[i + 1 :]]
    return ranked[:k], said[:k]


def test_hybrid_extraction_equals_a_plain_loop(spark):
    rng = random.Random(10)
    words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(26)]
    terms = {w: f"t{i % 3}" for i, w in enumerate(words[:8])}
    rows, replies, plain = [], [], {}
    for i in range(25):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 80])))
        reply = None
        if i % 4:
            names = [{"name": rng.choice([*words, "", "w", "absent"]), **({"type": "m", "confidence": rng.choice([0.5, 0.8, 0.99])} if rng.random() < 0.7 else {})} for _ in range(rng.randint(0, 12))]
            links = [{"source": "a", **({"target": "b", "relation": "R", "confidence": 0.9} if rng.random() < 0.5 else {})} for _ in range(rng.choice([0, 1, 3, 25]))]
            reply = {"entities": names, "relations": links}
            replies.append((i, "Here: " + json.dumps(reply) + " ok"))
        rows.append((i, text))
        plain[i] = plain_extract(text, terms, reply)
    rows.append((99, None))
    replies.append((99, "no json"))
    texts = spark.createDataFrame(rows, "id int, text string")
    entities, relations = EX.extract(texts, spark.createDataFrame(list(terms.items()), "term string, type string"), "id", "text", spark.createDataFrame(replies, "id int, reply string"))
    got, links = defaultdict(list), defaultdict(list)
    for r in sorted(entities.collect(), key=lambda r: r["rank"]):
        got[r.id].append((r.term, r.type, r.start, r.confidence, r.source))
    for r in sorted(relations.collect(), key=lambda r: r["rank"]):
        links[r.id].append((r.source, r.target, r.relation, r.confidence))
    for i, (want, said) in plain.items():
        assert got.get(i, []) == want
        assert links.get(i, []) == said
    assert 99 not in got and 99 not in links
    learnt = {(r.id, r.type, r.term) for r in EX.learned(entities, "id").collect()}
    assert learnt == {(i, f[1], f[0]) for i, (want, _) in plain.items() for f in want if f[4] == "llm" and f[3] > 0.7}


def test_register_as_json_object(spark, tmp_path):
    entry = {"doc_id": "a", "name": "A", "file_path": "/a", "status": "completed", "chunks_count": 3, "completed_chunks": [1, 2]}
    (tmp_path / "r.json").write_text(json.dumps({"a": entry, "b": {"doc_id": "b", "name": "B", "file_path": "/b", "status": "failed"}}, indent=2))
    rows = {r.doc_id: r for r in L.read_register(spark, str(tmp_path / "r.json")).collect()}
    assert (rows["a"].chunks_count, rows["a"].completed_chunks, rows["b"].chunks_count, rows["b"].completed_chunks, rows["b"].message) == (3, [1, 2], 0, [], "")


def test_markdown_keeps_code_and_open_marks():
    text = "a **b `c_d_e` f** __g__ *h\n```py\nx_y_z **no**\n```\n[l *i*](u_v_w)\n\n***\n\n> q"
    assert MD.render(text, MD.PLAIN) == "a b c_d_e f g *h\nx_y_z **no**\n\nl i (u_v_w)\n\nq"
    assert MD.render(None, MD.PLAIN) is None and MD.render("", MD.DECORATED) == ""


@pytest.mark.parametrize("extra", [[], [("any", 9, "")]])
def test_triggers_by_row_and_by_join(spark, extra):
    triggers = spark.createDataFrame([("b", 2, "Find"), ("a", 1, "look up"), ("c", 3, "up"), ("d", 1, "zz"), *extra], "skill string, ord int, trigger string")
    queries = spark.createDataFrame([(1, "please FIND it"), (2, "Look up or find"), (3, "nothing"), (4, None), (5, "zz up")], "id int, text string")
    ways = [sorted(tuple(r) for r in R.first_trigger(F.col("text"), triggers, queries, "id", small).collect()) for small in (100, 0)]
    assert ways[0] == ways[1] and (2, "a") in ways[0] and (5, "d") in ways[0]


def test_markdown_of_unclosed_marks_takes_linear_time():
    import time

    for line in ("[" * 200_000, "[x " * 70_000, "[](" * 70_000, "*" * 200_001, "~~a" * 70_000, "`" + "[" * 200_000 + "](", "_a " * 60_000 + "["):
        begun = time.time()
        MD.render(line, MD.PLAIN)
        assert time.time() - begun < 5, line[:10]


def test_markdown_without_marks_is_taken_at_once():
    import time

    text = "# plain words, and more of them " * 200_000 + "**end**"
    begun = time.process_time()
    assert MD.render(text, MD.PLAIN) == text.removeprefix("# ").replace("**", "")
    assert time.process_time() - begun < 0.5


def test_sources_are_counted_without_lists(spark):
    rows = [(1, "a", k % 7, k) for k in range(50)] + [(1, "b", 3, 60), (None, "c", 1, 61)]
    df = spark.createDataFrame(rows, "name int, description string, source_id int, ord int").withColumn("confidence", F.lit(0.5))
    assert sorted((r.name or 0, r.n_sources, r.description) for r in G.merge_entities(df, ["name"], listed=False).collect()) == [(0, 1, "c"), (1, 7, "a；b")]
    assert sorted((r.name or 0, r.n_sources) for r in G.merge_relations(df, ["name"], listed=False).collect()) == [(0, 1), (1, 7)]


def test_pairs_in_many_tasks(spark):
    rows = [(c, (c * 7 + i * i) % 23, i) for c in range(300) for i in range(5)] + [(c, n, -1) for c in range(300, 600) for n in (1, 2)] + [(999, n, n) for n in range(60)]
    df = spark.createDataFrame(rows, "chunk long, name long, ord long")
    want = {tuple(r) for r in G.edge_weights(G.cooccurrence(df, "chunk", "name", "ord", 20)).collect()}
    for task_mentions, tasks in ((10**6, 1), (100, 22)):
        got = G.cooccurrence_weights(df, "chunk", "name", "ord", 20, task_mentions)
        assert {tuple(r) for r in got.collect()} == want and got.rdd.getNumPartitions() == tasks
    assert G.cooccurrence_weights(df.where("false"), "chunk", "name", "ord").collect() == []


def test_folders_above(spark):
    from tessera.operators import vectors as O

    df = spark.createDataFrame([(1, "/a/b//c/"), (2, "a"), (3, ""), (4, None)], "id int, folder string")
    assert sorted((r.id, r.category) for r in O.with_ancestors(df, "folder").collect()) == [(1, "a"), (1, "a/b"), (1, "a/b/c"), (2, "a")]
