import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate as dc


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            v = tokens(text)
            n = min(13, len(v))
            windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "漢字", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([40, 13, 14, 25, 60, 12, 5, 4, 30, 18])]
    items += [(100, items[0][1][10:]), (2, text(20)), (None, text(15)), (101, None), (102, "?!"), (103, " ".join(["same"] * 30))]
    docs = [(1, None), (2, ""), (3, text(5)), (None, items[1][1]), (4, " ".join(["same"] * 14))]
    for k in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            v = tokens(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 5))
            parts += ["; ".join(v[a : a + rng.randint(10, 40)]).upper() if rng.random() < 0.5 else " ".join(v[a:]), text(rng.randint(0, 10))]
        docs.append((10 + k, " - ".join(parts)))
    docs += [docs[-1], (500, " ".join([text(20_000), items[4][1]]))]
    return docs, items


@pytest.mark.parametrize("limit", [dc.LIMIT, 3])
def test_equals_brute_force(spark, limit):
    docs, items = made()
    d = spark.createDataFrame([(*r, 1, "a") for r in docs], "doc_id long, text string, RID int, words string")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, item int")
    got = sorted((tuple(r) for r in dc.mark(d, b, limit).collect()), key=str)
    assert got == brute(docs, items)
    if limit == dc.LIMIT:
        clean = dc.drop_contaminated(d, b)
        assert clean.columns == d.columns and clean.count() == sum(not r[5] for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.mark(d, none).collect()] == [(1, 2, 0, 0)]
    assert dc.mark(d.where("false"), none).collect() == []


def test_items_that_share_a_passage_are_met_once(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    items = spark.createDataFrame([(f"i{k:03d}", passage) for k in range(200)] + [("other", passage + " end")], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"start {passage} stop") for k in range(50)] + [(99, "clean text")], "doc_id long, text string")
    rows = docs.selectExpr("doc_id AS rid", "doc_id", "text")
    _, found, places = dc.hits(rows, items)
    assert found.count() <= 50 * 31 and places.select("place").distinct().count() < 40
    want = ",".join([*(f"i{k:03d}" for k in range(200)), "other"])
    got = {r.doc_id: r for r in dc.mark(docs, items).collect()}
    assert all(got[k].n_items == 201 and got[k].items_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[k].n_hit == 30 for k in range(50))
    assert got[99].n_items == 0 and not got[99].contaminated


def test_a_common_sentence_makes_no_rows(spark):
    sentence = "please answer the following question with one letter of these"
    own = lambda kind, k: " ".join(f"{kind}{k}x{i}" for i in range(20))
    items = [(k, f"{own('i', k)} {sentence} {own('j', k)}") for k in range(400)]
    docs = [(k, f"{own('d', k)} {sentence} {own('e', k)}") for k in range(400)] + [(900, f"{own('d', 1)} {items[7][1]}")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (dc.LIMIT, 3):
        scanned, found, _ = dc.hits(d.selectExpr("doc_id AS rid", "doc_id", "text"), b, limit)
        assert found.count() < 100 and {r.rid for r in found.collect()} == {900}
    assert sorted((tuple(r) for r in dc.mark(d, b).collect()), key=str) == brute(docs, items)
