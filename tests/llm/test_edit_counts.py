import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import edit_counts as ec
from tessera.llm.token_files import default_model


def library():
    tok = Tokenizer.from_file(default_model())
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def test_random_edits_keep_the_counts_of_a_full_pass():
    rng, full, count = random.Random(1), library(), ec.counter(default_model()).counts
    bits = list("ab .,'\n\t 漢é0") + ["the ", " word", "\n\n", "  ", "don't", "　", "\0"]
    made = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for _ in range(150):
        text = made(rng.choice([0, 1, 5, 60, 900]))
        parts = ec.segments(text)
        assert "".join(parts) == text
        tree = ec.Tree(np.array([len(p) for p in parts], int), np.array(count(parts), int))
        for _ in range(12):
            at, remove, insert = rng.randint(-2, len(text) + 2), rng.choice([0, 0, 1, 3, 40, 500]), made(rng.choice([0, 1, 2, 9, 400]))
            a = min(max(at, 0), len(text))
            want = text[:a] + insert + text[min(len(text), a + remove) :]
            text, _ = ec.edit(text, tree, at, remove, insert, count)
            assert text == want
            assert (tree.chars, tree.tokens) == (len(text), full(text))
            assert np.array_equal(tree.leaves()[0], [len(p) for p in ec.segments(text)])


def test_only_the_region_is_encoded():
    text = " ".join(f"w{k}" for k in range(50_000))
    count = ec.counter(default_model()).counts
    parts = ec.segments(text)
    tree = ec.Tree(np.array([len(p) for p in parts]), np.array(count(parts)))
    assert ec.edit(text, tree, 100_000, 3, "new", count)[1] < 60


def test_query_equals_brute_force(spark):
    full = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = ec.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        n = len(t)
        new = t
        for at, remove, insert in ((n // 4, 12, ""), (n // 2, 0, " [edited\nhere] "), (int(n * 0.75), 7, "REDACTED")):
            at = min(at, len(new))
            new = new[:at] + insert + new[at + remove :]
        assert (r.n_before, r.n_after, r.n_chars) == (full(t), full(new), len(new))


def test_stored_trees_and_odd_rows(spark):
    full = library()
    rows = [(1, None, None), (2, "", [(0, 0, "a b")]), (3, "one two", [(100, 5, " x"), (None, None, None)]), (4, "x" * 20_000, []), (4, "x" * 20_000, [])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, edits array<struct<at:int,remove:int,insert:string>>, KEY string")
    once = ec.apply(ec.build(df))
    again = ec.apply(once.withColumn("edits", F.expr("array(struct(0 AS at, 1 AS remove, 'Q ' AS insert))")).drop("n_before", "n_after"))
    got = {r.doc_id: r for r in once.collect()}
    assert (got[1].n_after, got[2].text, got[3].text) == (0, "a b", "one two x")
    for r in again.collect():
        before = got[r.doc_id]
        assert r.text == "Q " + before.text[1:] and r.n_before == before.n_after and r.n_after == full(r.text)
    assert once.count() == 5 and ec.apply(ec.build(df.where("false"))).collect() == []


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "one two three", [(0, 3, "x")], "mine", 7)], "doc_id long, text string, edits array<struct<at:int,remove:int,insert:string>>, sizes string, COUNTS int")
    built = ec.build(df)
    assert built.columns == [*df.columns, "sizes_", "counts_"]
    r = ec.apply(built).first()
    assert (r.text, r.n_after, sum(r.sizes)) == ("x two three", library()("x two three"), 11)
