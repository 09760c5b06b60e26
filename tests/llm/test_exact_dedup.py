import hashlib

from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ed

ROWS = [(1, "Same"), (2, "same"), (3, None), (4, ""), (5, "x" * 100_000), (6, "X" * 100_000), (7, "Émile"), (8, "émile"), (None, "same"), (None, "lone"), (9, "tie"), (9, "TIE")]


def brute(rows):
    groups = {}
    for i, t in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(norm, []).append(i)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        flags = sorted([(i == keep and (j == ids.index(keep)), i) for j, i in enumerate(ids)], key=str)
        out += [(i, keep, len(ids), k, hashlib.sha256(norm.encode()).hexdigest()) for k, i in flags]
    return sorted(out, key=str)


def test_marks_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, "a", 1) for r in ROWS], "doc_id long, text string, RID string, hash int")
    want = brute(ROWS)
    assert sorted([tuple(r) for r in ed.mark(df).collect()], key=str) == want
    weak = lambda norm: F.xxhash64(norm) % 2  # noqa: E731  chains of many texts
    assert sorted([tuple(r) for r in ed.mark(df, weak, 1).collect()], key=str) == want
    kept = ed.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({w[4] for w in want})


def test_query_knows_rows_by_their_place(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted([tuple(r) for r in ed.query(spark, str(tmp_path)).collect()], key=str) == brute(ROWS)


def test_digests_decide_nothing(spark, monkeypatch):
    monkeypatch.setattr(ed, "digest", lambda norm: F.lit("one for all"))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted(((*w[:4], "one for all") for w in brute(ROWS)), key=str)
    for key in (F.xxhash64, lambda norm: F.length(norm).cast("long")):
        assert sorted([tuple(r) for r in ed.mark(df, key, 1).collect()], key=str) == want


def test_hot_group_and_empty_table(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    rows = [tuple(r) for r in df.collect()]
    assert sorted([tuple(r) for r in ed.mark(df, capacity=16).collect()], key=str) == brute(rows)
    empty = df.where("false")
    assert ed.mark(empty).collect() == [] and ed.drop_copies(empty).collect() == []


def test_directory_splits_only_overfull_buckets():
    top = 1 << ed.PREFIX_BITS
    depth, buckets = ed.directory({0: 10, 1: 10, top - 1: 3}, 12)
    assert depth == ed.PREFIX_BITS  # the two first prefixes part at the last bit
    assert (0, depth) in buckets and (1, depth) in buckets and (1, 1) in buckets
    assert sum(1 << (depth - d) for _, d in buckets) == 1 << depth
    assert ed.directory({}, 5) == (0, [(0, 0)])
