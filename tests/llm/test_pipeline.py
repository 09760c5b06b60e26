import importlib
import sys

import sentencepiece

import corpus_pipeline as cp
from tessera.llm import quality, sentencepiece_codec
from tests_llm_helpers import brute_components, brute_fp, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r.doc_id for r in quality.predict(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(rows):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i])] = i
    kept = sorted(last.values())
    groups = brute_components([brute_fp(rows[i]) for i in kept], kept)
    kept = sorted(set(groups))
    kept = [i for i in kept if not brute_hits(rows[i], items)]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, SF).collect()}
    assert got == {i: model.encode(rows[i]) for i in kept}
    assert 0 < len(kept) < docs.count()


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.where("false"), SF)
        assert out.columns == docs.columns and out.count() == 0
    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5


def test_entry_registers_all(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names} >= {"pipeline", *(f"op{k}" for k in range(1, 11))}
    assert set(entry.oracle_sql()) <= names
    assert "pyspark" in sys.modules


def test_stages_with_odd_rows_and_clashing_columns(spark):
    long = "some plain words of a long text " * 20_000
    rows = [(1, None), (2, ""), (3, "Tie words here"), (3, "tie words here"), (4, long), (None, long), (5, "other words entirely, " * 9), (5, "other words entirely, " * 9), (None, "lone text")]
    kind = "doc_id long, text string, RID int, fp string, score string, ids string, decoded int, text_key long, hash string"
    docs = spark.createDataFrame([(*r, 1, "f", "s", "i", 2, 3, "h") for r in rows], kind)
    exact = cp.exact_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in exact.collect()), key=str) == sorted([(2, ""), (3, "tie words here"), (4, long), (5, rows[6][1]), (None, "lone text")], key=str)
    near = cp.near_stage(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in near.collect()), key=str) == sorted([(1, ""), (3, "tie words here"), (4, long), (5, rows[6][1]), (None, "lone text")], key=str)
    clean = cp.benchmark_stage(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    good = cp.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    tokens = cp.token_stage(spark, docs, SF)
    assert tokens.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokens.collect()) == sorted((str(i), model.encode(t or "")) for i, t in rows)
