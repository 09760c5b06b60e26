import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import edit_counts as ec
from tessera.llm import sentencepiece_codec as sp
from tessera.llm import token_files as tf

TEXTS = [None, "", " ", "plain words here", "  two  spaces ", "a\nb\n\nc \n d\t e", "漢字 é 😀 ▁ x", "x" * 5000, "the the the\nthe", "don't 's 12 34.5,!", "nul\0 in", "</s> <|endoftext|> <0x0A>", "  b　c", "word " * 3000]


def frame(spark, texts, extra=False):
    rows = [(i * 7 % 101 if i else None, t, "IDS") for i, t in enumerate(texts)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    return df if extra else df.drop("IDS")


def test_sentencepiece_matches_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    got = sp.digests(frame(spark, TEXTS, extra=True)).collect()
    assert len(got) == len(TEXTS) + 1
    want = {}
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "")
        want[i * 7 % 101 if i else None] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("seed", range(3))
def test_prefix_table_on_random_strings(seed):
    model = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    codec = sp.codec(sp.default_model())
    rng = np.random.default_rng(seed)
    alphabet = list(" \n\t▁abetнж漢😀é…ththeing  .,!0123\0") + ["</s>", "the", "    "]
    for _ in range(500):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        ids = codec.encode(text).tolist()
        assert ids == model.encode(text)
        assert codec.decode(ids) == model.decode(ids)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.digests(empty).collect() == []
    assert tf.digests(empty, str(tmp_path)).collect() == []


def test_token_files_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(tf.default_model())
    df = frame(spark, TEXTS)
    manifest = tf.write(df, str(tmp_path), files=5)
    rows = tf.read(manifest).collect()
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [tf.END_ID])
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        by_id[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    assert not any(by_id.values())
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys)
    some = tf.read(manifest, [14, 21]).collect()
    assert {r.doc_id for r in some} == {14, 21} and {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in rows}
    crc = {r.start: r.ids_crc32 for r in tf.digests(df, str(tmp_path / "more")).collect()}
    assert crc == {r.start: zlib.crc32(bytes(r.ids)) for r in rows}


def test_rows_of_one_doc_id_fill_several_files(spark, tmp_path):
    rows = [(None if k % 4 == 3 else 7, f"text {k}") for k in range(400)] + [(3, "low"), (9, "high")]
    manifest = tf.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), files=8)
    assert sorted(r.n_documents for r in manifest.collect())[-1] < 100 and manifest.count() >= 6
    got = sorted(tf.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 100 + [3] + [7] * 300 + [9]
    assert [r.start for r in got[1:]] == [r.start + r.n_tokens for r in got[:-1]]


def test_token_files_notice_damage(tmp_path):
    w = tf.Writer(str(tmp_path / "f.zst"), "<u2")
    w.add(5, np.arange(100, dtype="<u2").tobytes())
    w.add(6, b"")
    w.close()
    raw = bytearray((tmp_path / "f.zst").read_bytes())
    assert tf.Reader(str(tmp_path / "f.zst")).ids(0).tolist() == list(range(100))
    assert tf.Reader(str(tmp_path / "f.zst")).ids(1).tolist() == []
    raw[20] ^= 255
    (tmp_path / "f.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        tf.Reader(str(tmp_path / "f.zst")).ids(0)


@pytest.mark.parametrize("seed", range(3))
def test_segments_of_random_strings_give_the_library_ids(seed):
    tok, e = Tokenizer.from_file(tf.default_model()), tf.encoder(tf.default_model())
    rng = np.random.default_rng(seed)
    alphabet = list(" \n\t\r\x1c\x85\u00a0\u2003\u3000abtTнé漢😀…'s,!.(0_9") + ["<|endoftext|>", "'re", "\n\n", "  ", "the", " of"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(2000)]
    got = e.encode(pa.array(texts)).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, e.type).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    sliced = e.encode(pa.array(texts)[7:40], b"\2\0").to_pylist()
    assert sliced == [ids + b"\2\0" for ids in got[7:40]]
    chars, tokens = ec.counter(tf.default_model()).leaves(pa.array(texts))
    for text, c, n, ids in zip(texts, chars.to_pylist(), tokens.to_pylist(), got, strict=True):
        assert c == [len(p) for p in ec.segments(text)], repr(text)
        assert sum(n) == len(ids) // 2, repr(text)


def test_clashing_columns_stay(spark):
    from tessera.llm import sentencepiece_codec as sc
    from tessera.llm import token_files as tf

    df = spark.createDataFrame([(1, "some words", "mine", 2, "f", 3)], "doc_id long, text string, IDS string, decoded int, part string, rank int")
    assert sc.encode(df).columns == [*df.columns, "ids_"]
    r = sc.encode_decode(df).first()
    assert (r.IDS, r.decoded, r.decoded_) == ("mine", 2, "some words") and len(r.ids_) > 1
    from tessera.llm.common import fresh_path

    assert [x.doc_id for x in tf.digests(df, fresh_path(spark, "ids")).collect()] == [1]
