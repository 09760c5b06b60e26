"""Texts that hold the literal of an added token, against the library's defaults."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import edit_counts as ec
from tessera.llm import token_files as tf

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a\n<|endoftext|>\nb<|endoftext|>c", "two  <|endoftext|>  blanks ", "plain words", "<|endof text|>", None]


def ids(text):
    return Tokenizer.from_file(tf.default_model()).encode(text or "", add_special_tokens=False).ids


def test_token_files_read_added_tokens(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ids(TEXTS[0]) == [87, 220, 50256, 331]
    start = 0
    for r in sorted(tf.query(spark, str(tmp_path)).collect()):
        want = [*ids(TEXTS[r.doc_id]), tf.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_edit_counts_read_added_tokens():
    count = ec.counter(tf.default_model()).counts
    for text in TEXTS[:-1]:
        parts = ec.segments(text)
        tree = ec.Tree(np.array([len(p) for p in parts]), np.array(count(parts)))
        assert tree.tokens == len(ids(text))
        new, _ = ec.edit(text, tree, 3, 1, "a <|endoftext", count)
        new, _ = ec.edit(new, tree, 3 + len("a <|endoftext"), 0, "|> b", count)
        assert "<|endoftext|> b" in new and tree.tokens == len(ids(new))
