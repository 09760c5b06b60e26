"""Quality scores from compressed sizes (operator 2).

Two zstandard dictionaries are built, one of good and one of bad labelled text. A text is compressed
in blocks, each on its own with either dictionary, so the dictionaries count to the end of a long
text. The difference of the two sizes over their sum is the signal; a logistic calibration, fitted
on labelled rows the dictionaries have not seen, turns it into a probability. Besides the
difference, the calibration knows the plain ratio of compressed to raw size (repetition squeezes
well under either dictionary) and how short the text is.

Only labelled rows that are not held out are learnt from (``labelled.sample``, a bounded sample).
Results for odd inputs: null and empty texts get the score of an empty text, between 0 and 1; with
no labels of one class every text gets the share of label 1; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, held_out, map_texts
from .labelled import Calibration, sample

BLOCK, DICTIONARY, LEVEL, KEEP = 1024, 64 * 1024, 3, 0.7
#: Blocks that each labelled text gives to a dictionary, evenly over its whole length, so long texts do not fill it alone.
SPREAD = 4


def spread(n: int) -> list[int]:
    """Up to ``SPREAD`` of ``n`` blocks, evenly over all of them."""
    some = min(n, SPREAD)
    return sorted({(2 * k + 1) * n // (2 * some) for k in range(some)})


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train on."""
    import zstandard

    blocks = [t[k * BLOCK : (k + 1) * BLOCK] for t in texts for k in spread(-(-len(t) // BLOCK))]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, blocks)) // 4), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts under the bad and the good dictionary, as features."""

    def __init__(self, bad: bytes, good: bytes):
        import zstandard

        self.pack = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pack.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, texts: list[str]) -> np.ndarray:
        bad, good = self.pack
        out = np.empty((len(texts), 5))
        for k, t in enumerate(texts):
            raw = t.encode()
            blocks = [raw[i : i + BLOCK] for i in range(0, max(1, len(raw)), BLOCK)]
            b, g = sum(len(bad(x)) for x in blocks), sum(len(good(x)) for x in blocks)
            d, ratio, short = (b - g) / (b + g), np.log((g + 8) / (len(raw) + 16)), 1 / (1 + len(raw) / 100)
            out[k] = d, ratio, min(0.0, ratio + 1.2) ** 2, short, d * short
        return out


class Model:
    """Dictionaries and calibration; small enough to travel with a task."""

    def __init__(self, texts: list[str], y: np.ndarray, weights: np.ndarray):
        self.share = float(np.average(y, weights=weights)) if len(y) else 0.5
        raw = [t.encode() for t in texts]
        learn = np.arange(len(y)) % 3 > 0
        by = [[r for r, use in zip(raw, learn & (y == k)) if use and r] for k in (0, 1)]
        rest = ~learn
        self.dictionaries = None
        if min(map(len, by)) and len(set(y[rest])) == 2:
            self.dictionaries = tuple(dictionary(b) for b in by)
            x = Sizes(*self.dictionaries).features([t for t, r in zip(texts, rest) if r])
            self.calibration = Calibration(x, y[rest], weights[rest])

    def scorer(self):
        if self.dictionaries is None:
            return lambda texts: [np.full(len(texts), self.share)]
        sizes = Sizes(*self.dictionaries)
        return lambda texts: [self.calibration.score(sizes.features(texts))]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "quality"))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text, under a name that is free."""
    return map_texts(docs, text, [(free_name(docs, name), "double")], model.scorer)


def predict(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    scored = score(docs.select("doc_id", "text"), model or fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows the classifier rejects."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) >= KEEP).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
