"""Toxicity scores from subword-bag embeddings (operator 5).

A word is the bag of its character n-grams (3 to 6 bytes, word borders included), each hashed to a
row of one embedding table, so misspellings and inflections share most of their vectors. The vectors
of a word's n-grams are averaged and go into a linear softmax of two classes. Table and softmax are
trained jointly in numpy. Documents are labelled as a whole while insults are single words, so the
margins of a document's words are pooled by a soft maximum, and training steps take the gradient
through it: every word counts by its share. A logistic calibration on documents the model has not
seen makes the score; it knows the pooled margin, the highest one and the number of words.

For scoring, softmax and table fold into one number a hashed n-gram; whole texts are scored in a few
array passes. Only labelled rows that are not held out are learnt from (a bounded sample).
Results for odd inputs: null and empty texts and texts without letters count as one empty word;
with no labels of one class every text gets the share of label 1; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, held_out, map_texts
from .labelled import Calibration, sample

LONGEST, TABLE_BITS, WIDTH = 6, 17, 8
STEPS, RATE, FLAG, LEAST_DOCS = 60, 0.03, 0.3, 6
#: How soft the maximum over words is.
HEAT = 2.0
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spell(text: str) -> np.ndarray:
    """The words of a text, lower-cased, each between single spaces, as bytes."""
    return np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" ", "u1")


def grams(b: np.ndarray):
    """(rows of the table, word numbers) of the n-grams, a pair for each length."""
    space = b == 32
    word = np.cumsum(space, dtype="i4") - 1
    stops = np.flatnonzero(space)
    after = stops[np.minimum(word + 1, len(stops) - 1)].astype("i4")  # the space that ends the word
    h = b.astype("u4")
    for n in range(2, LONGEST + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n < 3:
            continue
        at = np.flatnonzero(np.arange(len(h), dtype="i4") + (n - 1) <= after[: len(h)])
        g = h[at] * np.uint32(0x9E3779B1)
        yield g >> np.uint32(32 - TABLE_BITS), word[at]


def word_means(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the mean of its n-grams' numbers in ``table``."""
    n = max(1, int((b == 32).sum()) - 1)
    total, count = np.zeros(n), np.zeros(n)
    for rows, word in grams(b):
        total += np.bincount(word, table[rows], n)[:n]
        count += np.bincount(word, minlength=n)[:n]
    return total / np.maximum(count, 1)


class Bags:
    """Training texts as distinct words with their n-grams."""

    def __init__(self, texts: list[str]):
        ids: dict[bytes, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in spell(t).tobytes().split()] or [ids.setdefault(b"", len(ids))]) for t in texts]
        b = np.frombuffer(b" " + b" ".join(ids) + b" ", "u1") if ids else spell("")
        if b"" in ids:  # an empty word has no n-grams, and would shift the numbers of the others
            names = [w for w in ids if w]
            renamed = {w: k for k, w in enumerate(names)} | {b"": len(names)}
            table = np.array([renamed[w] for w in ids])
            self.docs = [table[d] for d in self.docs]
            b = np.frombuffer(b" " + b" ".join(names) + b" ", "u1")
        self.n = len(ids)
        rows, word = (np.concatenate(c) for c in zip(*grams(b)))
        order = np.argsort(word, kind="stable")
        self.rows, self.word = rows[order], word[order]
        self.size = np.maximum(np.bincount(self.word, minlength=self.n), 1)
        self.first = np.r_[0, np.cumsum(np.bincount(self.word, minlength=self.n))]

    def common(self, docs: np.ndarray) -> np.ndarray:
        """1 for the rows of the table whose n-grams are in ``LEAST_DOCS`` of the documents or more, else 0: rarer ones say nothing of new texts."""
        count = np.zeros(1 << TABLE_BITS, "i4")
        for d in docs:
            own = np.unique(self.docs[d])
            lengths = self.first[own + 1] - self.first[own]
            at = np.repeat(self.first[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            hit = np.zeros(1 << TABLE_BITS, bool)
            hit[self.rows[at]] = True
            count += hit
        return (count >= LEAST_DOCS).astype("f4")


class Step:
    """Loss and gradients of (table, softmax, bias) on some documents, through the soft maximum over their words."""

    def __init__(self, bags: Bags, docs: np.ndarray, y: np.ndarray, weights: np.ndarray, common: np.ndarray):
        self.bags, self.y, self.common, self.weights = bags, y, common, weights / weights.sum()
        self.words = np.concatenate([bags.docs[d] for d in docs])
        sizes = np.array([len(bags.docs[d]) for d in docs])
        self.begin, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)

    def __call__(self, params: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        (table, soft, bias), bags = params, self.bags
        line = (table @ (soft[:, 1] - soft[:, 0])).astype("f8")
        margins = (np.bincount(bags.word, line[bags.rows], bags.n) / bags.size)[self.words]
        top = np.maximum.reduceat(margins, self.begin)
        share = np.exp((margins - top[self.owner]) / HEAT)
        total = np.add.reduceat(share, self.begin)
        pooled = np.clip(top + HEAT * np.log(total) + bias[1] - bias[0], -30, 30)
        p = 1 / (1 + np.exp(-pooled))
        loss = float(self.weights @ (np.logaddexp(0, pooled) - self.y * pooled))
        error = self.weights * (p - self.y)
        # back from the softmax to the words by their shares, then to their n-grams
        on_word = np.bincount(self.words, (error / total)[self.owner] * share, bags.n) / bags.size
        on_row = (np.bincount(bags.rows, on_word[bags.word], 1 << TABLE_BITS) * self.common).astype(table.dtype)
        pull = on_row @ table
        return loss, [on_row[:, None] * (soft[:, 1] - soft[:, 0]), np.c_[-pull, pull], np.array([-error.sum(), error.sum()], table.dtype)]


def train(bags: Bags, docs: np.ndarray, y: np.ndarray, weights: np.ndarray, seed: int = 0) -> np.ndarray:
    """Trains table and softmax jointly (Adam); returns what each row of the table adds to the toxic margin."""
    rng = np.random.default_rng(seed)
    common = bags.common(docs)
    params = [rng.normal(0, 0.1, (1 << TABLE_BITS, WIDTH)).astype("f4") * common[:, None], rng.normal(0, 0.5, (WIDTH, 2)).astype("f4"), np.zeros(2, "f4")]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    gradients = Step(bags, docs, y, weights, common)
    for step in range(1, STEPS + 1):
        for p, g, (m1, m2) in zip(params, gradients(params)[1], state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    table, soft, _ = params
    return (table @ (soft[:, 1] - soft[:, 0])).astype("f8")


def features(text: str, line: np.ndarray) -> tuple[float, float, float]:
    """The pooled margin that training looks at, the highest one of a word, and the length."""
    m = word_means(spell(text), line)
    top = float(m.max())
    return top + HEAT * float(np.log(np.exp((m - top) / HEAT).sum())), top, float(np.log1p(len(m)))


class Model:
    """The folded table and the calibration; half a megabyte that travels with a task."""

    def __init__(self, texts: list[str], y: np.ndarray, weights: np.ndarray):
        self.share = float(np.average(y, weights=weights)) if len(y) else 0.5
        learn = np.arange(len(y)) % 4 > 0
        rest, self.line = ~learn, None
        if len(set(y[learn])) == 2 and len(set(y[rest])) == 2:
            even = np.where(y == 1, 1 / max(1, (y[learn] == 1).sum()), 1 / max(1, (y[learn] == 0).sum()))  # classes count alike in training
            self.line = train(Bags(texts), np.flatnonzero(learn), y[learn], even[learn]).astype("f4")
            x = np.array([features(t, self.line) for t, r in zip(texts, rest) if r])
            self.calibration = Calibration(x, y[rest], weights[rest], 0.1)

    def scorer(self):
        if self.line is None:
            return lambda texts: [np.full(len(texts), self.share)]
        return lambda texts: [self.calibration.score(np.array([features(t, self.line) for t in texts]))]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "toxic"))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text, under a name that is free."""
    return map_texts(docs, text, [(free_name(docs, name), "double")], model.scorer)


def predict(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    scored = score(docs.select("doc_id", "text"), model or fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
