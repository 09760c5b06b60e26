"""Vector arithmetic as expressions: sums in double, whatever the elements are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def literal(values) -> Column:
    """A vector as a constant."""
    return F.array(*(F.lit(float(x)) for x in values))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def _digest_mod(digest: Column, modulus: int, groups: int = 8) -> Column:
    """The 128-bit number that an md5 text stands for, or its front ``groups`` of 16 bits, modulo ``modulus``: Horner's rule."""
    total = F.lit(0).cast("long")
    for i in range(groups):
        part = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")
        total = (total * 65536 + part) % modulus
    return total


def gram_bin(gram: Column, dim: int = 384) -> Column:
    """The place of an n-gram in a hash embedding."""
    return _digest_mod(F.md5(gram), dim).cast("int")


def gram_weight(gram: Column) -> Column:
    """The weight of an n-gram: bits 16 and up of its digest, in thousandths."""
    return _digest_mod(F.md5(gram), 1000, groups=7) / F.lit(1000.0)


def char_grams(text: Column, low: int = 1, high: int = 2) -> Column:
    """All character n-grams of the lower-cased text."""
    t = F.lower(text)

    def slices(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))

    parts = [slices(n) for n in range(low, high + 1)]
    made = [F.when(F.length(t) >= n, p).otherwise(F.array().cast("array<string>")) for n, p in zip(range(low, high + 1), parts)]
    return F.concat(*made)


def random_projection(dim: int = 384, seed: int = 42):
    """A vectorised function from text to a unit vector drawn from a generator that the text seeds."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib
        import random

        import numpy as np

        def one(text):
            rng = random.Random(seed + int(hashlib.md5((text or "").encode()).hexdigest(), 16))
            v = np.array([rng.uniform(-1, 1) for _ in range(dim)])
            return v / np.linalg.norm(v)

        for texts in batches:
            yield texts.map(one)

    return embed
