"""What the two classifiers share: their bounded sample of labelled rows, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, save

#: Most labelled documents of each class that a model is fitted on, and most bytes of all their texts
#: together. What reaches the driver is bounded by both, whatever the tables hold.
PER_CLASS, BYTES = 2000, 256 << 20


def within(rows: list, most: int) -> list:
    """The ``rows`` (y, size, ...) that fit ``most`` bytes: in their order and each class in half of it, a row that does not fit being passed over; what is left then goes to the rows passed over."""
    left, taken = {0: most // 2, 1: most - most // 2}, set()
    for k, r in enumerate(rows):
        if r.size <= left[r.y]:
            left[r.y] -= r.size
            taken.add(k)
    spare = sum(left.values())
    for k, r in enumerate(rows):
        if k not in taken and r.size <= spare:
            spare -= r.size
            taken.add(k)
    return [rows[k] for k in sorted(taken)]


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, most: int = BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts, labels (0 or 1) and weights of up to ``per_class`` documents of each class, none held out.

    Rows are chosen by a hash of their id, then by ``within`` from their sizes alone; only the texts of rows that
    fit are fetched. A class of which none of these rows fits is drawn anew, its shortest texts
    first; a ValueError says so if even the shortest one is too long. The weights restore the classes'
    shares among all labelled rows. Labels other than 0 and 1 and null ids are left out. A doc_id that
    several documents or labels have stands for all of these rows, equal ones fetched once, in the order of label and text.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(7))
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows at most
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.octet_length(text).alias("size"), F.xxhash64(text).alias("h"), text.alias("text"))
    at, keys = F.xxhash64("doc_id", F.lit(11)), ["doc_id", "y", "size", "h"]
    sizes = lambda rows: facts.drop("text").join(rows, "doc_id").groupBy(*keys).count().withColumn("at", at)
    rows = within(sizes(chosen).orderBy("at", *keys).limit(2 * per_class).collect(), most)
    for y in set(count) - {r.y for r in rows}:
        short = sizes(known.where(F.col("y") == y)).orderBy("size", "at", *keys).limit(per_class).collect()
        more = within(short, most // 2)
        if short and not more:
            raise ValueError(f"the shortest text of class {y} has {short[0].size} bytes; more than half of the bound of {most}")
        rows = within(rows, most - most // 2) + more
    if not rows:
        return [], np.zeros(0), np.zeros(0)
    picked = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in rows], "doc_id long, y int, size int, h long, count long, at long"))  # 2 * per_class rows at most
    held = save(facts.join(picked, ["doc_id", "size", "h"]).dropDuplicates(keys), "labelled")
    got = [r for r in held.orderBy("at", "doc_id", "y", "text").collect() for _ in range(min(r["count"], 2 * per_class))][: 2 * per_class]
    y = np.array([r.y for r in got], float)
    share = {k: count.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    weights = np.array([share[int(k)] for k in y])
    return [r.text for r in got], y, weights / max(weights.sum(), 1e-9) * len(y)


class Calibration:
    """A logistic curve over a few standardised features, by Newton steps with a little shrinkage."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, shrink: float = 0.5):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        a = self._design(x)
        self.w = np.zeros(a.shape[1])
        penalty = np.diag([1e-3] + [shrink] * (a.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            grad = a.T @ (weights * (y - p)) - penalty @ self.w
            step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + penalty, grad)
            step *= min(1, 3 / max(np.abs(step).max(), 1e-12))
            self.w += step
            if np.abs(step).max() < 1e-7:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))
