import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_held_out_rows(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.predict(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    y = np.array([r[label] for r in out])
    assert auc(np.array([r.score for r in out]), y) > least


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((r.doc_id, r.score) for r in quality.predict(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    texts = [(1, None), (2, ""), (None, "words"), (3, "!!! 12"), (4, "long " * 50_000), (4, "long " * 50_000)]
    docs = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, SCORE double")
    rich = spark.createDataFrame([(k, f"good sensible words {k} here" if k % 2 else f"idiot ### {k} @@") for k in range(100, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(100, 200)] + [(None, 1, 1), (1, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")
    train = docs.select("doc_id", "text").unionByName(rich)
    rows = module.predict(docs, labels, module.fit(train, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    none = module.predict(docs, labels.where("false")).collect()
    assert all(r.score == 0.5 for r in none)
    assert module.predict(docs.where("false"), labels).collect() == []
    if module is quality:
        assert quality.drop_poor(docs, labels).columns == docs.columns


def test_sample_is_bounded(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 AS int) AS quality")
    texts, y, w = labelled.sample(docs, labels, "quality", per_class=20)
    assert len(texts) <= 40 and set(map(len, texts)) == {100}  # whole texts
    assert 0.05 < np.average(y, weights=w) < 0.15  # the classes' true shares
    some, z, _ = labelled.sample(docs, labels, "quality", per_class=20, most=1234)
    assert len(some) == 12 and (z == 1).sum() == 6  # each class has half


@pytest.mark.parametrize("at", ["first", "middle", "last"])
def test_a_text_over_the_bound_is_passed_over(spark, at):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', 10) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    order = [r.doc_id for r in docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").orderBy(F.xxhash64("doc_id", F.lit(11))).collect()]
    odd = order[{"first": 0, "middle": len(order) // 2, "last": -1}[at]]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == odd, F.repeat(F.lit("y"), 5000)).otherwise(F.col("text")))
    texts, y, w = labelled.sample(docs, labels, "quality", most=2000)
    assert len(texts) == len(order) - 1 and set(texts) == {"x" * 10}
    assert len(w) == len(y) and set(y) == {0, 1}
    whole, *_ = labelled.sample(docs, labels, "quality", most=20_000)
    assert len(whole) == len(order) and "y" * 5000 in whole


def test_a_class_of_long_texts_is_drawn_anew(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'good words' WHEN id < 290 THEN repeat('b', 5000) ELSE 'bad' END AS text")
    labels = docs.selectExpr("doc_id", "cast((doc_id + 1) % 2 AS int) AS quality")
    texts, y, _ = labelled.sample(docs, labels, "quality", per_class=5, most=4000)
    assert set(y) == {0, 1} and {t for t, k in zip(texts, y) if k == 0} <= {"bad"}
    with pytest.raises(ValueError, match="class 0"):
        labelled.sample(docs.where("text <> 'bad'"), labels, "quality", per_class=5, most=4000)
    only, z, _ = labelled.sample(docs.where("doc_id % 2 = 0"), labels, "quality")
    assert set(z) == {1}  # no document of the other class
    assert quality.fit(docs.where("doc_id % 2 = 0"), labels).scorer()(["x"])[0][0] == 1.0


def test_repeated_ids_in_the_sample(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k}") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, 1)], "doc_id long, quality int")
    texts, y, _ = labelled.sample(docs, labels, "quality")
    seen = {k for k in range(50) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert sorted(texts) == sorted(f"text {k}" for k in range(100) if k % 50 in seen for _ in range(1 + (k % 50 == 1)))
    assert len(y) == len(texts)


def test_repeated_rows_are_bounded(spark):
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "'same' AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    texts, y, _ = labelled.sample(docs, labels, "quality", per_class=50)
    assert len(texts) == 100 and set(texts) == {"same"}


def test_calibration_is_a_logistic_fit():
    rng = np.random.default_rng(1)
    x, weights = rng.normal(size=(400, 2)) * [1, 5] + [3, -2], rng.uniform(0.5, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 3 - 0.3 * (x[:, 1] + 2))))).astype(float)
    got = labelled.Calibration(x, y, weights, 0.5)
    a = np.c_[np.ones(400), np.clip((x - x.mean(0)) / x.std(0), -8, 8)]
    w = np.zeros(3)
    for _ in range(20_000):  # plain gradient ascent on the same penalised likelihood
        p = 1 / (1 + np.exp(-a @ w))
        w += 2e-3 * (a.T @ (weights * (y - p)) - np.array([1e-3, 0.5, 0.5]) * w)
    assert np.allclose(got.w, w, atol=1e-5)
    assert np.allclose(got.score(x), 1 / (1 + np.exp(-a @ w)), atol=1e-5)


def test_quality_model_is_made_as_described():
    """Split, blocks and calibration by hand."""
    import zstandard

    texts = [f"good sensible words {k} here " * (1 + 40 * (k % 7)) if k // 5 % 2 else f"idiot ### {k} @@ " * (1 + k % 5) for k in range(300)]
    y = np.array([k // 5 % 2 for k in range(300)], float)
    m = quality.Model(texts, y, np.ones(300))
    for kind in (0, 1):
        blocks = []
        for k, t in enumerate(texts):
            if k % 3 and y[k] == kind:
                own = [t.encode()[i : i + 1024] for i in range(0, len(t.encode()), 1024)]
                blocks += [own[j] for j in sorted({(2 * i + 1) * len(own) // (2 * min(len(own), 4)) for i in range(min(len(own), 4))})]
        assert m.dictionaries[kind] == zstandard.train_dictionary(min(65536, sum(map(len, blocks)) // 4), blocks, level=3).as_bytes()
    rest = [t for k, t in enumerate(texts) if k % 3 == 0]
    again = labelled.Calibration(quality.Sizes(*m.dictionaries).features(rest), y[::3], np.ones(len(rest)))
    assert np.allclose(again.w, m.calibration.w)


def test_toxicity_gradients_equal_differences():
    texts = ["you idiot person", "fine words here", "idiots all", "some fine day", "plain", "idiot"] * 3
    y = np.array([1, 0, 1, 0, 0, 1] * 3, float)
    bags, weights = toxicity.Bags(texts), np.linspace(0.5, 1.5, 18)
    docs = np.arange(18)
    rng = np.random.default_rng(2)
    table = rng.normal(0, 0.3, (1 << toxicity.TABLE_BITS, toxicity.WIDTH))
    params = [table, rng.normal(0, 0.5, (toxicity.WIDTH, 2)), rng.normal(0, 0.5, 2)]
    common = bags.common(docs).astype("f8")
    params[0] *= common[:, None]
    step = toxicity.Step(bags, docs, y, weights, common)
    grads = step(params)[1]
    used = np.flatnonzero(common)
    for p, g, places in ((params[0], grads[0], [(int(r), 3) for r in used[:6]]), (params[1], grads[1], [(0, 0), (5, 1)]), (params[2], grads[2], [(0,), (1,)])):
        for at in places:
            old, d = p[at], 1e-4
            p[at] = old + d
            up = step(params)[0]
            p[at] = old - d
            down = step(params)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * d), abs=2e-5, rel=2e-3)


TEXTS = ["", "short", "Good sensible words " * 300, "idiot ### @@ " * 40, "\u00e9\u6f22 mixed" * 200, "a"]


def fitted(module):
    texts = [f"good sensible words {k} here " * (1 + k % 7) if k // 5 % 2 else f"idiot ### {k} @@ " * (1 + k % 5) for k in range(200)]
    y = np.array([k // 5 % 2 for k in range(200)], float)
    return module.Model(texts, y if module is quality else 1 - y, np.ones(200))


def test_quality_scores_follow_the_definition(spark):
    import zstandard

    m = fitted(quality)
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1), m).orderBy("i").collect()]
    sizes = []
    for raw in m.dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        sizes.append([sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(b)) for b in ([t[i : i + 1024] for i in range(0, len(t), 1024)] or [b""])) for t in (x.encode() for x in TEXTS)])
    for t, bad, good, s in zip(TEXTS, *sizes, got, strict=True):
        n = len(t.encode())
        difference, ratio, short = (bad - good) / (bad + good), math.log((good + 8) / (n + 16)), 1 / (1 + n / 100)
        x = np.clip((np.array([difference, ratio, min(0, ratio + 1.2) ** 2, short, difference * short]) - m.calibration.mean) / m.calibration.scale, -8, 8)
        assert s == pytest.approx(1 / (1 + math.exp(-np.clip(m.calibration.w[0] + x @ m.calibration.w[1:], -30, 30))), abs=1e-9)


def test_toxicity_scores_follow_the_definition(spark):
    m = fitted(toxicity)
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1), m).orderBy("i").collect()]

    def margin(word):
        b, rows = b" " + word + b" ", []
        for n in range(3, 7):
            for i in range(len(b) - n + 1):
                h = b[i]
                for c in b[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                rows.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.TABLE_BITS))
        return sum(float(m.line[r]) for r in rows) / len(rows) if rows else 0.0

    for t, s in zip(TEXTS, got, strict=True):
        w = [margin(x) for x in re.findall(b"[a-z\x80-\xff]+", t.lower().encode())] or [0.0]
        pooled = max(w) + toxicity.HEAT * math.log(sum(math.exp((x - max(w)) / toxicity.HEAT) for x in w))
        x = np.clip((np.array([pooled, max(w), math.log1p(len(w))]) - m.calibration.mean) / m.calibration.scale, -8, 8)
        assert s == pytest.approx(1 / (1 + math.exp(-np.clip(m.calibration.w[0] + x @ m.calibration.w[1:], -30, 30))), abs=1e-5)


def test_misspellings_share_vectors():
    m = fitted(toxicity)
    toxic, odd, good = m.scorer()(["you idiot", "you idiottt", "sensible words"])[0]
    assert toxic > 0.5 and odd > 0.5 and good < 0.5
