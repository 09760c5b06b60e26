import collections
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import spelling as sp


def brute(rows, least=7, every=31, twice=2, times=10):
    counts = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= twice}
    near = collections.defaultdict(set)
    by = collections.defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by[k, w[:k] + w[k + 1 :]].add(w)
    for (_, d), s in by.items():
        for a in s:
            near[a] |= s - {a}
            if d in counts:
                near[a].add(d)
                near[d].add(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, N int")
    got = sorted(tuple(r) for r in sp.variants(df, **kw).collect())
    kw = {k: v for k, v in kw.items() if k not in ("parts", "work")}
    assert got == brute(rows, **kw)
    return got


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    stems = ["straightforward", "éclairage", "ÉCLAIRAGE", "Überraschung", "between", "betweens", "mississippi", "aaaaaaaa", "aaaaaaaaa", "×÷×÷×÷×÷"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.integers(0, 60)):
            w = str(rng.choice(stems))
            if rng.random() < 0.1:
                k = int(rng.integers(0, len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :]][int(rng.integers(0, 3))]
            words.append(w)
        out.append((i, str(rng.choice([" ", ", ", "-9-"])).join(words)))
    return out


def test_equals_brute_force_with_odd_inputs(spark):
    rows = [*texts(120), (None, "between betweem"), (None, None), (7, ""), (7, "shortly shortlu"), (8, "l" * 3000 + " " + "l" * 2999 + "m"), (8, "l" * 3000 + " " + "l" * 2999 + "m"), (9, "same same")] * 2
    got = check(spark, rows)
    assert any(r[1] for r in got)
    check(spark, rows, parts=2, work=3)  # every bucket is split down to one place
    check(spark, rows, least=2, every=3, twice=1, times=2, parts=1)


def test_no_words_and_empty_table(spark):
    check(spark, [(1, None), (2, "tiny words"), (3, "oneword")])
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_buckets_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "FEW", 2)
    monkeypatch.setattr(sp, "BLOCK", 5)
    check(spark, texts(60), parts=1)


def test_chains_of_forms(spark):
    words = {"gradient": 2000, "gradieat": 150, "gradiaat": 14}
    rows = [(i, " ".join([w] * (n // 2))) for i, (w, n) in enumerate(list(words.items()) * 2)]
    got = {r[0]: r for r in check(spark, rows, every=1 << 40)}
    assert got["gradiaat"][1:3] == ("gradieat", "gradient")


def test_checksums_of_short_and_long_runs():
    data = [b"a", b"", b"some bytes", b"x" * 500]
    raw = np.frombuffer(b"".join(data), "u1")
    ends = np.cumsum([len(d) for d in data])
    before = np.array([zlib.crc32(b"12:")] * 4, "u4")
    got = sp.checksums(raw, ends - [len(d) for d in data], ends, before)
    assert got.tolist() == [zlib.crc32(b"12:" + d) for d in data]


def test_pairs_of_a_bucket_are_met_once():
    words = sorted({f"abc{a}{b}fg" for a in "dxyz" for b in "exyz"} | {"abcdeefg", "abcdfg"}, key=lambda w: (len(w), w))
    words = [w for w in words if len(w) >= 7]
    size = [len(w) for w in words]
    t = pa.table({"l": pa.array([7] * len(words), pa.int32()), "low": pa.array([0] * len(words), pa.int32()), "high": pa.array([8] * len(words), pa.int32()), "key": pa.array([1] * len(words), pa.int64()), "size": pa.array(size, pa.int32()), "word": words, "n": pa.array(range(len(words)), pa.int64())})
    got = {r["word"]: r["near"] for r in sp.solve(t).to_pylist()}
    want = {r[0]: r[4] for r in brute([(1, " ".join(words)), (2, " ".join(words))], every=1 << 40)}
    assert got == {w: n for w, n in want.items() if n}
