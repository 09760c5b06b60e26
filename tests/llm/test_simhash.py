import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as sh


def brute_fp(text):
    words = text.encode().translate(sh.LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=2):
    n, lab = len(fps), list(range(len(fps)))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    low = {}
    for x, i in zip(lab, ids):
        if i is not None and (x not in low or i < low[x]):
            low[x] = i
    return [low.get(x) for x in lab]


def test_fingerprints():
    rng = np.random.default_rng(0)
    texts = ["", " \t\n", "One", "one two", "a b c", "Éa b\x0bc\x1cd", " ".join(map(str, rng.integers(0, 50, 40_000)))]
    for t in texts:
        assert sh.fingerprint(t) == brute_fp(t)


def test_marks(spark):
    rng = np.random.default_rng(1)
    base = " ".join(map(str, rng.integers(0, 10**6, 900)))
    texts = [None, "", "  ", "Some words", "some WORDS", base, base + " x", base + " y z", "unlike the others", "tie a b", "tie a b"]
    ids = [5, 3, None, 9, 8, 20, 21, 22, 23, 30, 30]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, FP int")
    got = sorted(tuple(r) for r in sh.mark(df).select("doc_id", "fingerprint", "component_id").collect() if r.doc_id is not None)
    fps = [brute_fp(t or "") for t in texts]
    want = brute_components(fps, ids)
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want) if i is not None)
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(want))
    assert sh.mark(df.where("false")).collect() == [] and sh.drop_near_copies(df.where("false")).collect() == []


@pytest.mark.parametrize("bucket", [sh.BUCKET, 4])
def test_groups_equal_brute_force(spark, bucket):
    """Dense clouds of fingerprints; with tiny buckets all levels of refinement run."""
    rng = np.random.default_rng(2)
    fps = []
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(25):
            fp = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                fp ^= 1 << b
            fps.append(fp)
    fps += [0, (1 << 64) - 1, (1 << 64) - 2]
    ids = rng.permutation(len(fps)).tolist()
    rows = spark.createDataFrame([(k, i, sh._signed(f)) for k, (i, f) in enumerate(zip(ids, fps))], "rid long, doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in sh.groups(rows, bucket=bucket).collect()}
    assert got == dict(zip(ids, brute_components(fps, ids)))
