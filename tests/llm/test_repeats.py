import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import repeats as rp


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + rp.LENGTH] for r in raws for i in range(len(r) - rp.LENGTH + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - rp.LENGTH + 1):
            if count[r[i : i + rp.LENGTH]] > 1:
                gone[i : i + rp.LENGTH] = b"\1" * rp.LENGTH
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((doc_id, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    passages = [prose(n) for n in (150, 170, 210, 260, 400, 900)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 400), (5, "x" * 199), (6, "y" * 200), (7, "z" * 201), (None, prose(500))]
    for k in range(80):
        parts = [prose(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], prose(rng.randint(0, 60))]
        rows.append((10 + k, "".join(parts)))
    near = list(rows[-1][1] * 3)
    near[len(near) // 2] = "#"
    rows += [rows[-1], rows[-2], (200, "".join(near)), (201, prose(30_000) + passages[3])]
    return rows


@pytest.mark.parametrize("hot,cores", [(rp.HOT, rp.HOT_CORES), (16, rp.HOT_CORES), (16, 100)])
def test_equals_brute_force(spark, monkeypatch, hot, cores):
    monkeypatch.setattr(rp, "HOT_CORES", cores)
    rows = made(1)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, KEY string, start int")
    assert sorted((tuple(r) for r in rp.digests(df, hot).collect()), key=str) == brute(rows)


def test_spans_and_empty_table(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in rp.clean(df).collect():
        assert all(s.end - s.start >= rp.LENGTH for s in r.spans)
        assert len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans)
    assert rp.digests(df.where("false")).collect() == []
