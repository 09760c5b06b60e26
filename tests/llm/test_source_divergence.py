import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import source_divergence as sd


def brute(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
    out = []
    for lang in {g for _, g, _ in rows}:
        docs = [(words(t), s) for t, g, s in rows if g == lang]
        df = Counter(w for ws, _ in docs for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: Counter() for _, s in docs}
        for ws, s in docs:
            count[s].update(w for w in ws if df[w] >= least)
        whole = sum(count.values(), Counter())
        weights = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: weights(c) for s, c in count.items()}, weights(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, TERM string")


def result(df, **kw):
    return sorted(tuple(r) for r in sd.divergence(df, **kw).collect())


def test_equals_brute_force_with_odd_inputs(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Straße", "a", "B", "b", "longer-words", "ééé", "x1y", "extraordinarily", "extraordinary", "日本"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30))), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "s3"]))) for _ in range(150)]
    rows += [(None, "en", "none"), ("", None, None), ("lone words", "fr", "f1"), ("lone words", "fr", "f2"), ("w" * 50_000, "en", "s1"), *[("same row", "en", "s2")] * 12]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows), least_docs=1, top=2) == brute(rows, 1, 2)
    assert result(frame(spark, rows).where("false")) == []


def test_many_weights_and_salts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 2)
    monkeypatch.setattr(sd, "PER_SALT", 2)
    rows = [(" ".join("abcdefghi"[k] for k in range(9) for _ in range((i * (k + 1)) % 7)), "en", f"s{i % 5}") for i in range(40)]
    assert result(frame(spark, rows), least_docs=2) == brute(rows, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB é日-", max_size=30), max_size=8), st.sampled_from([2, 1 << 14]))
def test_pointers_sort_like_words(texts, small):
    raw, at = sd.segments.flat(pa.array(texts, pa.string()))
    starts, ends = sd.word_bounds(sd.IN_WORD[raw], at)
    words = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in re.findall(b"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.encode())]
    order, new = sd.multikey_sort(raw, starts, ends - starts, small)
    got = [words[i] for i in order]
    assert got == sorted(words) and sorted(order) == list(range(len(words)))
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
    assert all(order[i - 1] < order[i] for i in range(1, len(got)) if not new[i])


def test_long_common_fronts_sort(spark):
    words = [b"p" * 100 + bytes([97 + i % 5]) * (i % 3) for i in range(200)]
    raw = np.frombuffer(b" ".join(words), "u1")
    starts, ends = sd.word_bounds(sd.IN_WORD[raw], np.array([0, len(raw)]))
    order, _ = sd.multikey_sort(raw, starts, ends - starts, 4)
    assert [words[i] for i in order] == sorted(words)
