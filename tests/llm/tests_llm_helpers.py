"""Brute-force versions that several tests use."""

import re

import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fp(text):
    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", lower(text))]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=2):
    n, lab = len(fps), list(range(len(fps)))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and lab[i] != lab[j]:
                a, b = sorted((lab[i], lab[j]))
                lab = [a if x == b else x for x in lab]
    low = {}
    for x, i in zip(lab, ids):
        if i is not None and (x not in low or i < low[x]):
            low[x] = i
    return [low.get(x) for x in lab]


def brute_hits(text, items):
    """Whether a document is contaminated."""
    tokens = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    w, hit = tokens(text), set()
    for _, item in items:
        v = tokens(item)
        n = min(13, len(v))
        windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
        for a in range(len(w) - n + 1):
            if n and tuple(w[a : a + n]) in windows:
                hit.update(range(a, a + n))
    return bool(hit) and 20 * len(hit) >= len(w)
