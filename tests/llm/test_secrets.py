import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import automata as au
from tessera.llm import secrets as se

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL", "é", "\n", ",", "漢", "a" * 40, "."]


def brute(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32]
    return [(s, se.BASE[k], e) for s, k, e in sorted(found)]


def test_base_rules_equal_regex():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["f" * 100_000]
    for got, t in zip(se.Scanner().scan(texts), texts):
        assert [s for s in got if s[1] in se.BASE] == brute(t)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[^a-c]x{2,3}", "(ab|a)(c?)d+", "a{2}b{1,}", "\\x41\\.[\\x2da]?"])
def test_automata_equal_regex(pattern):
    rng = random.Random(2)
    forth, back = (au.Automaton([t], False) for t in (au.parse(pattern), au.backwards(au.parse(pattern))))
    plain = re.compile(pattern.encode())
    for _ in range(400):
        text = bytes(rng.choice(b"abcdxA.-") for _ in range(rng.randint(0, 12)))
        ends = [e for e in range(len(text) + 1) if plain.fullmatch(text, 0, e)]
        assert forth.longest(text, 0) == max(ends, default=-1) or ends == [0]
        starts = [s for s in range(len(text) + 1) if plain.fullmatch(text, s)]
        assert back.longest(text, len(text), -1) == min(starts, default=-1) or starts == [len(text)]


def test_strips_see_what_one_pass_sees():
    a = au.Automaton([au.parse("ab{3}c"), au.parse("[0-9]{5}")], True)
    rng = np.random.default_rng(3)
    text = rng.choice(np.frombuffer(b"abbbbc0123\n", "u1"), 20_000)
    one, many = a.scan(text, lanes=1), a.scan(text, lanes=500)
    assert len(one[0]) > 10 and all((x == y).all() for x, y in zip(one, many))
    assert a.next.shape[0] < 40


def test_long_text_without_line_ends():
    import time

    scanner = se.Scanner()
    unit = "words and more words " * 5000 + 'api_key = "abcdefgh12345678" é ' + "0" * 40 + "x" * 70_000
    text = unit * 60
    began = time.time()
    (spans,) = scanner.scan([text])
    assert len(text) > 10_000_000 and time.time() - began < 60
    assert [s for s in spans if s[1] in se.BASE] == brute(text)
    state = np.random.default_rng(5).choice(np.frombuffer(b"pasword= token0f", "u1"), 50_000)
    for lanes, most in ((1, 1 << 24), (37, 1000), (4096, 777)):
        got = scanner.all.scan(state, lanes, most)
        assert all((x == y).all() for x, y in zip(got, scanner.all.scan(state, 500)))


def test_digests_and_other_formats(spark):
    key = "ghp_" + "aB3" * 12
    texts = [None, "", "é " + key, 'x password: "hunter2hunter2" ' + "-----BEGIN EC PRIVATE KEY-----", "token=short", "漢" * 1000 + " AKIA" + "B" * 12]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s")], "doc_id long, text string, SPANS string")
    rows = se.digests(df).collect()
    assert len(rows) == 7
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        base = brute(t or "")
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in se.BASE] == [sum(x[1] == k for x in base) for k in se.BASE]
    assert got[2].spans == f"github:2:{2 + len(key)}" and "private_key" in got[3].spans
    clean = {r.doc_id: r.text for r in se.redact(df).collect()}
    assert clean[2] == "é ***" and clean[4] == texts[4] and clean[0] is None
    assert se.digests(df.where("false")).collect() == []
