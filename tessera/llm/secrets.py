"""Secret scans by one combined automaton (operator 9).

All rules are compiled together into one minimal automaton whose transition array reads every byte
of a text once. In it, long counted tails are shortened (a rule may only ever be reported too
often), which keeps the array small. Each report says where a rule has been met; its own automata
walk from there, backwards to the leftmost start and forwards to the longest end: leftmost matches
that do not overlap, of each rule by itself. A rule's condition then drops matches; dropped ones
have used up their text all the same.

Of a rule, every match that meets its condition is reported, and no match begins inside another one
that is not reported; so the first report past a match belongs to the leftmost match after it.

Results for odd inputs: null and empty texts have no spans; offsets count code points; texts and
secrets may have any length, with or without line ends; repeated rows get equal spans; ``find`` adds
its column under a name that is free (``free_name``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import Automaton, backwards, parse
from .common import documents, free_name, map_texts


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    report: str  # what the combined automaton looks for: matches whenever the rule does with its condition met
    least: int = 0  # bytes of the whole match
    head: str = ""  # what stands before the value
    value: int = 0  # bytes of the value


_KEY = f"({either_case('password')}|{either_case('passwd')}|{either_case('secret')}|{either_case('token')}|{either_case('api')}_?{either_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=\\x2d]"

#: The base rules, then further formats that providers publish.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"{_KEY}({_VALUE}+)", f"{_KEY}{_VALUE}{{2}}", head=_KEY, value=8),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{2}", least=16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", least=32),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{2}", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\x2d]+", "xox[abprs]-[A-Za-z0-9]", least=15),
    Rule("google", "AIza[A-Za-z0-9_\\x2d]+", "AIza[A-Za-z0-9_\\x2d]{2}", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_\\x2d]+\\.eyJ[A-Za-z0-9_\\x2d]+\\.[A-Za-z0-9_\\x2d]+", "\\.eyJ[A-Za-z0-9_\\x2d]+\\.[A-Za-z0-9_\\x2d]"),
)


def code_points(raw: bytes, places: set[int]) -> dict[int, int]:
    """How many code points stand before each of ``places``."""
    edges = np.array(sorted({0, *places}))
    inside = edges[edges < len(raw)]
    counts = np.add.reduceat(np.frombuffer(raw, "u1") & 0xC0 != 0x80, inside, dtype="i8") if len(inside) else np.zeros(0, "i8")
    return dict(zip(edges.tolist(), np.r_[0, np.cumsum(counts)].tolist(), strict=False))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([parse(r.report) for r in rules], search=True)
        trees = [parse(r.pattern) for r in rules]
        self.own = [(Automaton([backwards(t)], False), Automaton([t], False), Automaton([parse(r.head)], False) if r.head else None) for t, r in zip(trees, rules, strict=True)]

    def matches(self, k: int, text: bytes, hits: np.ndarray) -> list[tuple[int, int]]:
        """All matches (start, end) of rule ``k`` that meet its condition; ``hits``: where the combined automaton reports it, in order."""
        rule, (back, forth, head) = self.rules[k], self.own[k]
        out, at, i = [], 0, 0
        while i < len(hits):
            start = back.longest(text, int(hits[i]), -1, at)
            if start < 0:
                i += 1
                continue
            at = forth.longest(text, start)
            if at - start >= rule.least and (head is None or at - head.longest(text, start) >= rule.value):
                out.append((start, at))
            i = int(np.searchsorted(hits, at, "right"))
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, str, int]]]:
        """The spans (start, kind, end) of each text in code points, by start and then by the order of the rules."""
        raw = [t.encode() for t in texts]
        joined = np.frombuffer(b"\n".join([*raw, b""]), "u1")  # no rule crosses a line end
        ends = np.cumsum([len(r) + 1 for r in raw])
        at, which = self.all.scan(joined)
        ranked: dict[int, list[tuple[int, int, int]]] = {}
        for k in range(len(self.rules)):
            hits = at[which >> k & 1 > 0]
            owner = np.searchsorted(ends, hits, "left")
            for some in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(owner)) + 1) if len(hits) else ():
                doc = int(owner[some[0]])
                found = self.matches(k, raw[doc], hits[some] - (int(ends[doc]) - len(raw[doc]) - 1))
                ranked.setdefault(doc, []).extend((s, k, e) for s, e in found)
        out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
        for doc, spans in ranked.items():
            at = code_points(raw[doc], {x for s, _, e in spans for x in (s, e)})
            out[doc] = [(at[s], self.rules[k].kind, at[e]) for s, k, e in sorted(spans)]
        return out


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find(df: DataFrame, text: str = "text", name: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the spans of each whole text: array of (start, kind, end), code points, end exclusive."""

    def setup():
        scan = scanner(rules).scan
        return lambda texts: [[[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in scan(texts)]]

    return map_texts(df, text, [(free_name(df, name), "array<struct<start:int,kind:string,end:int>>")], setup)


def without(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    """``text`` with ``mark`` in place of each run of overlapping spans, which come by start."""
    out, at, runs = [], 0, []
    for start, _, end in spans:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    for start, end in runs:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", mark: str = "***", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span of its text replaced by ``mark``; overlapping spans count as one. Null stays null."""
    name = free_name(df, "redacted")

    def setup():
        scan = scanner(rules).scan
        return lambda texts: [[without(t, spans, mark) for t, spans in zip(texts, scan(texts), strict=True)]]

    clean = map_texts(df, text, [(name, "string")], setup)
    return clean.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name))).drop(name)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the spans."""
    rows = find(docs.select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
