"""Edit-aware token counts (operator 6).

A text is cut into segments where the tokenizer always starts a new pre-token: in front of white
runs and behind single line ends. Each document keeps a tree over its segments with the
characters and tokens of every subtree. An edit finds the segments it touches by descending the
tree, takes two more on either side as context (a cut depends on the characters next to it), cuts
and encodes only that region anew, and updates the sums above it. Everything else keeps its counts.

``build`` makes the trees' leaves as two columns, ``apply`` brings them up to date with a list of
edits; both columns may be stored and edited again later. Edits of a row apply in order, each to
the text as the ones before left it: (at, remove, insert) in code points, clamped to the text.

Results for odd inputs: null and empty texts have no segments; null edits leave a row as it is, null
fields count as 0 or ''; the literal of an added token is that token (it has no white characters, so it lies in one segment); segments may be as long as the text; repeated rows get equal counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, map_texts, pieces
from .segments import array, flat, unit_starts
from .token_files import default_model, encoder

BLOCK, CONTEXT = 64, 2
EDITS = "array<struct<at:int,remove:int,insert:string>>"
_CUT = re.compile(r"(?<=\S)[\t-\r ]")


def cuts(text: str, low: int = 0, high: int | None = None) -> list[int]:
    """Places in ``text`` from ``low`` to ``high`` where a segment starts (as ``unit_starts`` finds them in bytes)."""
    high = len(text) if high is None else high
    out = [low] if high > low else []
    for m in _CUT.finditer(text, max(0, low - 2), high):
        lone = text[m.start()] == "\n" and m.end() < len(text) and not text[m.end()].isspace()
        out += [at for at in ((m.start(), m.end()) if lone else (m.start(),)) if low < at < high]
    return out


def segments(text: str) -> list[str]:
    at = cuts(text)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


class Counter:
    """Tokens of segments, by the memo of the model's encoder."""

    def __init__(self, model: str):
        self.encoder = encoder(model)
        self.size = np.dtype(self.encoder.type).itemsize

    def counts(self, parts: list[str]) -> list[int]:
        return [len(ids) // self.size for ids in self.encoder.memo([p.encode() for p in parts])]

    def leaves(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Characters and tokens of the segments of each text (no nulls)."""
        raw, at = flat(texts)
        starts = unit_starts(raw, at, inner=False)
        codes, numbers = self.encoder.memo.column(array(raw, starts))
        tokens = np.asarray(pc.binary_length(codes)) // self.size
        first = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][starts]  # characters before each segment
        bounds = pa.array(np.searchsorted(starts, at), pa.int32())
        return tuple(pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (np.diff(first), tokens[np.asarray(numbers)]))


def counter(model: str) -> Counter:
    return Counter(model)


class Tree:
    """Sums of characters and tokens over blocks of segments; a block holds its segments' sizes and counts."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self._fill(np.asarray(sizes, "i8"), np.asarray(counts, "i8"))

    def _fill(self, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [(sizes, counts)]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), "i8")
        starts = np.arange(0, len(sizes), BLOCK)
        if len(sizes):
            self.sums[self.width : self.width + len(self.blocks)] = np.c_[np.add.reduceat(sizes, starts), np.add.reduceat(counts, starts)]
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([s for s, _ in self.blocks]), np.concatenate([c for _, c in self.blocks])

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it, and first character of the segment that holds character ``at`` (the last one, if past the end)."""
        at = min(at, self.chars - 1)
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        block = node - self.width
        ends = np.cumsum(self.blocks[block][0])
        k = int(np.searchsorted(ends, at - start, "right"))
        return block, k, start + (int(ends[k - 1]) if k else 0)

    def replace(self, first: tuple[int, int], last: tuple[int, int], sizes: list[int], counts: list[int]) -> None:
        """New segments in place of those from ``first`` to ``last`` (block, place), and the sums above them."""
        (b0, k0), (b1, k1) = first, last
        head, tail = self.blocks[b0], self.blocks[b1]
        self.blocks[b0] = tuple(np.r_[h[:k0], np.array(new, "i8"), t[k1 + 1 :]] for h, new, t in zip(head, (sizes, counts), tail))
        none = np.zeros(0, "i8")
        for b in range(b0 + 1, b1 + 1):
            self.blocks[b] = (none, none)
        if len(self.blocks[b0][0]) > 4 * BLOCK:
            self._fill(*self.leaves())
            return
        nodes = range(b0, b1 + 1)
        for b in nodes:
            self.sums[self.width + b] = [int(x.sum()) for x in self.blocks[b]]
        level = sorted({self.width + b for b in nodes})
        while level and level[0] > 1:
            level = sorted({n // 2 for n in level})
            for n in level:
                self.sums[n] = self.sums[2 * n] + self.sums[2 * n + 1]


def edit(text: str, tree: Tree, at: int, remove: int, insert: str, count) -> tuple[str, int]:
    """The edited text, its tree brought up to date; and how many characters were encoded anew. ``count`` gives the tokens of segments."""
    a = min(max(at, 0), len(text))
    b = min(a + max(remove, 0), len(text))
    new = text[:a] + insert + text[b:]
    if not text:
        parts = segments(new)
        tree._fill(np.array([len(p) for p in parts], "i8"), np.array(count(parts), "i8"))
        return new, len(new)
    low = high = None
    for side, place in ((-1, a), (1, max(a, b - 1))):
        block, k, start = tree.find(place)
        end = start + int(tree.blocks[block][0][k])
        for _ in range(CONTEXT):
            if (start == 0) if side < 0 else (end == len(text)):
                break
            block, k, start = tree.find(start - 1 if side < 0 else end)
            end = start + int(tree.blocks[block][0][k])
        if side < 0:
            first, low = (block, k), start
        else:
            last, high = (block, k), end
    stop = high + len(insert) - (b - a)
    places = cuts(new, low, stop)
    parts = [new[x:y] for x, y in zip(places, [*places[1:], stop])]
    tree.replace(first, last, [len(p) for p in parts], count(parts))
    return new, stop - low


def build(df: DataFrame, text: str = "text", sizes: str = "sizes", counts: str = "counts", model: str | None = None) -> DataFrame:
    """``df`` with the leaves of each text's tree: characters and tokens of its segments. Names that ``df`` has get underscores; ``apply`` takes the newest."""
    path, sizes, counts = model or default_model(), free_name(df, sizes), free_name(df, counts)

    def setup():
        return counter(path).leaves

    return map_texts(df, text, [(sizes, "array<int>"), (counts, "array<int>")], setup, arrow_text=True)


def _newest(df: DataFrame, name: str) -> str:
    """The column ``name`` with the most underscores behind it."""
    return max((c for c in df.columns if c.lower().rstrip("_") == name.lower().rstrip("_")), key=len)


def apply(df: DataFrame, edits: str = "edits", text: str = "text", sizes: str = "sizes", counts: str = "counts", key: str = "doc_id", state: bool = True, model: str | None = None) -> DataFrame:
    """Edits applied: ``key``, n_before, n_after, n_chars, n_encoded (characters encoded anew), and with ``state`` the new text, sizes and counts."""
    path, sizes, counts = model or default_model(), _newest(df, sizes), _newest(df, counts)
    names = ["n_before", "n_after", "n_chars", "n_encoded"]
    schema = f"key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + (", text string, sizes array<int>, counts array<int>" if state else "")
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            for piece, texts in pieces(batch, 1):
                rows, states = [], []
                leaves = [[np.asarray(x.values) if x.is_valid else np.zeros(0, "i4") for x in piece.column(i)] for i in (3, 4)]
                for t, s, c, own in zip(texts, *leaves, piece.column(2).to_pylist(), strict=True):
                    before, encoded = int(c.sum()), 0
                    tree = Tree(s, c)
                    for e in own or []:
                        t, n = edit(t, tree, e["at"] or 0, e["remove"] or 0, e["insert"] or "", count)
                        encoded += n
                    rows.append((before, tree.tokens, len(t), encoded))
                    if state:
                        states.append((t, *(x.astype("i4") for x in tree.leaves())))
                cols = [piece.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                if state:
                    cols += [pa.array([x[0] for x in states], pa.string()), *(pa.array([x[i] for x in states], ints) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", *names, *(["text", "sizes", "counts"] if state else [])])

    return df.select(key, text, F.col(edits).cast(EDITS), sizes, counts).mapInArrow(run, schema).withColumnRenamed("key", key)


def sample_edits(text) -> F.Column:
    """A fixed script for any text: a cut at a quarter, an insertion at half, a replacement at three quarters."""
    n = F.length(text)
    one = lambda at, remove, insert: F.struct(F.floor(n * at).cast("int").alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    return F.array(one(0.25, 12, ""), one(0.5, 0, " [edited\nhere] "), one(0.75, 7, "REDACTED"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    built = build(docs.withColumn("edits", sample_edits(F.col("text"))))
    return apply(built, state=False)
