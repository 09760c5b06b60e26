"""SentencePiece encoding and decoding (operator 10).

Encoding fills a table over the prefixes of a string. A prefix of a BPE-encoded string has exactly
one last token: the vocabulary entry that ends there and whose neighbour, the last token of the
prefix in front of it, is a *compatible pair* (the two stay apart when the merges run over their
concatenation). An automaton gives all entries that end at a position, the pair test picks the one
that counts, and the ids are then recovered backwards from the end of the table.

No entry of the vocabulary has a word mark after another character, so nothing merges across the
front of a word mark; strings are cut there and the table is kept per word. Words seen before in a
worker come from a bounded memo.

Results for odd inputs: null and empty texts have no ids and decode to ''; a literal U+2581 counts
as a space (as in the library); characters without an entry become byte tokens; words of any length
take the same path, only the memo skips long ones. Rows are kept as they are, repeated or not.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, map_texts

MARK = "▁"
MEMO_WORDS, MEMO_PAIRS, MEMO_LENGTH = 250_000, 1_000_000, 40
_codecs: dict[str, Codec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Tables of one model and the memos of one worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte: dict[int, int] = {}
        self.find = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                self.raw.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self.steps: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.number: dict[str, int] = {}
        for piece, i in self.ids.items():
            parts, *steps = self.merge(piece)
            if parts == [piece]:  # else no text is ever encoded with it
                self.steps[piece] = tuple(steps)
                self.find.add_word(piece, (i, len(piece)))
        self.find.make_automaton()
        self.single = {p for p in self.steps if len(p) == 1}
        self.piece = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("this model merges across word marks or line ends")

    def merge(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The merges run plainly over one entry: best rank first, leftmost of equals.

        Returns the parts left, the rank of each merge in turn, and the rightmost and leftmost
        part before each merge and at the end.
        """
        parts, ranks = list(text), []
        rights, lefts = [parts[-1]], [parts[0]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts, ranks, rights, lefts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best)
            rights.append(parts[-1])
            lefts.append(parts[0])

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge joins the two when they stand side by side.

        Both sides merge on their own, in turns by rank, until a merge of the two parts that touch
        would come first: of equal ranks the leftmost, so before those of the right side only.
        """
        a, rights, _ = self.steps.get(left) or ([], [left], [left])
        b, _, lefts = self.steps.get(right) or ([], [right], [right])
        i = j = 0
        while True:
            x = a[i] if i < len(a) else float("inf")
            y = b[j] if j < len(b) else float("inf")
            across = self.rank.get(rights[i] + lefts[j])
            if across is not None and across < x and across <= y:
                return False
            if i == len(a) and j == len(b):
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def last_tokens(self, word: str) -> list[int]:
        """For each prefix of ``word`` its last token: an id, or -1 minus the code of a character without one."""
        n = len(word)
        last: list = [None] * (n + 1)
        pairs, piece = self.pairs, self.piece
        if not self.single.issuperset(word):
            return self._last_tokens_unknown(word)
        for end, (right, length) in self.find.iter(word):
            end += 1
            if last[end] is None:
                start = end - length
                if start:
                    left = last[start]
                    key = left << 20 | right
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= MEMO_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(piece[left], piece[right])
                    if fits:
                        last[end] = right
                else:
                    last[end] = right
        return last

    def _last_tokens_unknown(self, word: str) -> list[int]:
        """The same for words with characters that have no entry; each of these stands for a token of its own."""
        found: list[list[tuple[int, int]]] = [[] for _ in word]
        for end, match in self.find.iter(word):
            found[end].append(match)
        name = lambda t: chr(-1 - t) if t < 0 else self.piece[t]
        last: list = [None] * (len(word) + 1)
        for i, matches in enumerate(found):
            for right, length in matches if word[i] in self.single else [*matches, (-1 - ord(word[i]), 1)]:
                start = i + 1 - length
                if start == 0 or self.compatible(name(last[start]), name(right)):
                    last[i + 1] = right
                    break
        return last

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian int32 bytes: the prefix table read from its end."""
        last, ids, i = self.last_tokens(word), [], len(word)
        while i:
            token = last[i]
            if token < 0:
                ids += [self.byte[b] for b in reversed(chr(-1 - token).encode())]
                i -= 1
            else:
                ids.append(token)
                i -= len(self.piece[token])
        return np.array(ids[::-1], "<i4").tobytes()

    def remembered(self, word: str) -> bytes:
        """``word`` by way of the memo: two generations, so that frequent words outlive a full one."""
        ids = self.old.get(word)
        if ids is None:
            ids = self.word(word) if word else b""
        if len(word) <= MEMO_LENGTH:
            if len(self.young) >= MEMO_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if text[0] == " " or "  " in text or MARK in text or "\0" in text:
            text = text.replace(" ", MARK)
            words = [w for line in re.split("(\n)", MARK + text) for w in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)]
        else:
            words = (MARK + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).split("\0")
        out, memo = [], self.young
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self.remembered(w)
                memo = self.young
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    """One codec a worker and model."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text, array<int>, as the library's ``encode`` gives them; a name that ``df`` has gets underscores."""
    path, ids = model or default_model(), free_name(df, ids)

    def setup():
        c = codec(path)
        return lambda texts: [[c.encode(t) for t in texts]]

    return map_texts(df, text, [(ids, "array<int>")], setup)


def encode_decode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text and the text decoded from those ids; names that ``df`` has get underscores."""
    path, ids, decoded = model or default_model(), free_name(df, ids), free_name(df, decoded)

    def setup():
        c = codec(path)

        def work(texts):
            all_ids = [c.encode(t) for t in texts]
            return [all_ids, [c.decode(i.tolist()) for i in all_ids]]

        return work

    return map_texts(df, text, [(ids, "array<int>"), (decoded, "string")], setup)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The contract's columns, derived from the ids and the decoded text."""
    out = encode_decode(docs.select("doc_id", "text"), model=model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
