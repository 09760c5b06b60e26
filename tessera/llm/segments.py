"""Texts cut into segments and encoded by distinct segment, in Arrow and numpy passes.

A text is cut where its tokenizer starts a new unit whatever stands around, so segments may be encoded
each on its own. The segments of a batch are numbered by Arrow's dictionary encoding; only distinct
ones that a bounded memo does not hold reach the encoder, and no Python step is taken for each word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Most segments in one generation of a memo, and the longest ones kept in it (bytes).
MEMO_SEGMENTS, MEMO_LENGTH = 600_000, 40
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BLANK = _WHITE | np.isin(np.arange(256), [28, 29, 30, 31])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalpha()])
#: White characters beyond ASCII, as UTF-8.
_WIDE_WHITE = [int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _wide_white(raw: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """Whether the bytes from ``at + first`` on, two or three of them, are a white character beyond ASCII (``first`` 0), or those that end in front of ``at`` (``first`` -1)."""
    step = lambda k: raw[np.clip(at + k, 0, len(raw) - 1)].astype("i4")
    two, three = ((-2, -1), (-3, -2, -1)) if first < 0 else ((0, 1), (0, 1, 2))
    return np.isin(step(two[0]) << 8 | step(two[1]), _WIDE_WHITE) | np.isin(step(three[0]) << 16 | step(three[1]) << 8 | step(three[2]), _WIDE_WHITE)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and where each text starts (and the last one ends)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    at = np.frombuffer(offsets, "i8" if wide else "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    raw = np.frombuffer(data, "u1")[at[0] : at[-1]] if data is not None else np.zeros(0, "u1")
    return raw, at - at[0]


def unit_starts(raw: np.ndarray, texts: np.ndarray, inner: bool = True) -> np.ndarray:
    """Where segments start in ``raw`` (and its end), for tokenizers that first split a text into words
    with the blank before them, runs of digits, of other characters, and white runs.

    Cuts: the front of a white run inside a text, behind a line end that is all of such a run, and with
    ``inner`` between an ASCII letter and an ASCII character that is neither letter nor white. A white
    run that another kind of blank stands before goes with what is before it.
    """
    n = len(raw)
    starts = np.zeros(n + 1, bool)
    if n > 1:
        blank = _BLANK[raw]
        starts[1:n] = _WHITE[raw[1:]] & ~blank[:-1]
        starts[texts] = False
        at = np.flatnonzero(starts)
        at = at[raw[at - 1] > 127]
        starts[at[_wide_white(raw, at, -1)]] = False
        after = np.flatnonzero((raw[:-1] == 10) & starts[: n - 1] & ~blank[1:]) + 1
        after = after[(raw[after] < 128) | ~_wide_white(raw, after, 0)]
        starts[after] = True
        if inner:
            starts[1:n] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
    starts[texts] = True
    return np.flatnonzero(starts)


def array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes between ``starts`` as an Arrow column, without a copy of the bytes."""
    wide = len(raw) >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype("i8" if wide else "i4")), pa.py_buffer(raw)])


class Memo:
    """What ``encode`` gives for segments (bytes for bytes), two bounded generations of it."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        self.encode, self.young, self.old = encode, {}, {}

    def __call__(self, segments: list[bytes]) -> list[bytes]:
        """For each of the distinct ``segments`` its encoding."""
        known, old = self.young, self.old
        out = [known.get(s) for s in segments]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = old.get(segments[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, self.encode([segments[i] for i in new]), strict=True):
            out[i] = ids
        if len(known) + len(missing) > MEMO_SEGMENTS:
            self.old, self.young = known, {}
        self.young.update((s, out[i]) for i in missing[:MEMO_SEGMENTS] if len(s := segments[i]) <= MEMO_LENGTH)
        return out

    def column(self, segments: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The encodings of the distinct segments, and for each segment the number of its own."""
        d = segments.dictionary_encode()
        return pa.array(self(d.dictionary.to_pylist()), segments.type), d.indices


def joined(codes: pa.Array, numbers: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The codes named by ``numbers`` one behind the other, and where each of them starts (and the last one ends)."""
    wide = codes.type
    if codes.type == pa.binary() and len(numbers):
        lengths = np.diff(np.frombuffer(codes.buffers()[1], "i4")[: len(codes) + 1]).astype("i8")
        if int(lengths[np.asarray(numbers)].sum()) >= 1 << 31:
            wide = pa.large_binary()
    taken = codes.cast(wide).take(numbers)
    if not len(taken):
        return pa.py_buffer(b""), np.zeros(1, "i8")
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, "i8" if wide == pa.large_binary() else "i4")[: len(taken) + 1].astype("i8")
    return data if data is not None else pa.py_buffer(b""), at
