"""Dictionary terms in texts, whatever the size of the dictionary: an index of term fronts on the shared folder.

A term is known by its front, its first 8, 4, 2 or 1 characters, whichever it has. Tasks write the dictionary as index
files of about ``FILE_TERMS`` rows, by front, so one front is in one file, and in the order of the hashes of the fronts. A
worker maps a file read-only and keeps it for later tasks; rows and hashes stay in the file, beside a bitmap of 4 to 8 bytes
a row. It hashes the windows of all characters of a batch in array
passes, drops those no front can have by a bitmap, looks the rest up, and compares characters with the
terms of that front. So no row is made for a character, nothing is gathered or broadcast, and the
index of a worker has a bounded size; a dictionary of several files is met file by file.

Occurrences are those of each term, left to right, without overlap with itself.
"""

from __future__ import annotations

import bisect
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRONTS = (8, 4, 2, 1)
#: Rows of an index file, on average, and files that a worker keeps.
FILE_TERMS, KEPT = 2_000_000, 4
#: Rows that are worked on at once when an index is written or loaded.
ROWS = 50_000
#: Characters of text that are searched at once.
CHARS = 1_000_000
_FACTORS = {2: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 8: 0x165667B19E3779F9}
_loaded: OrderedDict[str, Terms] = OrderedDict()


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def fronts(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each width of a front the hash of the characters from each place on; windows that reach beyond the end are left out."""
    h, out = codes.astype("u8"), {}
    out[1] = h
    for width in (2, 4, 8):
        half = width // 2
        h = h[: max(0, len(h) - half)] * np.uint64(_FACTORS[width]) + h[half:]
        h ^= h >> np.uint64(29)
        out[width] = h
    return out


def front_width(length: np.ndarray) -> np.ndarray:
    return np.select([length >= 8, length >= 4, length >= 2], [8, 4, 2], 1)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a column of strings without nulls, and where each string starts (and the last one ends)."""
    at = np.r_[0, np.cumsum(np.asarray(pc.utf8_length(column), "i8"))]
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    edges = np.frombuffer(offsets, "i8")[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, "i8")
    raw = memoryview(data)[edges[0] : edges[-1]] if data is not None and len(wide) else b""
    return np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4"), at


def front_keys(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(width, hash) of the fronts of terms, none of them empty; ``ROWS`` at a time."""
    width, keys = np.zeros(len(terms), "u1"), np.zeros(len(terms), "u8")
    for low in range(0, len(terms), ROWS):
        codes, at = _codes(terms.slice(low, ROWS))
        own = width[low : low + ROWS] = front_width(np.diff(at))
        for w, h in fronts(codes).items():
            keys[low + np.flatnonzero(own == w)] = h[at[:-1][own == w]]
    return width, keys


class Terms:
    """One index file: rows (term, type, width, key) by width and key of their fronts. They stay in the mapped file; only a bitmap of a few bits a row is made for each width."""

    def __init__(self, path: str):
        system, where = _system(path)
        source = pa.memory_map(where) if system.type_name == "local" else system.open_input_file(where)
        t = pa.ipc.open_file(source).get_batch(0)  # written as one batch, so nothing is copied
        self.term, self.type = t.column(0), t.column(1)
        width, keys = (t.column(i).to_numpy(zero_copy_only=True) for i in (2, 3))
        self.by_width = {}
        for w in FRONTS:
            low, high = np.searchsorted(width, w, "left"), np.searchsorted(width, w, "right")
            if high > low:
                own = keys[low:high]
                shift = np.uint64(64 - max(10, min(30, int(len(own)).bit_length() + 5)))
                bitmap = np.zeros(1 << int(np.uint64(61) - shift), "u1")
                for i in range(0, len(own), ROWS):
                    bit = own[i : i + ROWS] * np.uint64(_FACTORS[2]) >> shift
                    np.bitwise_or.at(bitmap, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype("u1"))
                self.by_width[w] = (int(low), own, bitmap, shift)

    def occurrences(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, row, start, size) of all occurrences in texts of the characters ``codes``, which start at ``at``; sorted by text, row and start."""
        found = []
        hashes = fronts(codes)
        for w, (first, keys, bitmap, shift) in self.by_width.items():
            h = hashes.pop(w)
            bit = h * np.uint64(_FACTORS[2])
            bit >>= shift
            maybe = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype("u1") & np.uint8(1))
            del bit
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            some = high > low
            maybe, low, n = maybe[some], low[some], (high - low)[some]
            place = np.repeat(maybe, n)
            row = first + np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, which = np.unique(row, return_inverse=True)
            letters, begin = _codes(self.term.take(pa.array(own)))  # of the terms met here alone
            size = np.diff(begin)[which]
            text = np.searchsorted(at, place, "right") - 1
            fits = place + size <= at[text + 1]
            place, row, size, begin = place[fits], row[fits], size[fits], begin[which[fits]]
            k, left = 0, np.arange(len(place))
            good = np.ones(len(place), bool)
            while len(left):  # a character at a time, of those that agree so far
                good[left[codes[place[left] + k] != letters[begin[left] + k]]] = False
                k += 1
                left = left[good[left] & (size[left] > k)]
            found.append((place[good], row[good], size[good]))
        place, row, size = (np.concatenate([np.zeros(0, "i8"), *x]) for x in (zip(*found) if found else ((), (), ())))
        text = np.searchsorted(at, place, "right") - 1
        order = np.lexsort((place, row, text))
        place, row, size, text = place[order], row[order], size[order], text[order]
        start = place - at[text]
        keep = self._apart(text, row, start, size)
        return text[keep], row[keep], start[keep], size[keep]

    @staticmethod
    def _apart(text: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which ones overlap none of the same term before them that stands."""
        same = np.r_[False, (text[1:] == text[:-1]) & (row[1:] == row[:-1])] if len(text) else np.zeros(0, bool)
        close = same & np.r_[False, start[1:] < start[:-1] + size[:-1]] if len(text) else same
        keep = np.ones(len(text), bool)
        free = 0
        begun = -1
        for i in np.flatnonzero(close | np.r_[close[1:], False]).tolist() if len(text) else ():
            if not (close[i] and begun == i - 1):
                free = 0
            begun = i
            keep[i] = start[i] >= free
            if keep[i]:
                free = int(start[i] + size[i])
        return keep


def load(path: str) -> Terms:
    if path not in _loaded:
        while len(_loaded) >= KEPT:
            _loaded.popitem(last=False)
        _loaded[path] = Terms(path)
    _loaded.move_to_end(path)
    return _loaded[path]


def write_index(dictionary: DataFrame, path: str, file_terms: int = FILE_TERMS) -> list[str]:
    """Index files of the distinct (term, type) of ``dictionary`` below the shared folder ``path``; empty terms and nulls say nothing. Their names, one for each ``file_terms`` rows."""
    dictionary.where("term <> ''").select("term", "type").distinct().write.parquet(f"{path}/rows")
    rows = dictionary.sparkSession.read.schema("term string, type string").parquet(f"{path}/rows")
    files = max(1, -(-rows.count() // file_terms))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            term, kind = (t.column(i).combine_chunks() for i in (0, 1))
            width, keys = front_keys(term)
            order = np.lexsort((keys, width))
            at_rows = pa.array(order)
            cols = [term.take(at_rows), kind.take(at_rows), pa.array(width[order]), pa.array(keys[order])]
            rows_ = pa.RecordBatch.from_arrays(cols, names=["term", "type", "width", "key"])
            name = f"{path}/terms-{uuid.uuid4().hex}.arrow"
            fs_, at = _system(name)
            with fs_.open_output_stream(at) as out, pa.ipc.new_file(out, rows_.schema) as f:
                f.write_batch(rows_)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    dealt = rows.repartition(files, F.left("term", F.lit(FRONTS[0])))
    return sorted(r.file for r in dealt.mapInArrow(write, "file string").collect())  # a row a file


def longest_first(text: np.ndarray, start: np.ndarray, end: np.ndarray, names: pa.Array, types: pa.Array) -> np.ndarray:
    """Places of the mentions that stand if longer ones claim their characters first, then by term, place and type. Mentions that overlap no other stand; of runs that overlap, one after the other is tried."""
    order = np.lexsort((end, start, text))
    t, a, b = text[order], start[order], end[order]
    wide = t * (int(b.max()) + 1 if len(b) else 1)  # places of all texts in one line
    reach = np.maximum.accumulate(wide + b) if len(b) else b
    fresh = np.r_[True, wide[1:] + a[1:] >= reach[:-1]] if len(b) else np.zeros(0, bool)
    lone = fresh & np.r_[fresh[1:], True] if len(b) else fresh
    stands = lone.copy()
    heads = np.flatnonzero(fresh & ~lone)
    ends = np.r_[np.flatnonzero(fresh), len(fresh)]
    for h in heads.tolist():
        own = range(h, int(ends[np.searchsorted(ends, h, "right")]))
        taken: list[tuple[int, int]] = []
        for i in sorted(own, key=lambda i: (a[i] - b[i], names[order[i]].as_py(), a[i], types[order[i]].as_py() or "")):
            k = bisect.bisect(taken, (a[i], b[i]))
            if (k == 0 or taken[k - 1][1] <= a[i]) and (k == len(taken) or taken[k][0] >= b[i]):
                taken.insert(k, (a[i], b[i]))
                stands[i] = True
    return np.sort(order[stands])


def find(texts: DataFrame, files: list[str], key: str, text: str, once: bool = False, resolved: bool = False) -> DataFrame:
    """(key, term, type, start, end) of the occurrences in each row of ``texts``, in characters; with ``once`` (key, term, type), once for each row; ``resolved``: of overlapping ones those that stand (``longest_first``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("term", T.StringType()), T.StructField("type", T.StringType())]
    fields += [] if once else [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    rows = texts.select(key, text)
    out = T.StructType([rows.schema.fields[0], *fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                codes, at = _codes(pc.fill_null(piece.column(1), ""))
                found = [_found(load(file), codes, at, once) for file in files]
                if resolved:
                    found = [tuple(pa.concat_arrays([f[i] for f in found]) if i < 2 else np.concatenate([f[i] for f in found]) for i in range(5))] if found else []
                    found = [tuple(c.take(pa.array(k)) if isinstance(c, pa.Array) else c[k] for c in f) for f in found for k in [longest_first(f[2], f[3], f[4], f[0], f[1])]]
                for term, kind, row_of, start, end in found:
                    for i in range(0, len(term), 20_000):
                        some = slice(i, i + 20_000)
                        cols = [piece.column(0).take(pa.array(row_of[some])), term[some], kind[some]]
                        cols += [] if once else [pa.array(start[some], pa.int32()), pa.array(end[some], pa.int32())]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out)


def _found(terms: Terms, codes: np.ndarray, at: np.ndarray, once: bool) -> tuple:
    """(term, type, text, start, end) of the occurrences of one index file."""
    text, row, start, size = terms.occurrences(codes, at)
    if once and len(row):
        first = np.r_[True, (text[1:] != text[:-1]) | (row[1:] != row[:-1])]
        text, row, start, size = text[first], row[first], start[first], size[first]
    rows = pa.array(row)
    return terms.term.take(rows), terms.type.take(rows), text, start, start + size


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``CHARS`` characters, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0), "i8")
    low = 0
    while low < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[low:]), CHARS, "right")))
        yield batch.slice(low, n)
        low += n
