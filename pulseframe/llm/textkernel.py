"""Whole texts as flat numpy arrays, for use inside Arrow batches.

A chunk holds some thousands of texts end to end as code points, so that classes, words and hashes of all of
them are computed by a few array passes. Chunks are bounded by characters. A text that is longer than
``LONG_TEXT`` is a chunk of its own and is read in parts, cut at single spaces, so that only what is kept of it
(word hashes, counts) and not its code points is held as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 400_000
CHUNK_ROWS = 2_048
#: Code points of a text that is read in parts, and of a part at most, unless it has no single space.
LONG_TEXT = 1_000_000

#: Of the multiplicative hashing; any odd numbers with well spread bits do.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SINGLE_SPACE = re.compile(r"\S \S")


@cache
def is_white() -> np.ndarray:
    """By code point: the six characters of [\\x20\\x09-\\x0D]."""
    out = np.zeros(0x110000, bool)
    out[[0x20, *range(9, 14)]] = True
    return out


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def lowered() -> np.ndarray:
    """By code point: its lower case if that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


@cache
def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def long_parts(text: str, size: int | None = None) -> Iterator[str]:
    """``text`` in parts of at most ``size``, each but the first starting with a space between two characters that are none.

    Where there is no such space within ``size`` the next one is taken.
    """
    size, begin = size or LONG_TEXT, 0
    while len(text) - begin > size:
        at = begin + size
        while at > begin and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace()):
            at = text.rfind(" ", begin, at)
        if at <= begin:
            found = SINGLE_SPACE.search(text, begin + size)
            if not found:
                break
            at = found.start() + 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


class Chunk:
    """Texts of some rows: ``points`` (code points end to end) and ``bounds`` (n + 1 offsets into them).

    The points of a long text are only in the chunks of its ``parts``, all of which belong to row 0.
    """

    def __init__(self, texts: list[str], rows: pa.RecordBatch | None):
        self.rows, self.n = rows, len(texts)
        self.long = texts[0] if self.n == 1 and rows is not None and len(texts[0]) > LONG_TEXT else None
        if self.long is None:
            self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, self.n))])

    def parts(self) -> Iterator[Chunk]:
        if self.long is None:
            yield self
        else:
            for part in long_parts(self.long):
                yield Chunk([part], None)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row numbers of the maximal runs where ``inside`` holds, none crossing a row's end."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = self.bounds[1:-1]
        cuts = cuts[cuts < len(inside)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1


def hash_runs(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points; depends on nothing but these."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        terms = mix64(points[place + np.repeat(starts, size)] + np.uint64(1)) * powers(1 << int(max(size.max(), 64) - 1).bit_length())[place]
        return mix64(np.add.reduceat(terms, at) + size.astype(np.uint64) * GOLDEN)


def cuts(texts: pa.Array, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_rows`` rows that end once ``most_bytes`` are reached; a text of more bytes is alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, large = np.cumsum(size), np.append(np.flatnonzero(size > most_bytes), len(texts))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        first_large = large[np.searchsorted(large, begin)]
        end = min(int(np.searchsorted(ends, before + most_bytes)) + 1, begin + most_rows, max(int(first_large), begin + 1))
        yield begin, end
        begin = end


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[Chunk]:
    """Split Arrow batches into chunks of at most ``CHUNK_ROWS`` rows and about ``CHUNK_BYTES``; null is empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for begin, end in cuts(batch.column(at), CHUNK_BYTES, CHUNK_ROWS):
            rows = batch.slice(begin, end - begin)
            yield Chunk([x or "" for x in rows.column(at).to_pylist()], rows)


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the n + 1 word offsets of the rows.

    Words are the runs of characters outside [\\x20\\x09-\\x0D] after lower-casing A-Z.
    """
    found, counts = [], np.zeros(chunk.n, np.int64)
    for part in chunk.parts():
        points = np.where((part.points >= 65) & (part.points <= 90), part.points + np.uint32(32), part.points)
        starts, ends, row = part.runs(~is_white()[points])
        found.append(hash_runs(points, starts, ends))
        counts += np.bincount(row, minlength=part.n)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


def word_shingles(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct ``words``-word shingles of each row, sorted within the row, and row bounds.

    A text of fewer words is one shingle; a text without words has none.
    """
    hashes, at = word_hashes(chunk)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            joined *= STEP
            joined += hashes[k : k + len(joined)]
        joined = mix64(joined)
        out, sizes = [], np.zeros(chunk.n, np.int64)
        for i in np.flatnonzero(np.diff(at)):
            a, b = at[i], at[i + 1]
            if b - a >= words:
                own = np.sort(joined[a : b - words + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                own = np.zeros(1, np.uint64)
                for k in range(a, b):
                    own = own * STEP + hashes[k]
                own = mix64(own + np.uint64(b - a) * GOLDEN)
            out.append(own)
            sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
