"""SentencePiece encoding and decoding by a table of distinct chunks.

A text is marked as the model's normaliser does: a marker stands before it and for every space. Where no piece of
the vocabulary has a marker behind another character, no merge crosses the start of a run of markers. So a text
is a row of chunks, each a run of markers and what follows up to the next one, and a chunk's ids don't depend on
its neighbours. Each Arrow batch is cut into chunks by array passes, its distinct chunks are looked up in the
table, only unknown ones go to the library, and the ids are joined back by the chunks' positions. A text's ids are
decoded by the library's decode, which is fast and sees the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import LONG_TEXT, cuts

MARKER = "▁"
#: Chunks that a Python worker remembers, and code points of the longest remembered one.
TABLE_CHUNKS = 200_000
REMEMBERED = 64
BATCH_BYTES = 1_500_000
CUT = re.compile(f"[^ {MARKER}][ {MARKER}]")


class ChunkTable:
    """Little-endian 32-bit ids of distinct chunks.

    Two generations are remembered, so that frequent chunks stay while rare ones go.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in x.lstrip(MARKER) for x in names):
            raise ValueError("pieces of this model cross whitespace markers, so that chunks aren't independent")
        probe = self.model.encode("a  b ")
        if names[self.model.encode("a")[0]][0] != MARKER or self.model.decode(probe) != "a  b ":
            raise ValueError("this model's normaliser doesn't mark every space and the start of a text")
        self.lone = self.model.piece_to_id(MARKER)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The library's ids of each chunk; it adds the first marker itself, but to an empty text."""
        texts = [x[1:] if MARKER not in x[1:] else x[1:].replace(MARKER, " ") for x in chunks]
        return [array("i", x or (self.lone,)).tobytes() for x in self.model.encode(texts, num_threads=1)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.recent.get, chunks))
        new = []
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = self.older.get(chunks[i])
                if x is None:
                    new.append(i)
                else:
                    self.recent[chunks[i]] = x
        if new:
            fresh = [chunks[i] for i in new]
            for i, chunk, x in zip(new, fresh, self.segment(fresh), strict=True):
                out[i] = x
                if len(chunk) <= REMEMBERED:
                    self.recent[chunk] = x
        if len(self.recent) > TABLE_CHUNKS // 2:
            self.recent, self.older = {}, self.recent
        return out


@cache
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def chunk_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks start: at a marker behind another character, and at each text's first character."""
    marker = points == ord(MARKER)
    start = marker.copy()
    start[1:] &= ~marker[:-1]
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(start)


def code(texts: list[str], table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end with their n + 1 bounds."""
    marked = [MARKER + x.replace(" ", MARKER) if x else "" for x in texts]
    joined = "".join(marked)
    if not joined:
        return np.zeros(0, "<i4"), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))])
    starts, encoded = chunk_starts(points, bounds), joined.encode()
    wide = (points > 0x7F).view(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    shift = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    offsets = np.append(starts + shift[starts], len(encoded))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(encoded)]).dictionary_encode()
    found, which = table(words.dictionary.to_pylist()), words.indices.to_numpy()
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begin, each = np.cumsum(size) - size, size[which]
    before = np.concatenate([[0], np.cumsum(each)])
    ids = np.frombuffer(b"".join(found), "<i4")[np.repeat(begin[which] - before[:-1], each) + np.arange(before[-1])]
    return ids, before[np.searchsorted(starts, bounds)]


def marker_parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts, each but the first starting where a chunk does."""
    begin = 0
    while len(text) - begin > size:
        found = CUT.search(text, begin + size)
        if not found:
            break
        yield text[begin : found.start() + 1]
        begin = found.start() + 1
    yield text[begin:]


def code_long(text: str, table: ChunkTable, size: int = LONG_TEXT) -> np.ndarray:
    """Ids of one long text, part by part: the first space of a later part is the marker that it starts with."""
    parts = (part if i == 0 else part[1:] for i, part in enumerate(marker_parts(text, size)))
    return np.concatenate([code([x], table)[0] if x else np.array([table.lone], "<i4") for x in parts])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row of ``docs(doc_id, text, ...)``.

    ``ids`` are those of the model without begin and end ids, ``decoded`` is what its decode gives for them. Null text
    is empty: no ids, empty text. Repeated rows and ids are rows of their own; an empty table gives an empty result; other
    columns are not looked at, whatever their names. Texts of more than a million characters go by parts; a text without
    any space is one chunk, which the library takes whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in batches:
            for begin, end in cuts(batch.column(1), BATCH_BYTES, len(batch)):
                rows = batch.slice(begin, end - begin)
                texts = [x or "" for x in rows.column(1).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
                    ids = code_long(texts[0], table)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = code(texts, table)
                flat = ids.tolist()
                decoded = table.model.decode([flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], num_threads=1)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of rows of ``coded(doc_id, ids, ...)`` by the model's decode; null ids are none, of any origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunk_table(model_path).model
        for batch in batches:
            texts = [model.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
