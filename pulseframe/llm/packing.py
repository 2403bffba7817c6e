"""Best-fit packing of tokenised documents by exact-complement hashing.

Tokenising, ranking and placing run over all rows in parallel; only the histogram of piece lengths, one number
for each length up to the sequence length, is planned on the driver. The plan lists patterns (lengths that
share a sequence) with the number of sequences of each, and a piece finds its place from its length and its
rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import LONG_TEXT, cuts, long_parts

SEQUENCE = 2048
#: Word pieces whose ids a Python worker remembers.
CACHE_WORDS = 200_000
CHUNK_BYTES = 1_500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


@cache
def classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other, as the tokenizer's pattern divides them."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for k, pattern in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        out[found] = k
    return out


def split_points(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern starts a piece, for texts end to end that have no apostrophe.

    Pieces are runs of one class with one preceding space if there is one; of a run of white space before
    another class all but the last character is one piece, and the last, unless a space, another.
    """
    kind = classes()[points]
    white = kind == 0
    start = np.empty(len(points), bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    edge = bounds[:-1][np.diff(bounds) > 0]
    start[edge] = True
    after_space = np.zeros(len(points), bool)
    after_space[1:] = points[:-1] == 32
    after_space[edge] = False
    lone = white.copy()
    lone[:-1] &= ~white[1:]
    lone[-1] = False
    lone[edge[1:] - 1] = False
    return np.flatnonzero((start & ~(after_space & ~white)) | lone)


class WordIds:
    """Token ids of word pieces, from a tokenizers file; remembers the pieces it has seen."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word piece.

        Two generations are remembered; a word used again moves to the recent one, so that frequent words stay.
        """
        out = list(map(self.recent.get, words))
        new = []
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = self.older.get(words[i])
                if x is None:
                    new.append(i)
                else:
                    self.recent[words[i]] = x
        if new:
            coded = self.tokenizer.encode_batch_fast([words[i].decode() for i in new], add_special_tokens=False)
            for i, e in zip(new, coded, strict=True):
                out[i] = self.recent[words[i]] = array("I", e.ids).tobytes()
        if len(self.recent) > CACHE_WORDS // 2:
            self.recent, self.older = {}, self.recent
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's ids of all texts end to end, and n + 1 bounds.

    Texts with an apostrophe or a special token go to it whole; of the others the distinct word pieces do.
    """
    model = word_ids(path)
    odd = [i for i, x in enumerate(texts) if "'" in x or "<|" in x]
    plain = [x for x in texts if "'" not in x and "<|" not in x] if odd else texts
    flat, cut = _plain_ids(plain, model)
    if not odd:
        return flat, cut
    found, own, k = [], set(odd), 0
    for i, text in enumerate(texts):
        if i in own:
            found.append(model.whole(text))
        else:
            found.append(flat[cut[k] : cut[k + 1]])
            k += 1
    return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def _plain_ids(texts: list[str], model: WordIds) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    if not joined:
        return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    starts = split_points(points, bounds)
    encoded = joined.encode()
    if len(encoded) == len(points):
        offsets = np.append(starts, len(points)).astype(np.int32)
    else:
        wide = (points > 0x7F).view(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.append(starts + np.concatenate([[0], np.cumsum(wide, dtype=np.int32)])[starts], len(encoded)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(encoded)])
    coded = pieces.dictionary_encode()
    own = model(coded.dictionary.to_pylist())
    which = coded.indices.to_numpy()
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    each = size[which]
    before = np.concatenate([[0], np.cumsum(each)])
    flat = np.frombuffer(b"".join(own), "<u4")[np.repeat(begin[which] - before[:-1], each) + np.arange(before[-1])]
    return flat, before[np.searchsorted(starts, bounds)]


def text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for begin, end in cuts(batch.column(1), CHUNK_BYTES, len(batch)):
        rows = batch.slice(begin, end - begin)
        yield rows.column(0), [x or "" for x in rows.column(1).to_pylist()]


def ids_of_chunk(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`token_ids`; a long text is alone in its chunk and goes by parts that start where a word piece does."""
    if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
        flat = np.concatenate([token_ids([x], path)[0] for x in long_parts(texts[0])])
        return flat, np.array([0, len(flat)])
    return token_ids(texts, path)


def pieces(docs: DataFrame, tokenizer_path: str, separator: int = 0, length: int = SEQUENCE) -> DataFrame:
    """The pieces of each document with their length, checksum, and rank by length within the task that cut them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            for doc_ids, texts in text_chunks(batch):
                flat, bounds = ids_of_chunk(texts, tokenizer_path)
                ids = np.insert(flat, bounds[1:], separator)
                whole = np.diff(bounds) + 1
                count = -(-whole // length)
                doc = np.repeat(np.arange(len(texts)), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (whole - (count - 1) * length)[doc]
                start, size = np.where(k == 0, 0, first + (k - 1) * length), np.where(k == 0, first, length)
                at = 4 * ((np.cumsum(whole) - whole)[doc] + start)
                view = memoryview(ids.tobytes())
                crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)), np.int64, len(at))
                order = np.argsort(size, kind="stable")
                group = np.flatnonzero(np.append(True, np.diff(size[order]) > 0))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(group, np.diff(np.append(group, len(size))))
                rank += seen[size]
                seen += np.bincount(size, minlength=length + 1)
                columns = [doc_ids.take(pa.array(doc)), pa.array(k.astype(np.int32)), *map(pa.array, (start, size, crc)), pa.array(np.full(len(k), task, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class Stock:
    """How many pieces of each length are left, with the single, pair and triple sums that they can make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that sum to ``gap``, the longest possible first."""
        low = np.arange(1, gap // 2 + 1)
        ok = (self.left[low] > 0) & (self.left[gap - low] > 0)
        if gap % 2 == 0 and len(ok):
            ok[-1] = self.left[gap // 2] > 1
        found = np.flatnonzero(ok)
        return (int(gap - low[found[0]]), int(low[found[0]])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths that sum to ``gap``."""
        for a in np.flatnonzero(self.left[: gap - 1])[::-1]:
            self.left[a] -= 1
            two = self.pair(gap - int(a))
            self.left[a] += 1
            if two:
                return (int(a), *two)
        return None


def plan_patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences of each, for ``counts[n]`` pieces of length n up to the sequence length.

    From the longest length down, the gap that it leaves is filled exactly by one, two or three available
    lengths, as many times at once as the counts allow. What finds no complement is packed best-fit, longest
    first, also in bulk. The number of patterns is bounded by the number of lengths, not of pieces.
    """
    length = len(counts) - 1
    stock = Stock(counts)
    left = stock.left
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        plan.append(((length,), int(left[length])))
        left[length] = 0
    rest = np.zeros_like(left)
    for n in range(length - 1, 0, -1):
        while left[n]:
            left[n] -= 1
            found = stock.single(length - n) or stock.pair(length - n) or stock.triple(length - n)
            left[n] += 1
            if not found:
                rest[n], left[n] = left[n], 0
                break
            whole = (n, *found)
            times = min(int(left[x]) // whole.count(x) for x in set(whole))
            for x in whole:
                left[x] -= times
            plan.append((whole, times))
    return plan + best_fit(rest, length)


def best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over equal lengths at once; ``open_at[gap]`` lists patterns with that gap."""
    open_at: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    for n in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[n])
        for gap in range(n, length):
            while todo and open_at[gap]:
                pattern, times = open_at[gap].pop()
                each = min(gap // n, todo)
                used = min(times, todo // each)
                if times > used:
                    open_at[gap].append((pattern, times - used))
                open_at[gap - each * n].append((pattern + (n,) * each, used))
                todo -= used * each
            if not todo:
                break
        if todo:
            each = length // n
            if todo // each:
                open_at[length - each * n].append(((n,) * each, todo // each))
            if todo % each:
                open_at[length - todo % each * n].append(((n,) * (todo % each), 1))
    return [x for group in open_at for x in group]


def slot_tables(plan: list[tuple[tuple[int, ...], int]], length: int) -> list[tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of each slot that takes it, by rank."""
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
    taken = [0] * (length + 1)
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            slots[n].append((taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in slots]


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 0, length: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs(doc_id, text, ...)``.

    A document is its token ids and then ``separator``; one longer than ``length`` is cut into pieces of
    ``length``, the first of which may be shorter. Null text is empty: one piece of the separator alone. Rows
    that repeat a doc_id, null ones too, are packed each on their own. An empty table gives an empty result.
    Texts of more than a million characters are tokenised in parts. Other columns are not looked at.
    """
    cut = materialize(pieces(docs, tokenizer_path, separator, length), "packing-pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = materialize(ranks.select("length", "task", "n", "before"), "packing-ranks")
    counts = np.zeros(length + 1, np.int64)
    for row in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    tables = docs.sparkSession.sparkContext.broadcast(slot_tables(plan_patterns(counts), length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                first, begin, inner = tables.value[n]
                slot = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = begin[slot] + rank[own] - first[slot]
                offset[own] = inner[slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(ranks.select("length", "task", "before"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
