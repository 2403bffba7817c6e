"""Ranked lexical search by hashed max-sketches.

1. Terms of the queries become a vocabulary, which is broadcast in blocks of bounded size. One pass over all documents writes, for each,
   its length and the counts of the vocabulary's terms; what these rows hold is summed to N, L and df.
2. In a second pass each task takes its documents block by block. A document's impacts (weight times saturated count of
   each term) fold into a sketch: term t goes to coordinate hash(t), and a coordinate keeps its maximum. One product of a
   block of sketches with the queries' coordinate counts is every query's upper bound for every document.
3. For each query, documents are scored exactly in order of descending bounds until the bound falls below the k-th best exact
   score that the task has seen. What a task keeps, at most k rows for each query, is merged by a window.

Bounds only order and end the exact scoring, so results don't depend on the width of the sketch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import chunks, hash_runs

#: Coordinates of a sketch, documents of a block, and documents scored at once.
WIDTH = 1024
BLOCK_DOCS = 4_096
RESCORED = 128
#: Queries and characters of queries that are searched in one pass; further ones take further passes.
BLOCK_QUERIES = 256
BLOCK_CHARACTERS = 4_000_000
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
SHORTLIST = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


class Vocabulary:
    """The distinct terms of some queries, found in documents by hash and then compared character by character."""

    def __init__(self, terms: Sequence[str]):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in terms]
        size = np.array([len(p) for p in points], np.int64)
        ends = np.cumsum(size)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        hashes = hash_runs(flat, ends - size, ends)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.flat, self.size, self.start = flat, size, ends - size

    def look_up(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term's number for each run of code points, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = hash_runs(points, starts, ends)
        place = np.searchsorted(self.hashes, hashes)
        while len(todo := np.flatnonzero((out < 0) & (place < len(self.hashes)))):
            todo = todo[self.hashes[place[todo]] == hashes[todo]]
            if not len(todo):
                break
            term = self.number[place[todo]]
            ok = self.size[term] == ends[todo] - starts[todo]
            own, term_ok = todo[ok], term[ok]
            size = self.size[term_ok]
            before = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(before, size)
            same = points[np.repeat(starts[own], size) + inner] == self.flat[np.repeat(self.start[term_ok], size) + inner]
            equal = np.logical_and.reduceat(same, before) if len(own) else np.zeros(0, bool)
            out[own[equal]] = term_ok[equal]
            place[todo] += 1  # the next term of the same hash, if there is one
        return out


def is_term(points: np.ndarray) -> np.ndarray:
    return (points >= 0x80) | (points - 0x30 < 10) | (points - 0x61 < 26)


def count_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms of the document), and the numbers and counts of the vocabulary's terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = max(len(own.size), 1)
        for chunk in chunks(batches):
            n, found = np.zeros(chunk.n, np.int64), []
            for part in chunk.parts():
                points = np.where((part.points >= 65) & (part.points <= 90), part.points + np.uint32(32), part.points)
                starts, ends, row = part.runs(is_term(points))
                n += np.bincount(row, minlength=chunk.n)
                term = own.look_up(points, starts, ends)
                found.append((row * total + term)[term >= 0])
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            ends = np.searchsorted(keys, np.arange(chunk.n + 1) * total).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % total, counts)]
            yield pa.RecordBatch.from_arrays([chunk.rows.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


@dataclass
class Index:
    """What the second pass needs: corpus sizes, term weights and coordinates, and each query's terms."""

    documents: int
    length: int
    weights: np.ndarray
    coordinate: np.ndarray
    queries: list[np.ndarray]
    k: int

    def lookups(self, width: int) -> np.ndarray:
        """[width, queries]: how many terms of a query fall on each coordinate."""
        out = np.zeros((width, len(self.queries)))
        for q, terms in enumerate(self.queries):
            np.add.at(out[:, q], self.coordinate[terms], 1.0)
        return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The k best (score, doc_id) of one query; equal scores by ascending doc_id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a further document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = np.append(self.score, score), np.append(self.null, null), np.append(self.doc, doc)
        order = np.lexsort((doc, null, -score))[: self.k]
        order = order[score[order] > 0]
        self.score, self.null, self.doc = score[order], null[order], doc[order]


def search_block(index: Index, lookups: np.ndarray, best: list[Best], doc: np.ndarray, null: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
    """Add a block of documents, whose terms are ``term[at[i]:at[i + 1]]`` with counts ``tf``, to the queries' best ones."""
    m = 50 + (50 * n * index.documents) // max(index.length, 1)
    row = np.repeat(np.arange(len(n)), np.diff(at))
    impact = index.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    width = len(lookups)
    sketch = np.zeros(len(n) * width)
    np.maximum.at(sketch, row * width + index.coordinate[term], impact)
    bounds = sketch.reshape(len(n), width) @ lookups
    member = np.zeros(len(index.weights), np.int64)
    for q, terms in enumerate(index.queries):
        own = best[q]
        found = np.flatnonzero(bounds[:, q] >= own.least)
        if not len(found):
            continue
        found = found[np.argsort(-bounds[found, q], kind="stable")]
        member[terms] = 1
        for begin in range(0, len(found), RESCORED):
            some = found[begin : begin + RESCORED]
            if bounds[some[0], q] < own.least:
                break
            size = np.diff(at)[some]
            before = np.cumsum(size) - size
            place = np.repeat(at[some] - before, size) + np.arange(int(size.sum()))
            own.add(np.add.reduceat(impact[place] * member[term[place]], before), null[some], doc[some])
        member[terms] = 0


def shortlist(postings: DataFrame, index: Index, width: int = WIDTH) -> DataFrame:
    """(query, doc_id, score): the k best documents of each task for each query."""
    shared = postings.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookups, best = own.lookups(width), [Best(own.k) for _ in own.queries]
        for batch in batches:
            for begin in range(0, len(batch), BLOCK_DOCS):
                rows = batch.slice(begin, BLOCK_DOCS)
                ids, terms, counts = rows.column(0), rows.column(2), rows.column(3)
                sizes = np.diff(terms.offsets.to_numpy())
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[some]
                null = ids.is_null().to_numpy(zero_copy_only=False)[some]
                at = np.concatenate([[0], np.cumsum(sizes[some])])
                search_block(own, lookups, best, doc, null, rows.column(1).to_numpy()[some], at, terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64))
        query = np.repeat(np.arange(len(best)), [len(b.score) for b in best]).astype(np.int32)
        if len(query):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(query), doc, pa.array(np.concatenate([b.score for b in best]))], names=["query", "doc_id", "score"])

    return postings.mapInArrow(run, SHORTLIST)


def query_blocks(items: DataFrame, queries: int, characters: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The queries with terms, each as its id and distinct terms, in blocks of bounded size; they pass the driver one block at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        terms = sorted(set(terms_of(row[1])))
        if not terms:
            continue
        length = len(row[1])
        if block and (len(block) >= queries or size + length > characters):
            yield block
            block, size = [], 0
        block.append((row[0], terms))
        size += length
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, width: int = WIDTH, block: int = BLOCK_QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of all ``docs(doc_id, text, ...)`` for each row of ``items(item_id, text, ...)``.

    Scores above 0 only, the highest first, equal ones by ascending doc_id. Terms, weights and scores are those of integer
    BM25 with a length normalisation of one half. Null text has no terms. Each row of ``docs`` is a document, so that a repeated doc_id can stand twice in a list;
    a null doc_id comes last among equal scores. Each row of ``items`` is a query of its own, also where an id repeats or is null; one without terms
    or matches has no rows, and so has an empty table. Texts of more than a million characters are counted in parts. Other columns are not looked at.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in query_blocks(items, block, BLOCK_CHARACTERS):
        terms = sorted({t for _, own in some for t in own})
        number = {t: i for i, t in enumerate(terms)}
        vocabulary = Vocabulary(terms)
        postings = materialize(count_terms(docs, vocabulary), "search-postings")
        sums = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(terms), np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row["term"]] = row["count"]
        weights = np.array([weight(sums["documents"], int(x)) for x in df], np.int64)
        coordinate = np.empty(len(terms), np.int64)
        coordinate[vocabulary.number] = (vocabulary.hashes % np.uint64(width)).astype(np.int64)
        index = Index(sums["documents"], sums["length"], weights, coordinate, [np.array([number[t] for t in own]) for _, own in some], k)
        ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = shortlist(postings, index, width).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(some)], "query int, item_id long"))
        out = out.unionByName(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out
