"""Exact duplicates through an extendible-hash index on shared files.

Every text gets a 64-bit key, xxhash64 of its normalised bytes. The index lists the keys with their row counts,
in buckets: a directory of 2^depth entries maps the leading bits of a key to its bucket; a bucket over capacity
is split on its next bit, and the directory is doubled when that bit is beyond its depth. Buckets are ranges of
keys, and each owner task holds a run of them: it chains the keys of its buckets, adds up their rows and writes
them as Parquet in the shared folder. Rows then find their bucket by the directory and their key in its file. Texts
whose key occurs once equal no other. The others go to the owner of their bucket, which chains texts under one key
and tells them apart by comparing bytes.

A text that many rows hold reaches its owner once for each map task at most; the rows that hold it are joined
back by a join whose hot keys the skew rule splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

WHITE = b"\x20\t\n\x0b\x0c\r"

#: Keys that a bucket may hold, and the depth beyond which capacity grows instead (the directory is on the driver).
BUCKET_KEYS = 256
MAX_DEPTH = 18

#: Most ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Bytes of distinct texts that a map task combines before it passes them on.
COMBINE_BYTES = 32_000_000

KEYS = "doc_id long, n_chars long, key long, sha binary"
ENTRY = "owner int, bucket int, key long, sha binary, body binary, n long, best_chars long, best_id long"
CLASS = "key long, sha binary, keep_id long, group_size long"


def normal_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return [(x or b"").translate(None, WHITE) for x in column.cast(pa.binary()).to_pylist()]


def text_keys(docs: DataFrame, hash_of: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> DataFrame:
    """doc_id, n_chars (code points of the original), key and SHA-256 of the normalised text, for each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = normal_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(np.fromiter(map(hash_of, bodies), np.uint64, len(bodies)).view(np.int64)),
                    pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()),
                ],
                names=["doc_id", "n_chars", "key", "sha"],
            )

    return _plain(docs).mapInArrow(digest, KEYS)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


@dataclass
class Directory:
    """Bucket of each prefix of ``depth`` bits, and the owner of each bucket; buckets are numbered in the order of keys."""

    bucket: np.ndarray
    owner: np.ndarray

    def place(self, keys: np.ndarray) -> np.ndarray:
        depth = len(self.bucket).bit_length() - 1
        return self.bucket[keys.view(np.uint64) >> np.uint64(64 - depth)] if depth else np.zeros(len(keys), np.int32)


def split_directory(counts: np.ndarray, capacity: int, owners: int = 1) -> Directory:
    """The directory for ``counts[p]`` rows under each prefix p of full depth.

    Starts from one bucket; while a bucket holds more than ``capacity`` rows it is split on its next bit, doubling
    the directory if it is as deep as the directory, until the full depth. Owners get runs of buckets of about equal
    numbers of rows.
    """
    full = len(counts).bit_length() - 1
    below = np.concatenate([[0], np.cumsum(counts)])
    directory, depth, todo, starts = np.zeros(1, np.int64), 0, [(0, 0)], []
    while todo:
        first, own = todo.pop()
        wide = 1 << (full - own)
        if below[first + wide] - below[first] <= capacity or own == full:
            starts.append(first)
            continue
        if own == depth:
            directory, depth = np.repeat(directory, 2), depth + 1
        middle = first + wide // 2
        directory[middle >> (full - depth) : (first + wide) >> (full - depth)] = middle
        todo += [(middle, own + 1), (first, own + 1)]
    edges = np.append(starts, len(counts))
    rows = below[edges[1:]] - below[edges[:-1]]
    middle = np.cumsum(rows) - rows / 2
    owner = np.minimum(middle * owners // max(int(rows.sum()), 1), owners - 1).astype(np.int32)
    return Directory(np.searchsorted(starts, directory).astype(np.int32), owner)


def owners_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def build_index(keys: DataFrame) -> tuple[DataFrame, Directory]:
    """The index (bucket, key, n) as files in the shared folder, each with the buckets of one owner, and its directory."""
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    counts = np.zeros(1 << MAX_DEPTH, np.int64)
    found = keys.groupBy(prefix.alias("p")).count().toArrow()
    counts[found.column("p").to_numpy()] = found.column("count").to_numpy()
    owners = owners_of(keys.sparkSession)
    directory = split_directory(counts, max(BUCKET_KEYS, int(counts.sum()) >> (MAX_DEPTH - 2)), owners)
    held = keys.sparkSession.sparkContext.broadcast(directory)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            bucket = held.value.place(own)
            yield pa.RecordBatch.from_arrays([pa.array(held.value.owner[bucket]), pa.array(bucket), pa.array(own), pa.array(n)], names=["owner", "bucket", "key", "n"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of keys, one for each key; the last of a batch waits for the next."""
        waiting = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            bucket, key, n = (np.concatenate([w, batch.column(i).to_numpy()]) for i, w in zip((1, 2, 3), waiting, strict=True))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            own = [bucket[first], key[first], np.add.reduceat(n, first) if len(first) else n]
            waiting = [x[-1:] for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in own], names=["bucket", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in waiting], names=["bucket", "key", "n"])

    placed = keys.select("key").mapInArrow(place, "owner int, bucket int, key long, n long")
    owned = placed.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key")
    return materialize(owned.mapInArrow(chain, "bucket int, key long, n long"), "dedup-index"), directory


def with_bucket(keys: DataFrame, directory: Directory) -> DataFrame:
    """``keys(doc_id, n_chars, key, sha)`` with the bucket that the directory gives."""
    held = keys.sparkSession.sparkContext.broadcast(directory)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = held.value.place(batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["doc_id", "key", "bucket"])

    return keys.select("doc_id", "key").mapInArrow(place, "doc_id long, key long, bucket int")


def equal_classes(texts: DataFrame, directory: Directory, hash_of: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> DataFrame:
    """key, sha, keep_id, group_size of each distinct text in ``texts(doc_id, text)``, found by its bucket's owner."""
    held = texts.sparkSession.sparkContext.broadcast(directory)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for doc_id, n, body in zip(batch.column(0).to_pylist(), chars, normal_bytes(batch.column(1)), strict=True):
                if (old := found.get(body)) is None:
                    found[body] = [1, n, doc_id]
                    size += len(body) + 200
                else:
                    old[0] += 1
                    old[1:] = better(old[1:], [n, doc_id])
                if size >= COMBINE_BYTES:
                    yield pack(found)
                    found, size = {}, 0
        if found:
            yield pack(found)

    def pack(found: dict[bytes, list]) -> pa.RecordBatch:
        keys = np.fromiter(map(hash_of, found), np.uint64, len(found)).view(np.int64)
        n, chars, ids = zip(*found.values(), strict=True)
        bucket = held.value.place(keys)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(held.value.owner[bucket]),
                pa.array(bucket),
                pa.array(keys),
                pa.array([hashlib.sha256(x).digest() for x in found], pa.binary()),
                pa.array(list(found), pa.binary()),
                *(pa.array(x, pa.int64()) for x in (n, chars, ids)),
            ],
            names=["owner", "bucket", "key", "sha", "body", "n", "best_chars", "best_id"],
        )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for batch in batches:
            done: list[list] = []
            for key, sha, body, n, chars, doc_id in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                if key != at:
                    done += chain
                    at, chain = key, []
                for link in chain:
                    if link[5] == body:
                        link[3] += n
                        link[2], link[1] = better([link[2], link[1]], [chars, doc_id])
                        break
                    if link[4] == sha:
                        raise RuntimeError("two texts of one SHA-256")
                else:
                    chain.append([key, doc_id, chars, n, sha, body])
            if done:
                yield classes(done)
        if chain:
            yield classes(chain)

    def classes(links: list[list]) -> pa.RecordBatch:
        key, keep, _, n, sha, _ = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(sha, pa.binary()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())],
            names=["key", "sha", "keep_id", "group_size"],
        )

    entries = _plain(texts).mapInArrow(combine, ENTRY)
    owned = entries.repartitionById(owners_of(texts.sparkSession), "owner")
    return owned.sortWithinPartitions("bucket", "key").mapInArrow(own, CLASS)


def better(a: list, b: list) -> list:
    """Of two [n_chars, doc_id], the one with more code points, then the smaller id; a null id comes last."""
    return max(a, b, key=lambda x: (x[0], x[1] is not None, -(x[1] or 0)))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs(doc_id, text, ...)``.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty,
    and all empty texts are one group. Of a group the row with the most code points in its original text stays,
    then the smallest doc_id, a null doc_id last. Rows that repeat both doc_id and text are each counted and
    carry the same ``kept``. Other columns are not looked at. An empty table gives an empty result.
    """
    keys = materialize(text_keys(docs), "dedup-keys")
    index, directory = build_index(keys)
    again = with_bucket(keys, directory).join(index.where("n > 1").select("bucket", "key"), ["bucket", "key"], "left_semi")
    wanted = materialize(again.where("doc_id is not null").select("doc_id").distinct(), "dedup-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    plain = _plain(docs)
    texts = plain.join(wanted, "doc_id", "left_semi").union(plain.where("doc_id is null"))
    found = materialize(equal_classes(texts, directory).where("group_size > 1"), "dedup-classes")
    return keys.join(found, ["key", "sha"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all columns: one of those that :func:`exact_duplicates` keeps.

    The longest original stays, then the smallest doc_id, a null one last; of rows that repeat doc_id and text any one.
    Decisions go back by doc_id alone where no id repeats or is null, else by id and digest for the rows of such ids.
    """
    report = materialize(exact_duplicates(docs), "dedup-report")
    repeated = report.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_special"))
    repeated = materialize(repeated, "dedup-repeated")
    dropped = report.where("not kept and doc_id is not null").select("doc_id").distinct()
    if repeated.isEmpty():
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    other = dropped.union(repeated.where("_special is not null")).distinct()
    once = docs.where("doc_id is not null").join(other, "doc_id", "left_anti").select(*docs.columns)
    sha, row, doc, size = (fresh(docs, x) for x in ("_sha", "_row", "_doc", "_size"))
    special = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_special"]), "left_semi")
    stay = report.where("kept").join(repeated, report["doc_id"].eqNullSafe(repeated["_special"]), "left_semi")
    stay = stay.select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(f"{sha}_")).distinct()
    rows = with_digest(special, sha)
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(sha) == F.col(f"{sha}_")), "left_semi")
    rows = rows.withColumn(size, F.coalesce(F.length("text"), F.lit(0)))
    longest = F.max_by(F.struct(*docs.columns), F.col(size)).alias(row)
    return once.union(rows.groupBy(F.col("doc_id").alias(doc), sha).agg(longest).select(f"{row}.*"))


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the text_sha256 of :func:`exact_duplicates` as column ``name``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hashlib.sha256(x).hexdigest() for x in normal_bytes(batch.column("text"))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(digest, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
