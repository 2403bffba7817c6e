"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are taken from a bounded sample. Every vector is described by its nearest pivots in
order of distance and enters the inverted list of each. Two vectors of a list that share enough pivots are
candidates; their cosine is computed in double precision. Lists are dealt into blocks and each pair of blocks is
one bounded group, worked through in stripes. Equal vectors are one numbered node, whatever their ids. A pair is looked at only in the list of the smallest pivot that both share, so that link
counts add up without the pairs being written: a group returns a count for each vector and as few links as join
its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, unit_hash

#: Pivots for each square root of the number of vectors, and at least; bytes that they may take in every executor.
#: Those bytes are reached at 6e10 vectors of 64 components; lists grow from there on, and no link is lost.
PIVOTS_PER_ROOT = 4
LEAST_PIVOTS = 64
PIVOT_BYTES = 512_000_000
#: Nearest pivots of a vector, and how many of them two candidates share.
NEAREST = 12
SHARED = 2
#: Rows of a block, and of a stripe of it that is compared at once.
BLOCK_ROWS = 2_048
STRIPE_ROWS = 256
#: Cosines to pivots that are held at once.
COSINES = 4_000_000

PARSED = "vec_id long, body binary"


def parse_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the components as float64 bytes; null for a vector that can link with nothing."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            bodies: list[bytes | None] = []
            flat = held.values.to_numpy(zero_copy_only=False).astype(np.float64)
            known = held.values.is_valid().to_numpy(zero_copy_only=False)
            offsets, valid = held.offsets.to_numpy(), held.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(held)):
                own = flat[offsets[i] : offsets[i + 1]]
                good = valid[i] and len(own) and known[offsets[i] : offsets[i + 1]].all() and np.isfinite(own).all() and own.any()
                bodies.append((own + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["vec_id", "body"])

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(parse, PARSED)


def unit_rows(bodies: list[bytes], dimension: int) -> np.ndarray:
    """Vectors of length 1; shorter ones are padded by zeros. Scaled first, so that no square over- or underflows."""
    out = np.zeros((len(bodies), dimension))
    for i, x in enumerate(bodies):
        own = np.frombuffer(x, np.float64)
        out[i, : len(own)] = own / np.abs(own).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(nodes: DataFrame, rows: int, dimension: int, threshold: float, seed: int = 2) -> np.ndarray:
    """Unit vectors, none within the link threshold of another, from a sample of three times as many nodes."""
    wanted = min(max(int(PIVOTS_PER_ROOT * np.sqrt(rows)), LEAST_PIVOTS), PIVOT_BYTES // (8 * dimension))
    sample = nodes.where(unit_hash(F.col("body"), seed) < 3 * wanted / max(rows, 1)).select("body").toArrow().sort_by("body")
    units = unit_rows(sample.column("body").to_pylist(), dimension)
    units = units[np.random.default_rng(seed).permutation(len(units))]
    kept = np.zeros((0, dimension))
    for part in np.array_split(units, max(1, len(units) // 256)):
        part = part[(part @ kept.T < threshold).all(1)]
        own: list[int] = []
        near = part @ part.T >= threshold
        for i in range(len(part)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, part[own]])[:wanted]
    return kept


def pivot_lists(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """pivot, node, copies, body and the node's pivots (int32 bytes, ascending), a row for each of its nearest pivots."""
    held = nodes.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        k = min(NEAREST, len(pivots))
        for batch in batches:
            step = max(1, min(512, COSINES // len(pivots)))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                cosine = unit_rows(part.column(1).to_pylist(), pivots.shape[1]) @ pivots.T
                nearest = np.sort(np.argpartition(-cosine, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
                own = pa.array([x.tobytes() for x in nearest], pa.binary())
                at = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest.ravel()), *(c.take(pa.array(at)) for c in (*(part.column(j) for j in (0, 2, 1)), own))],
                    names=["pivot", "node", "copies", "body", "pivots"],
                )

    return nodes.select("node", "body", "copies").mapInArrow(describe, "pivot int, node long, copies long, body binary, pivots binary")


def group_links(group: pa.Table, threshold: float, dimension: int) -> pa.Table:
    """Of one pair of blocks: link counts by node (copies of the other node included), and links that join components."""
    pivot, i, j = (group.column(x)[0].as_py() for x in ("pivot", "i", "j"))
    node, copies, block = (group.column(x).to_numpy() for x in ("node", "copies", "block"))
    lists = np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in group.column("pivots")])
    names, at = np.unique(lists, return_inverse=True)
    held = np.zeros((len(node), len(names)), np.float32)
    held[np.repeat(np.arange(len(node)), lists.shape[1]), at.ravel()] = 1
    lower = held[:, names < pivot]
    units = unit_rows(group.column("body").to_pylist(), dimension)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    counts, label, a, b = np.zeros(len(node), np.int64), np.arange(len(node)), [], []
    for begin in range(0, len(left), STRIPE_ROWS):
        own = left[begin : begin + STRIPE_ROWS]
        linked = (units[own] @ units[right].T >= threshold) & (held[own] @ held[right].T >= min(SHARED, lists.shape[1])) & (lower[own] @ lower[right].T == 0)
        if i == j:
            linked &= own[:, None] < right[None, :]
        counts[own] += linked @ copies[right]
        counts[right] += linked.T @ copies[own]
        for x in np.flatnonzero(linked.any(1)):
            near = right[linked[x]]
            for y in near[np.unique(label[near], return_index=True)[1]]:
                if label[y] != label[own[x]]:
                    a.append(node[own[x]])
                    b.append(node[y])
                    label[label == label[y]] = label[own[x]]
    some = np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array(np.concatenate([node[some], np.array(a, np.int64)]), pa.int64()),
            "b": pa.array([*[None] * len(some), *(int(x) for x in b)], pa.int64()),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]), pa.int64()),
        }
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, ...)``.

    Vectors of cosine at least ``threshold`` are linked. A vector that is null, empty or zero, or holds null or
    non-finite components, links with nothing: n_links 0, component_id its own vec_id. Vectors of fewer
    components count as padded by zeros. Equal vectors are compared once and each counts as a link of the others;
    rows that repeat a vec_id are counted each, by their own vector. A null vec_id has n_links and component_id null. Other columns,
    labels too, are not looked at.
    """
    parsed = materialize(parse_vectors(vectors), "pivot-vectors")
    usable = parsed.where("body is not null and vec_id is not null")
    nodes = usable.groupBy("body").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    rows, size = nodes.agg(F.count(F.lit(1)), F.max(F.length("body"))).first()
    if not rows:
        return parsed.select(
            "vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    dimension = size // 8
    lists = materialize(pivot_lists(nodes, choose_pivots(nodes, rows, dimension, threshold)), "pivot-lists")
    sizes = lists.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = lists.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "body", "pivots")
    found = dealt.groupBy("pivot", "i", "j").applyInArrow(lambda g: group_links(g, threshold, dimension), "a long, b long, n long")
    found = materialize(found, "pivot-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(components, "node", "left")
    named = named.select("body", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    named = materialize(named, "pivot-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("body", "links", "component_id")
    known = F.col("vec_id").isNotNull()
    return (
        parsed.join(named, "body", "left")
        .select("vec_id", F.when(known, F.coalesce("links", F.lit(0))).alias("n_links"), F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
