"""MinHash near-duplicates by min-max hashing.

Each permutation gives two signature values, the minimum and the maximum of the permuted shingles, so that a
signature of ``2 * permutations`` values costs ``permutations`` hash evaluations for each shingle. Values are
banded; documents that share a band are compared on their whole shingle sets.

How links are found without emitting the pairs of a group:

1. Documents of equal sets become one numbered node; all that follows is about sets and not about ids.
2. Band buckets that hold the same nodes as another band's are looked at once.
3. In each bucket the members are compared with one pivot, the member that shares most buckets. Confirmed
   links are joined into components. A pair inside one component needs no comparison any more. Buckets whose
   members still belong to several components are compared with further pivots.
4. In what is left all pairs of different components are compared, whatever their number: members are dealt by
   size into classes, of which only equal and neighbouring ones can reach the similarity, and within a class
   into blocks. Each pair of such blocks is one bounded group, to which each set comes once; its
   intersections are counted by array operations. Only links that join two components leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, fresh, materialize
from .textkernel import STEP, chunks, mix64, word_shingles

SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def min_max_signature(values: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """[rows of ``bounds``, 2 * permutations] minima and maxima of the permuted 64-bit values; no row may be empty."""
    keys = mix64(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * STEP + np.uint64(seed))
    out = np.empty((len(bounds) - 1, 2 * permutations), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(permutations):
            permuted = values * (keys[2 * k] | np.uint64(1)) + keys[2 * k + 1]
            permuted ^= permuted >> np.uint64(32)
            out[:, 2 * k] = np.minimum.reduceat(permuted, bounds[:-1])
            out[:, 2 * k + 1] = np.maximum.reduceat(permuted, bounds[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` signature values."""
    n_bands = signature.shape[1] // rows
    keys = np.tile(np.arange(n_bands, dtype=np.uint64), (len(signature), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix64(keys * STEP + signature[:, k : n_bands * rows : rows])
    return keys.view(np.int64)


def signatures(docs: DataFrame, words: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the whole set; null if empty) and band keys of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for chunk in chunks(batches):
            values, bounds = word_shingles(chunk, words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            keys: list[bytes | None] = [None] * chunk.n
            bands: list[np.ndarray | None] = [None] * chunk.n
            if len(full):
                starts = np.append(bounds[full], len(values))
                found = band_keys(min_max_signature(values, starts, permutations), rows)
                for i, own in zip(full, found, strict=True):
                    keys[i] = xxhash.xxh3_128_digest(values[bounds[i] : bounds[i + 1]].tobytes())
                    bands[i] = own
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=SIGNATURE.fieldNames(),
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGNATURE)


#: Rows of a block in the comparison of all pairs, and 8-byte values of its sets.
BLOCK_ROWS = 256
BLOCK_VALUES = 1_000_000
#: Pivots that the members of a bucket are compared with before all pairs are.
STAR_ROUNDS = 3

#: Most candidate sets whose keys are sent to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles (binary: the sorted distinct 64-bit hashes) of each ``wanted(node, rep, set_key)``.

    The text is looked up by ``rep``, its doc_id; where several texts have that id, the key tells which it is.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for chunk in chunks(batches):
            values, bounds = word_shingles(chunk, words)
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [xxhash.xxh3_128_digest(x) == key for x, key in zip(sets, chunk.rows.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.rows.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(pa.array(same, pa.bool_()))

    n = wanted.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, "rep").select("node", "text", "set_key").mapInArrow(build, "node long, shingles binary")
    found = materialize(found, "minhash-sets")
    return found if found.count() == n else materialize(found.dropDuplicates(["node"]), "minhash-distinct-sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                small, large = sorted((np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right)), key=len)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                linked[i] = 100 * common >= percent * (len(small) + len(large) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    sides = {k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab"}
    joined = pairs.select("a", "b").join(sides["b"], "b").join(sides["a"], "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a long, b long")


def common_counts(values: np.ndarray, row: np.ndarray, n: int, dense_from: int = 24) -> np.ndarray:
    """[n, n] sizes of the intersections of n sets, given as values and the row that each belongs to.

    Values that few rows hold are counted row pair by row pair, the others by products of 0/1 matrices.
    """
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(starts, len(values)))
    out = np.zeros((n, n), np.float32)
    for size in range(2, min(dense_from, n + 1)):
        at = starts[sizes == size]
        if len(at):
            holders = row[at[:, None] + np.arange(size)]
            for i in range(size):
                for j in range(size):
                    np.add.at(out, (holders[:, i], holders[:, j]), 1)
    dense = np.flatnonzero(sizes >= dense_from)
    for part in np.array_split(dense, max(1, -(-len(dense) // 1024))):
        held = np.zeros((n, len(part)), np.float32)
        for k, g in enumerate(part):
            held[row[starts[g] : starts[g] + sizes[g]], k] = 1
        out += held @ held.T
    return out


def joining_links(group: pa.Table, percent: int) -> pa.Table:
    """Links of one pair of blocks (side 0 and 1; 2 within one block) that join two components, as few as join all that can be joined."""
    node, side = group.column("node").to_numpy(), group.column("side").to_numpy()
    component = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
    a, b = [], []
    if component.any():
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        common = common_counts(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets))
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= component[:, None] != component[None, :]
        if side[0] != 2:
            linked &= (side == 0)[:, None] & (side == 1)[None, :]
        root = np.arange(component.max() + 1)
        for x, y in np.argwhere(linked):
            p, q = root[component[x]], root[component[y]]
            if p != q:
                root[root == q] = p
                a.append(node[x])
                b.append(node[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def with_component(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """``members(band, node, size, degree)`` with the component of each node."""
    if components is None:
        return members.withColumn("component", F.col("node"))
    return members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def mixed_buckets(members: DataFrame, number: int) -> DataFrame:
    """band and the pivot of round ``number`` of the buckets whose members belong to several components; written, one row each."""
    first = F.col("degree") if number == 0 else F.xxhash64("node", F.lit(number))
    pivot = F.max(F.struct(first.alias("_first"), "node", "size", "component")).alias("pivot")
    found = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot).where("low < high")
    return materialize(found.select("band", "pivot"), "minhash-mixed")


def star_pairs(members: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the members of each mixed bucket with its pivot, where sizes and components let them be linked."""
    near = 100 * F.least("size", "pivot.size") >= percent * F.greatest("size", "pivot.size")
    pairs = members.join(buckets, "band").where(near & (F.col("component") != F.col("pivot.component")))
    return pairs.select(F.greatest("pivot.node", "node").alias("a"), F.least("pivot.node", "node").alias("b")).distinct()


def merged_components(components: DataFrame | None, links: DataFrame, label: str) -> DataFrame:
    """``components`` (null: every node alone) after new links."""
    if components is None:
        return materialize(connected_components(links), label)
    low, high = (components.select(F.col("node").alias(x), F.col("component").alias(f"component_{x}")) for x in "ab")
    own = links.join(low, "a", "left").join(high, "b", "left")
    own = own.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    joined = materialize(connected_components(own), label)
    further = joined.select(F.col("node").alias("component"), F.col("component").alias("_further"))
    held = components.join(further, "component", "left").select("node", F.coalesce("_further", "component").alias("component"))
    return materialize(held.union(joined.join(components, "node", "left_anti")), label)


def open_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare all pairs of ``members(band, node, size, component)`` in one band bucket but different components."""
    # a little narrower than the sizes that can reach the similarity, so that rounding never parts them by two
    kind = F.floor(F.log("size") / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")
    members = members.withColumn("kind", kind)
    blocks = members.groupBy("band", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("values"))
    blocks = blocks.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("values") / BLOCK_VALUES)).cast("int"))
    by_band = blocks.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"))
    own = F.col("blocks")[F.col("kind")]
    dealt = members.join(by_band, "band").withColumn("block", F.pmod(F.xxhash64("node"), own).cast("int"))

    def towards(step: int) -> Column:
        """Groups (lower kind, its block, upper kind, its block, side) of a member with the blocks of the kind ``step`` away."""
        other = F.col("blocks")[F.col("kind") + step] if step else own
        number = F.when(other.isNotNull(), F.sequence(F.lit(0), other - 1)).otherwise(F.array().cast("array<int>"))

        def group(j: Column) -> Column:
            if step == 0:
                low, high = F.least("block", j), F.greatest("block", j)
                side = F.when(F.col("block") == j, 2).when(F.col("block") == low, 0).otherwise(1)
            else:
                low, high = (F.col("block"), j) if step > 0 else (j, F.col("block"))
                side = F.lit(0 if step > 0 else 1)
            lower = F.col("kind") + min(step, 0)
            return F.struct(lower.alias("k"), low.alias("i"), (lower + abs(step)).alias("l"), high.alias("j"), side.alias("side"))

        return F.transform(number, group)

    every = dealt.select("band", "node", "component", F.inline(F.concat(towards(0), towards(1), towards(-1))))
    return every.join(sets, "node").groupBy("band", "k", "i", "l", "j").applyInArrow(lambda group: joining_links(group, percent), "a long, b long")


def set_components(docs: DataFrame, words: int, percent: int, permutations: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key) of every row, and (set_key, component_id) of every set of a row with a doc_id."""
    signed = materialize(signatures(docs, words, permutations, rows), "minhash-signatures")
    usable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    members = nodes.select(F.explode("bands").alias("band"), "node", "size")
    alike = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *alike).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("band").alias("band"))
    members = materialize(members.join(shared.select("band", "n"), "band"), "minhash-shared")
    degree = materialize(members.groupBy("node").agg(F.sum("n").alias("degree")), "minhash-degrees")
    wanted = materialize(nodes.select("node", "rep", "set_key").join(degree.select("node"), "node", "left_semi"), "minhash-wanted")
    sets = shingle_sets(docs, wanted, words)
    members = materialize(members.join(degree, "node").select("band", "node", "size", "degree"), "minhash-members")

    components = None
    for number in range(STAR_ROUNDS):
        own = with_component(members, components)
        links = materialize(confirm(star_pairs(own, mixed_buckets(own, number), percent), sets, percent), "minhash-star-links")
        if links.isEmpty():
            break
        components = merged_components(components, links, f"minhash-components-{number}")
    own = with_component(members, components)
    own = own.join(mixed_buckets(own, STAR_ROUNDS).select("band"), "band", "left_semi")
    more = materialize(open_links(own, sets, percent), "minhash-open-links")
    if not more.isEmpty():
        components = merged_components(components, more, "minhash-components")
    if components is None:
        return signed.drop("bands"), nodes.select("set_key", F.col("rep").alias("component_id"))
    named = nodes.select("node", "set_key", "rep").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "minhash-names")
    return signed.drop("bands"), named.join(least, "component").select("set_key", "component_id")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, permutations: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text, ...)``.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word
    shingles; a component is named by its smallest doc_id, whose row is kept. With 64 values in 16 bands of 4 a
    pair at similarity 0.85 is missed with probability below 1e-5, at 0.8 below 3e-4.

    Null and empty texts and texts of white space have n_shingles 0 and link with nothing, copies included.
    Shorter texts are one shingle. Rows that repeat a doc_id with other texts are each judged by their own text. A
    row with a null doc_id is returned with its n_shingles, the component of its set if a row with an id has that
    set, and kept true. Texts of more than a million characters are read in parts. Other columns are not looked at.
    """
    signed, named = set_components(docs, words, percent, permutations, rows)
    found = signed.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_components`, with all columns: the one of the smallest doc_id.

    Where ids repeat or are null, every distinct pair of id and text is judged on its own, under a new id in the order of
    the old ones (null last), and of rows that repeat both one stays. Texts without words are in no component; they all
    stay, those that repeat an id once.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        report = near_components(docs, words, percent)
        dropped = materialize(report.where("not kept").select("doc_id"), "minhash-dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    sha, number, doc, count, row = (fresh(docs, x) for x in ("_sha", "_id", "_doc", "_count", "_row"))
    rows = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    pairs = rows.select(F.col("doc_id").alias(doc), F.col(sha).alias(f"{sha}_")).distinct().orderBy(F.asc_nulls_last(doc), f"{sha}_")
    pairs = materialize(pairs.withColumn(number, F.monotonically_increasing_id()), "minhash-ids")
    rows = rows.join(pairs, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(sha) == F.col(f"{sha}_"))).select(*docs.columns, number)
    rows = materialize(rows, "minhash-rows")
    report = near_components(rows.select(F.col(number).alias("doc_id"), "text"), words, percent)
    kept = report.where("kept").groupBy(F.col("doc_id").alias(number)).agg(F.count(F.lit(1)).alias(count))
    rows = rows.join(materialize(kept, "minhash-kept"), number)
    once = rows.where(F.col(count) == 1).select(*docs.columns)
    again = rows.where(F.col(count) > 1).groupBy(number).agg(F.first(F.struct(*docs.columns)).alias(row))
    return once.union(again.select(f"{row}.*"))
