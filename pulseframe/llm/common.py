"""Helpers shared by the corpus operators: tables, shared folders, held-out rows, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Where that setting is empty the session's checkpoint folder is used; on a local master without one, as in
    tests, a temporary one is set. On a cluster that raises, since executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path``) and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true sizes, so that a join broadcasts
    a side only if its files are smaller than ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`materialize` wrote and that no table reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has no column of, whatever its letters' case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def is_learnable(doc_id: Column) -> Column:
    """The complement among rows that have a doc_id."""
    return F.coalesce(remainder(doc_id) != 1, F.lit(False))


def unit_hash(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only; used to take bounded learning samples."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; component = the smallest node reachable.

    Rounds of a large-star and a small-star step until one changes nothing; a round at least halves what is off on
    a chain, so that their number grows with the logarithm of the longest one. Each step is a map-side combined minimum for each node and a
    join back, so a hub of any degree is only ever summed or split by the skew-join rule. Every round is written
    to the shared folder, and the one before it deleted.
    """
    spark, a, b = edges.sparkSession, F.col("a"), F.col("b")
    folder = shared_folder(spark, "components")
    edges = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "", f"{folder}/round-0")
    nodes = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "", f"{folder}/nodes")
    before, number = None, 0
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(low.select("a", F.col("m").alias("b"))).where(a != b).distinct(), "", f"{folder}/round-{number + 1}")
        discard(spark, f"{folder}/round-{number}")
        number += 1
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.select(a.alias("node"), b.alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
