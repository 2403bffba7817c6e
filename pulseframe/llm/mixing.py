"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The mean number of copies of a document is its source's target share over its actual share. A document's count
is the inverse of the Poisson distribution function at a number hashed from seed and doc_id, so that it depends
on nothing else; the document is exploded by its count and all copies are shuffled by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A larger mean is drawn as a sum of independent equal parts of at most this mean.
LARGEST_PART = 64.0
#: Sources whose table is sent to all executors; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000

BITS = 1 << 52


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(BITS))


def poisson_table(mean: Column) -> Column:
    """Distribution function of Poisson(mean) at 0, 1, ... as an array, up to where less than 2^-52 is left."""
    first = F.exp(-mean)
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, total: float = 1.0) -> DataFrame:
    """source, units, rate: the mean copies of a document of each source.

    Units are code points plus one for each document. The target share of a source is its ``weight`` in
    ``weights(source, weight)`` over the sum (absent: 0), or without ``weights`` its units to the power
    ``alpha`` over the sum; ``total`` scales the size of the mixture in units.
    """
    found = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("units"))
    if weights is None:
        found = found.withColumn("weight", F.pow(F.col("units").cast("double"), F.lit(alpha)))
    else:
        own = weights.select(F.col("source").alias("s"), "weight")
        found = found.join(own, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "units", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    found = materialize(found, "mixing-sources")
    units, weight = found.agg(F.sum("units"), F.sum("weight")).first()
    rate = F.lit(total) * (F.col("weight") / F.lit(weight or 1.0)) * (F.lit(float(units or 0)) / F.col("units").cast("double"))
    return found.select("source", "units", rate.alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 7) -> DataFrame:
    """The columns of ``docs(doc_id, text, source, ...)`` and copy, copies, shuffle_key, a row for each copy.

    ``copies`` is the document's count, ``copy`` numbers them from 1, rows come in the order of ``shuffle_key``
    (MD5 of seed, doc_id and copy) in partitions dealt by its hash. A document of count 0 has no row. A null
    source is a source of its own, a null text has one unit, rows of one doc_id and source get one count. All input
    columns stay; a new column whose name is taken gets underscores before it. An empty table gives an empty result.
    """
    of, n, table, copy, copies, shuffle_key = (fresh(docs, x) for x in ("rate_source", "parts", "cdf", "copy", "copies", "shuffle_key"))
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_PART), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, alpha, total).withColumn("parts", parts)
    rates = rates.select(F.col("source").alias(of), F.col("parts").alias(n), poisson_table(F.col("rate") / F.col("parts")).alias(table))
    rates = materialize(rates, "mixing-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # each number is an element of an array first, so that it is hashed once and not for each entry of the table
    drawn = F.transform(F.sequence(F.lit(1), F.col(n)), lambda j: hashed_unit(F.lit(seed), F.col("doc_id"), j))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(of)))
    counted = joined.withColumn(copies, F.aggregate(drawn, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(table), lambda c: c < u))))
    copied = counted.where(F.col(copies) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy), copies)
    key = F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy).cast("string")))
    return copied.withColumn(shuffle_key, key).repartition(shuffle_key).sortWithinPartitions(shuffle_key)
