"""Summaries of a level stream in stored tiers, appended to as it grows, and queries that read them in place of rows.

A record sums up a key's rows in one time slot: first and last time and value, rows, and changes between them. Records are
joined in time order, a change between two counting once, so a window is put together from the coarsest records that lie
within its cells, finer ones where a cell ends, and rows in the finest slots that a cell's end divides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unsigned import floor_div
from ..schema import SEQ, TS, StreamError
from .retrieval import grid_pieces
from .timeline import as_of, in_parts, same_parts

RECORD = ("first_ns", "first_seq", "last_ns", "n", "toggles", "first", "last")


@dataclass(frozen=True)
class Tiers:
    """Where tiers are stored and how wide their slots are: ``slot_ns * fan ** tier``, tiers from 0 to ``top``.

    ``folder`` is shared by all executors. Rows are stored in folders of ``slot_ns * fan`` each, a record table in folders of the
    coarsest slots. Values are not null, and what is appended lies behind what is there, key by key.
    """

    folder: str
    keys: tuple[str, ...]
    slot_ns: int
    fan: int = 64
    top: int = 3

    def width(self, tier: int) -> int:
        return self.slot_ns * self.fan**tier

    def table(self, tier: int | None) -> str:
        return f"{self.folder}/{'rows' if tier is None else f'tier-{tier}'}"


def folded(levels: DataFrame, keys: Sequence[str], slot_ns: int) -> DataFrame:
    """keys, slot and the record of each key's rows in each slot that has any."""
    rows = levels.select(*keys, floor_div(F.col(TS), slot_ns).alias("slot"), TS, SEQ, "value")
    moved = F.lag("value").over(Window.partitionBy(*keys, "slot").orderBy(TS, SEQ)) != F.col("value")
    order = F.struct(TS, SEQ)
    return rows.withColumn("_moved", moved).groupBy(*keys, "slot").agg(
        F.min(order).alias("_f"), F.max(TS).alias("last_ns"), F.count(F.lit(1)).alias("n"), F.count_if("_moved").alias("toggles"),
        F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"),
    ).select(*keys, "slot", F.col(f"_f.{TS}").alias("first_ns"), F.col(f"_f.{SEQ}").alias("first_seq"), *RECORD[2:])


def joined(records: DataFrame, keys: Sequence[str], slot: Column) -> DataFrame:
    """Records joined to those of wider slots, ``slot`` giving the number of the wide one."""
    rows = records.withColumn("_wide", slot)
    moved = F.lag("last").over(Window.partitionBy(*keys, "_wide").orderBy("first_ns", "first_seq")) != F.col("first")
    order = F.struct("first_ns", "first_seq")
    return rows.withColumn("_moved", moved).groupBy(*keys, "_wide").agg(
        F.min(order).alias("_f"), F.max("last_ns").alias("last_ns"), F.sum("n").alias("n"), (F.sum("toggles") + F.count_if("_moved")).alias("toggles"),
        F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last"),
    ).select(*keys, F.col("_wide").alias("slot"), "_f.first_ns", "_f.first_seq", *RECORD[2:])


def append_tiers(levels: DataFrame, store: Tiers, batch: int, groups: int = 64) -> None:
    """Add ``levels`` (keys, ts_ns, seq, value) to a store as batch number ``batch``: rows, their records, and a mark that both are there.

    Batches are counted from 0 and come one after the other; a batch that comes again replaces itself and what came before isn't
    read. Without its mark a batch isn't read, so it fits ``foreachBatch`` as it is. A part of time is written by up to ``groups`` tasks, dealt by key.
    """
    own = [*store.keys]
    if clash := {"part", "batch", "slot", "_wide", *RECORD} & set(own):
        raise StreamError(f"keys {sorted(clash)} have names of the store's own columns")
    part = floor_div(F.col(TS), store.width(1))
    deal = F.pmod(F.hash(*own), F.lit(groups)) if own else F.lit(0)
    rows = levels.select(*own, TS, SEQ, "value", part.alias("part"))
    path = f"{store.table(None)}/batch={batch}"
    rows.repartition("part", deal).sortWithinPartitions("part", *own, TS, SEQ).write.partitionBy("part").mode("overwrite").parquet(path)
    spark = levels.sparkSession
    below = folded(spark.read.schema(rows.schema).parquet(path), own, store.slot_ns)
    for tier in range(store.top + 1):
        if tier:
            below = joined(below, own, floor_div(F.col("slot"), store.fan))
        path = f"{store.table(tier)}/batch={batch}"
        whole = below.withColumn("part", floor_div(F.col("slot"), store.fan ** (store.top - tier)))
        whole.repartition("part", deal).sortWithinPartitions("part", *own, "slot").write.partitionBy("part").mode("overwrite").parquet(path)
        below = spark.read.schema(whole.schema).parquet(path).drop("part")
    spark.range(1).select(F.lit(batch).alias("number")).write.mode("overwrite").parquet(f"{store.folder}/marks/batch={batch}")


def stored(spark: SparkSession, store: Tiers, tier: int | None, levels: T.StructType) -> DataFrame:
    """Marked rows (``tier`` None) or records of a store; ``levels`` gives the types of keys and values."""
    value = levels["value"].dataType
    kinds = {"slot": T.LongType(), "first_ns": T.LongType(), "first_seq": T.LongType(), "last_ns": T.LongType(), "n": T.LongType(), "toggles": T.LongType(), "first": value, "last": value}
    fields = {TS: T.LongType(), SEQ: T.LongType(), "value": value} if tier is None else kinds
    schema = T.StructType([*(levels[k] for k in store.keys), *(T.StructField(n, t) for n, t in fields.items()), T.StructField("part", T.LongType()), T.StructField("batch", T.LongType())])
    last = spark.read.schema("number long, batch long").parquet(f"{store.folder}/marks").agg(F.max("batch")).first()[0]
    if last is None:
        raise StreamError(f"nothing is stored in {store.folder}")
    return spark.read.schema(schema).option("basePath", store.table(tier)).parquet(store.table(tier)).where(F.col("batch") <= last).drop("batch")


def pieces_of(spark: SparkSession, store: Tiers, levels: T.StructType, ends: Sequence[int]) -> DataFrame:
    """Records that put together the stretches between the times ``ends``: keys, cell and a record.

    Stretch -1 is what lies before ``ends[0]``, stretch i from ``ends[i]`` to below ``ends[i + 1]``; what lies behind the last is left out. A slot that
    no end divides is read as its coarsest record; of rows only the folders of divided finest slots are read. ``ends`` are a bounded list, as a grid's cells are.
    """
    ends = sorted(set(ends))
    found = None
    # slots of each tier, from the coarsest, that an end divides: only what lies in these is read from the next finer one
    divided: list[int] | None = None
    at = F.array(*(F.lit(x).cast("long") for x in ends))
    for tier in [*range(store.top, -1, -1), None]:
        table = stored(spark, store, tier, levels)
        if divided is not None:
            above = store.width(0 if tier is None else tier + 1)
            per_part = store.width(1 if tier is None else store.top)
            parts = sorted({slot * above // per_part for slot in divided})
            place = F.col(TS) if tier is None else F.col("slot") * store.width(tier)
            table = table.where(F.col("part").isin(parts) & floor_div(place, above).isin(divided))
        if tier is None:
            begin = F.col(TS)
            own = table.select(*store.keys, begin.alias("_begin"), begin.alias("first_ns"), F.col(SEQ).alias("first_seq"), begin.alias("last_ns"),
                               F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("toggles"), F.col("value").alias("first"), F.col("value").alias("last"))
        else:
            width = store.width(tier)
            divided = sorted({x // width for x in ends if x % width})
            own = table.where(~F.col("slot").isin(divided)) if divided else table
            own = own.select(*store.keys, (F.col("slot") * width).alias("_begin"), *RECORD)
        own = own.where(F.col("_begin") < ends[-1])
        found = own if found is None else found.unionByName(own)
        if not divided and tier is not None:
            break
    return found.withColumn("cell", F.size(F.filter(at, lambda x: x <= F.col("_begin"))) - 1).drop("_begin")


def counted_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cell, n (changes), first (value before the first change in the cell) and last value, for every cell with rows."""
    w = Window.partitionBy(*keys).orderBy("first_ns", "first_seq")
    rows = pieces.withColumn("_held", F.lag("last").over(w))
    moves = F.col("toggles") + F.coalesce((F.col("_held") != F.col("first")).cast("long"), F.lit(0).cast("long"))
    order = F.struct("first_ns", "first_seq")
    return rows.withColumn("_moves", moves).groupBy(*keys, "cell").agg(
        F.sum("_moves").alias("n"), F.min_by(F.coalesce("_held", "first"), order).alias("first"), F.max_by("last", order).alias("last")
    )


def grid_of_tiers(spark: SparkSession, store: Tiers, levels: T.StructType, start_ns: int, end_ns: int, target: int) -> DataFrame:
    """As ``retrieval.sampled_grid`` over all stored rows, from tiers.

    At most ``target + 1`` slots of each tier are looked into; what is read grows with them and the coarsest tier, not with the rows.
    """
    span = end_ns - start_ns
    # cell i of a change at t is (t - start) * target div span, so it begins at the least such t; what is at start itself is held before
    ends = [start_ns + 1, *(start_ns - (-i * span // target) for i in range(1, target)), end_ns]
    cells = counted_pieces(pieces_of(spark, store, levels, ends), store.keys)
    number = F.element_at(F.array(*(F.lit(min((x - start_ns) * target // span, target - 1)) for x in sorted(set(ends))[:-1])), (F.col("cell") + 1).cast("int"))
    inside = cells.where("cell >= 0 and n > 0").select(*store.keys, number.alias("cell"), "n", "first", "last")
    every = stored(spark, store, store.top, levels).select(*store.keys).distinct()
    held = cells.where("cell = -1").select(*store.keys, F.col("last").alias("initial"))
    return grid_pieces(same_parts(every, held, store.keys, "left"), inside, store.keys, start_ns, end_ns, target)


def snapshot_of_tiers(spark: SparkSession, store: Tiers, levels: T.StructType, start_ns: int, end_ns: int, most: int) -> DataFrame:
    """As ``retrieval.lane_snapshot`` over all stored rows: tiers tell which keys have few changes, and only their rows are read."""
    keys = store.keys
    cells = counted_pieces(pieces_of(spark, store, levels, [start_ns + 1, end_ns + 1]), keys)
    every = stored(spark, store, store.top, levels).select(*keys).distinct()
    held = cells.where("cell = -1").select(*keys, F.col("last").alias("_held"))
    counts = same_parts(same_parts(every, held, keys, "left"), cells.where("cell = 0").select(*keys, F.col("n").alias("_n")), keys, "left")
    # a key's first row counts as a change
    counts = counts.withColumn("_n", F.col("_n") + F.col("_held").isNull().cast("long"))
    few, many = counts.where(F.coalesce("_n", F.lit(0)) <= most), counts.where(F.col("_n") > most)
    parts = F.col("part").between(start_ns // store.width(1), end_ns // store.width(1))
    rows = stored(spark, store, None, levels).where(parts & (F.col(TS) > start_ns) & (F.col(TS) <= end_ns)).drop("part")
    rows = in_parts(rows, few.select(*keys), keys)
    before = same_parts(rows, few.select(*keys, "_held"), keys)
    moved = F.coalesce(F.lag("value").over(Window.partitionBy(*keys).orderBy(TS, SEQ)), "_held")
    kept = before.withColumn("_was", moved).where(F.col("_was").isNull() | (F.col("_was") != F.col("value")))
    value = levels["value"].dataType
    exact = few.select(*keys, F.lit(start_ns).cast("long").alias("start_ns"), F.col("_held").alias("last")).unionByName(kept.select(*keys, F.col(TS).alias("start_ns"), F.col("value").alias("last")))
    exact = exact.select(*keys, F.lit("Exact").alias("kind"), "start_ns", F.lit(None).cast("long").alias("end_ns"), F.lit(None).cast(value).alias("first"), "last")
    return exact.unionByName(in_parts(grid_of_tiers(spark, store, levels, start_ns, end_ns, most), many.select(*keys), keys))


def next_edge_of_tiers(spark: SparkSession, store: Tiers, levels: T.StructType, probes: DataFrame, most_parts: int = 1000) -> DataFrame:
    """As ``levels.next_edge`` over all stored rows, for few probes.

    The finest records are a map of the slots that hold an edge. The edge behind a probe lies in the last of these that begins at or before it, or in
    the next one; only these slots' rows are read and sorted. Where they lie in at most ``most_parts`` row folders, the scan is given the list of these; else
    it is left to the join, with the same result.
    """
    keys = [*store.keys]
    slots = joined(stored(spark, store, 0, levels).drop("part"), keys, F.col("slot"))
    slots = slots.withColumn("_held", F.lag("last").over(Window.partitionBy(*keys).orderBy("slot")))
    place = F.struct("slot", "last_ns", "_held")
    zones = slots.where((F.col("toggles") > 0) | (F.col("_held") != F.col("first"))).select(*keys, F.col("first_ns").alias(TS), F.col("first_seq").alias(SEQ), place.alias("_zone"))
    asked = probes.select(*keys, TS, SEQ).distinct()
    near = as_of(as_of(asked, zones, keys, {"_zone": "_own"}), zones, keys, {"_zone": "_next"}, inclusive=False, forward=True)
    own = F.when(F.col("_own.last_ns") > F.col(TS), F.col("_own"))
    wanted = near.select(*keys, F.explode(F.array_compact(F.array(own, F.col("_next")))).alias("_z")).select(*keys, "_z.slot", "_z._held").distinct()
    rows = stored(spark, store, None, levels)
    parts = [r[0] for r in wanted.select(floor_div(F.col("slot"), store.fan)).distinct().limit(most_parts + 1).collect()]
    if len(parts) <= most_parts:
        rows = rows.where(F.col("part").isin(parts))
    rows = same_parts(rows.drop("part").withColumn("slot", floor_div(F.col(TS), store.slot_ns)), wanted, [*keys, "slot"])
    was = F.coalesce(F.lag("value").over(Window.partitionBy(*keys, "slot").orderBy(TS, SEQ)), "_held")
    moved = rows.withColumn("_was", was).where(F.col("_was") != F.col("value"))
    edges = moved.select(*keys, TS, SEQ, F.col(TS).alias("edge_ns"), F.col("value").alias("edge_value"))
    return as_of(probes, edges, keys, {"edge_ns": "edge_ns", "edge_value": "edge_value"}, inclusive=False, forward=True)
