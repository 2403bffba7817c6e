"""Queries on streams: windows, nearest boundaries, bounded summaries, histograms, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ, TS
from .timeline import along, after, as_of, before, changes, count, in_parts, number_within, same_parts
from .words import word_ends


def sampled_naive(levels: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, target: int) -> DataFrame:
    """At most ``target`` points of [start, end) by whole strides, given where the value changes; the first always."""
    stride = max(1, -(-(end_ns - start_ns) // target))
    grid = F.explode(F.sequence(F.lit(start_ns).cast("long"), F.lit(end_ns - 1).cast("long"), F.lit(stride).cast("long")))
    points = levels.select(*keys).distinct().select(*keys, grid.alias(TS)).withColumn(SEQ, F.col(TS))
    found = as_of(points, levels, keys, {"value": "value"})
    return changes(found, keys).select(*keys, TS, "value")


def sampled_grid(levels: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, target: int, bucket_ns: int | None = None) -> DataFrame:
    """[start, end) in ``target`` cells, each a Level, an Edge (one change) or Activity (more); equal Levels are joined.

    Columns: kind, start_ns, end_ns, first and last value of the piece.
    """
    span = end_ns - start_ns
    moved = along(levels, keys, {"_start_value": before("value")}, bucket_ns=bucket_ns).where("_start_value is not null and value <> _start_value")
    inside = moved.where((F.col(TS) > start_ns) & (F.col(TS) < end_ns))
    cell = F.least(F.expr(f"div(({TS} - {start_ns}L) * {target}L, {span}L)"), F.lit(target - 1))
    counted = inside.groupBy(*keys, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_start_value", F.struct(TS, SEQ)).alias("first"), F.max_by("value", F.struct(TS, SEQ)).alias("last")
    )
    at = levels.select(*keys).distinct().select(*keys, F.lit(start_ns).cast("long").alias(TS), F.lit(0).cast("long").alias(SEQ))
    initial = as_of(at, levels, keys, {"value": "initial"}, bucket_ns=bucket_ns).select(*keys, "initial")
    return grid_pieces(initial, counted, keys, start_ns, end_ns, target)


def grid_pieces(initial: DataFrame, counted: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, target: int) -> DataFrame:
    """Pieces of a grid from each key's value at its start (``initial``) and the cells with changes (cell, n, first and last value)."""
    span = end_ns - start_ns
    cells = initial.select(*keys, "initial", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("cell"))
    w = Window.partitionBy(*keys).orderBy("cell")
    rows = same_parts(cells, counted, [*keys, "cell"], "left")
    held = F.coalesce(F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "initial")
    rows = rows.withColumn("first", F.coalesce("first", held)).withColumn("last", F.coalesce("last", "first"))
    rows = rows.withColumn("kind", F.when(F.col("n").isNull(), "Level").when(F.col("n") == 1, "Edge").otherwise("Activity"))
    joins = (F.col("kind") == "Level") & (F.lag("kind").over(w) == "Level") & F.lag("last").over(w).eqNullSafe(F.col("first"))
    rows = rows.withColumn("_piece", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    pieces = rows.groupBy(*keys, "_piece").agg(
        F.first("kind").alias("kind"), F.min("cell").alias("a"), F.max("cell").alias("b"), F.min_by("first", "cell").alias("first"), F.max_by("last", "cell").alias("last")
    )
    edge = lambda i: F.lit(start_ns) + F.expr(f"div({i} * {span}L, {target}L)")
    return pieces.select(*keys, "kind", edge("a").alias("start_ns"), edge("(b + 1)").alias("end_ns"), "first", "last")


def rollup(levels: DataFrame, keys: Sequence[str], tier: int, fan: int = 64, bucket_ns: int | None = None) -> DataFrame:
    """Summary of each ``fan ** tier`` consecutive rows: start_ns, end_ns, n, first and last value; the last record may hold fewer."""
    rows = along(levels, keys, {"_n": count(), "_next": after(TS)}, bucket_ns=bucket_ns)
    size = fan**tier
    rows = rows.withColumn("_group", F.expr(f"div(_n - 1, {size}L)")).withColumn("_end", F.coalesce("_next", TS))
    order = F.struct(TS, SEQ)
    return rows.groupBy(*keys, F.col("_group").alias("record")).agg(
        F.min(TS).alias("start_ns"), F.max("_end").alias("end_ns"), F.count(F.lit(1)).alias("n"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last")
    )


def next_tier(records: DataFrame, keys: Sequence[str], fan: int = 64) -> DataFrame:
    """Records of a rollup summed up to those of the next tier, without reading the rows again."""
    group = F.expr(f"div(record, {fan}L)")
    return records.groupBy(*keys, group.alias("record")).agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("n").alias("n"), F.min_by("first", "record").alias("first"), F.max_by("last", "record").alias("last")
    )


def records_between(records: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int) -> DataFrame:
    """The records of a rollup that meet [start, end), and one more on either side of each key's."""
    meets = (F.col("start_ns") < end_ns) & (F.col("end_ns") > start_ns)
    spans = records.where(meets).groupBy(*keys).agg((F.min("record") - 1).alias("_low"), (F.max("record") + 1).alias("_high"))
    return same_parts(records, spans, keys).where(F.col("record").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def pick_tier(rows: int, target: int, fan: int = 64, tiers: int = 3) -> int:
    """The finest tier (0: rows themselves) of at most ``4 * target`` records, else the coarsest."""
    return next((t for t in range(tiers + 1) if rows <= 4 * target * fan**t), tiers)


def exact_window(words: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, most: int, bucket_ns: int | None = None) -> DataFrame:
    """Annotations that meet [start, end], the first ``most`` of each key, and whether these are all."""
    inside = word_ends(words, keys, bucket_ns=bucket_ns).where((F.col(TS) <= end_ns) & (F.col("end_ns") >= start_ns))
    ranked = along(inside, keys, {"_n": count()}, bucket_ns=bucket_ns)
    every = inside.groupBy(*keys).agg((F.count(F.lit(1)) <= most).alias("complete"))
    return same_parts(ranked.where(F.col("_n") <= most).drop("_n"), every, keys)


def word_boundaries(words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Starts and ends of words as events."""
    ends = F.explode(F.array_distinct(F.array(F.col(TS), F.col(TS) + F.col("duration_ns"))))
    return words.select(*keys, ends.alias(TS), SEQ)


def nearest_boundary(probes: DataFrame, boundaries: DataFrame, keys: Sequence[str], within_ns: int | None = None, out: str = "nearest_ns") -> DataFrame:
    """``probes`` with the time of the nearest boundary, the earlier of two equally near, null if none is ``within_ns``."""
    own = boundaries.select(*keys, TS, SEQ, F.col(TS).alias("_at"))
    both = as_of(as_of(probes, own, keys, {"_at": "_before"}), own, keys, {"_at": "_after"}, inclusive=True, forward=True)
    back, ahead = F.col(TS) - F.col("_before"), F.col("_after") - F.col(TS)
    nearest = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    if within_ns is not None:
        nearest = F.when(F.abs(nearest - F.col(TS)) <= within_ns, nearest)
    return both.withColumn(out, nearest).drop("_before", "_after")


def lane_snapshot(levels: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, most: int, bucket_ns: int | None = None) -> DataFrame:
    """Exact rows with the initial level where a key has at most ``most`` changes in [start, end], else its summary grid."""
    inside = changes(levels, keys, bucket_ns=bucket_ns).where((F.col(TS) > start_ns) & (F.col(TS) <= end_ns))
    counts = same_parts(levels.select(*keys).distinct(), inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left")
    few, many = counts.where(F.coalesce("_n", F.lit(0)) <= most), counts.where(F.col("_n") > most)
    at = few.select(*keys, F.lit(start_ns).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ))
    first = as_of(at, levels, keys, {"value": "value"}, bucket_ns=bucket_ns).select(*keys, TS, SEQ, "value")
    exact = first.unionByName(in_parts(inside, few, keys).select(*keys, TS, SEQ, "value"))
    rows = exact.select(*keys, F.lit("Exact").alias("kind"), F.col(TS).alias("start_ns"), F.lit(None).cast("long").alias("end_ns"), F.lit(None).cast("boolean").alias("first"), F.col("value").alias("last"))
    return rows.unionByName(sampled_grid(in_parts(levels, many, keys), keys, start_ns, end_ns, most, bucket_ns))


def presence_histogram(words: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, buckets: int) -> DataFrame:
    """Words that meet each of ``buckets`` parts of [start, end); a word counts in every part that its span meets.

    Parts are ``start + span * i / buckets`` in whole nanoseconds; empty parts have count 0. A word counts +1 in its
    first part and -1 behind its last; the counts are sums over the parts.
    """
    span = end_ns - start_ns
    last = F.col(TS) + F.col("duration_ns")
    inside = words.where((F.col(TS) < end_ns) & (last >= start_ns))
    # part i begins at start + i * span div buckets: the part of x is the last that begins at or before x
    part = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(buckets - 1).cast("long"), F.expr(f"div(({x} - {start_ns}L + 1L) * {buckets}L - 1L, {span}L)")))
    ends = F.array(F.struct(part(TS).alias("bucket"), F.lit(1).cast("long").alias("_d")), F.struct((part("_last") + 1).alias("bucket"), F.lit(-1).cast("long").alias("_d")))
    moves = inside.withColumn("_last", last).select(*keys, F.inline(ends)).groupBy(*keys, "bucket").agg(F.sum("_d").alias("_d"))
    grid = words.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    edge = lambda i: F.lit(start_ns) + F.expr(f"div({i} * {span}L, {buckets}L)")
    counted = F.sum(F.coalesce("_d", F.lit(0).cast("long"))).over(Window.partitionBy(*keys).orderBy("bucket"))
    return same_parts(grid, moves, [*keys, "bucket"], "left").select(*keys, "bucket", edge("bucket").alias("start_ns"), edge("(bucket + 1)").alias("end_ns"), counted.alias("n_words"))


def decoder_table(anchors: DataFrame, children: DataFrame, keys: Sequence[str], most_rows: int | None = None, most_children: int = 4096, bucket_ns: int | None = None) -> DataFrame:
    """Anchor words with the values of the children that start within them, in order.

    ``truncated`` tells if rows were left out. An anchor with more than ``most_children`` children has several rows,
    numbered by ``part`` from 0, so that no list grows without bound.
    """
    spans = anchors.withColumns({"_start": F.col(TS), "_seq": F.col(SEQ), "_end": F.col(TS) + F.col("duration_ns")})
    own = as_of(children.select(*keys, TS, SEQ, "value"), spans, keys, {"_start": "_start", "_seq": "_seq", "_end": "_end"}, bucket_ns=bucket_ns).where(F.col(TS) < F.col("_end"))
    place = F.struct("_start", "_seq")
    own = along(own, keys, {"_last": before(place)}, bucket_ns=bucket_ns)
    own = number_within(own, keys, ~place.eqNullSafe(F.col("_last")), "_k", (), bucket_ns).withColumn("part", F.expr(f"div(_k, {most_children}L)"))
    lists = own.groupBy(*keys, "_start", "_seq", "part").agg(F.sort_array(F.collect_list(F.struct(TS, SEQ, "value"))).alias("_c"))
    lists = lists.select(*keys, F.col("_start").alias(TS), F.col("_seq").alias(SEQ), "part", F.transform("_c", lambda x: x["value"]).alias("children"))
    kept, every = anchors, None
    if most_rows is not None:
        kept = along(anchors, keys, {"_n": count()}, bucket_ns=bucket_ns).where(F.col("_n") <= most_rows).drop("_n")
        every = anchors.groupBy(*keys).agg((F.count(F.lit(1)) > most_rows).alias("truncated"))
    rows = same_parts(kept, lists, [*keys, TS, SEQ], "left")
    rows = rows.withColumns({"part": F.coalesce("part", F.lit(0).cast("long")), "children": F.coalesce("children", F.array().cast("array<bigint>"))})
    return rows.withColumn("truncated", F.lit(False)) if every is None else same_parts(rows, every, keys)


def extent(words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest end of each key."""
    return words.groupBy(*keys).agg(F.max(F.col(TS) + F.col("duration_ns")).alias("extent_ns"))


def last_values(levels: DataFrame, keys: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """Every row with the value before it and the number of rows so far."""
    return along(levels, keys, {"before": before("value"), "n": count()}, bucket_ns=bucket_ns)
