"""Operators on level streams: values that hold from one row to the next of their key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unsigned import floor_div
from ..schema import SEQ, TS, StreamError, require
from .timeline import after, along, as_of, before, changes, count, greedy, in_parts, merged, next_one, same_parts, with_initial


def value_at(levels: DataFrame, probes: DataFrame, keys: Sequence[str] = (), bucket_ns: int | None = None) -> DataFrame:
    """``probes`` with the level's ``value`` at their times; the last row holds forever, null before the first."""
    return as_of(probes, levels, keys, {"value": "value"}, bucket_ns=bucket_ns)


def next_edge(levels: DataFrame, probes: DataFrame, keys: Sequence[str] = (), limit_ns: Column | None = None, bucket_ns: int | None = None) -> DataFrame:
    """``probes`` with time and new value of the first transition strictly after them, and before ``limit_ns``."""
    edges = transitions(levels, keys, bucket_ns).select(*keys, TS, SEQ, F.col(TS).alias("edge_ns"), F.col("value").alias("edge_value"))
    found = as_of(probes, edges, keys, {"edge_ns": "edge_ns", "edge_value": "edge_value"}, inclusive=False, forward=True, bucket_ns=bucket_ns)
    if limit_ns is None:
        return found
    inside = F.col("edge_ns") < limit_ns
    return found.withColumns({c: F.when(inside, F.col(c)) for c in ("edge_ns", "edge_value")})


def next_edges(levels: DataFrame, keys: Sequence[str], after_ns: int, limit_ns: int, most: int, bucket_ns: int | None = None) -> DataFrame:
    """The first ``most`` transitions of each key strictly after one time and before another."""
    inside = transitions(levels, keys, bucket_ns).where((F.col(TS) > after_ns) & (F.col(TS) < limit_ns))
    return along(inside, keys, {"_n": count()}, bucket_ns=bucket_ns).where(F.col("_n") <= most).drop("_n")


def transitions(levels: DataFrame, keys: Sequence[str] = (), bucket_ns: int | None = None) -> DataFrame:
    """Rows that change the value; the first row of a key is only where it starts."""
    rows = along(levels, keys, {"_last": before(F.struct(F.col("value").alias("v")))}, bucket_ns=bucket_ns)
    return rows.where(F.col("_last").isNotNull() & ~F.col("value").eqNullSafe(F.col("_last.v"))).drop("_last")


def edges(levels: DataFrame, keys: Sequence[str] = (), mode: str = "both", debounce_ns: int = 0, min_pulse_ns: int = 0, bucket_ns: int | None = None) -> DataFrame:
    """Edge events of one direction or both.

    An edge counts if the level before it lasted at least ``min_pulse_ns``, measured from the change before,
    counted or not, and it comes at least ``debounce_ns`` after the edge that was emitted last.
    """
    if mode not in ("rising", "falling", "both"):
        raise StreamError(f"unknown mode {mode}")
    require(levels, keys, "value")
    clean = along(changes(levels, keys, bucket_ns=bucket_ns), keys, {"_before": before(TS)}, bucket_ns=bucket_ns)
    wanted = {"rising": F.col("value"), "falling": ~F.col("value"), "both": F.lit(True)}[mode]
    ok = clean.where(F.col("_before").isNotNull() & wanted & (F.col(TS) - F.col("_before") >= min_pulse_ns)).select(*keys, TS, SEQ)
    return greedy(ok, keys, debounce_ns, bucket_ns=bucket_ns) if debounce_ns else ok


def gate_of(values: list[Column], operation: str) -> Column:
    """NOT, AND, NAND, OR, NOR, XOR (odd number high) or XNOR of boolean columns."""
    high = sum((v.cast("int") for v in values[1:]), values[0].cast("int"))
    plain = {"NOT": high == 0, "AND": high == len(values), "OR": high > 0, "XOR": high % 2 == 1}
    inverse = {"NAND": "AND", "NOR": "OR", "XNOR": "XOR"}
    return plain[operation] if operation in plain else ~plain[inverse[operation]]


def logic_gate(inputs: Sequence[DataFrame], keys: Sequence[str], operation: str, coalesce_ties: bool = False, t0: int = 0, bucket_ns: int | None = None) -> DataFrame:
    """The combined level of several: initial row at ``t0``, then a row whenever the output changes.

    Inputs start low and are merged one change at a time, lower inputs first, so opposite changes at one time can
    give a level of no width; ``coalesce_ties`` keeps only what an instant ends with. ``seq`` numbers the merged rows.
    """
    if operation == "NOT" and len(inputs) != 1:
        raise StreamError("NOT takes one input")
    rows = merged([changes(x, keys, bucket_ns=bucket_ns) for x in inputs], keys, bucket_ns=bucket_ns)
    rows = rows.withColumn("value", gate_of([F.col(f"v{i}") for i in range(len(inputs))], operation)).select(*keys, TS, SEQ, "_input", "value")
    if coalesce_ties:
        rows = along(rows, keys, {"_next": after(TS)}, ["_input"], bucket_ns)
        rows = rows.where(F.col("_next").isNull() | (F.col("_next") != F.col(TS))).drop("_next")
    initial = gate_of([F.lit(False)] * len(inputs), operation)
    found = along(rows, keys, {"_before": before("value"), "_n": count()}, ["_input"], bucket_ns)
    moved = found.where(F.col("value") != F.coalesce("_before", initial)).select(*keys, TS, F.col("_n").alias(SEQ), "value")
    every = inputs[0].select(*keys)
    for other in inputs[1:]:
        every = every.union(other.select(*keys))
    first = every.distinct().select(*keys, F.lit(t0).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ), initial.alias("value"))
    return first.unionByName(moved)


def activity(levels: DataFrame, keys: Sequence[str], step_ns: int, total: int | None = None, group: int = 64, bucket_ns: int | None = None) -> DataFrame:
    """By key: share of sample groups that hold a transition, and share whose last sample is high, as fractions.

    Positions are times over ``step_ns``, from 0 below ``total``; without ``total`` the capture ends with the last
    position of any key. Counts and not samples are gathered: the high groups of a level's run are computed from
    where it begins and ends.
    """
    at = floor_div(F.col(TS), step_ns)
    if total is None:
        levels = levels.crossJoin(F.broadcast(levels.agg((F.max(at) + 1).cast("long").alias("_total"))))
    else:
        levels = levels.withColumn("_total", F.lit(total).cast("long"))
    whole = F.col("_total")
    groups = F.ceil(whole / group).cast("long")
    position = F.least(at, whole)
    moved = transitions(levels, keys, bucket_ns).where(position < whole).select(*keys, F.floor(position / group).alias("g")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("active"))
    runs = along(changes(levels, keys, bucket_ns=bucket_ns), keys, {"_next": after(TS)}, bucket_ns=bucket_ns)
    runs = runs.withColumn("_end", F.least(F.coalesce(floor_div(F.col("_next"), step_ns), whole), whole)).where("value and _end > 0")
    # the last sample of group g is at (g + 1) * group - 1, or at total - 1 for the last group
    lasts_below = lambda p: F.floor(p / group) + F.when((p >= whole) & (whole % group != 0), 1).otherwise(0)
    high = runs.groupBy(*keys).agg(F.sum(lasts_below(F.col("_end")) - lasts_below(position)).alias("high"))
    every = levels.select(*keys, "_total").distinct()
    counted = same_parts(same_parts(every, moved, keys, "left"), high, keys, "left")
    return counted.select(
        *keys,
        F.coalesce("active", F.lit(0)).cast("long").alias("active_groups"),
        F.coalesce("high", F.lit(0)).cast("long").alias("high_groups"),
        groups.alias("groups"),
        (F.coalesce("active", F.lit(0)) / groups).alias("activity_ratio"),
        (F.coalesce("high", F.lit(0)) / groups).alias("high_ratio"),
    )


def marker_relation(base: DataFrame, keys: Sequence[str], marker_ns: int, relation: str, t0: int = 0) -> DataFrame:
    """Level of each key of ``base``: high before the marker, or from it on (``at_or_after``)."""
    if relation not in ("before", "at_or_after"):
        raise StreamError(f"unknown relation {relation}")
    rows = [(t0, 0, (relation == "at_or_after") == (marker_ns <= t0))] + ([(marker_ns, 1, relation == "at_or_after")] if marker_ns > t0 else [])
    return _literal_rows(base, keys, rows)


def marker_window(base: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, t0: int = 0) -> DataFrame:
    """Level of each key of ``base`` that is high in [start, end)."""
    if start_ns > end_ns:
        raise StreamError("the window ends before it starts")
    if start_ns == end_ns or end_ns <= t0:
        rows = [(t0, 0, False)]
    else:
        rows = ([(t0, 0, False)] if start_ns > t0 else []) + [(max(start_ns, t0), 1, True), (end_ns, 2, False)]
    return _literal_rows(base, keys, rows)


def _literal_rows(base: DataFrame, keys: Sequence[str], rows: list[tuple[int, int, bool]]) -> DataFrame:
    held = F.array(*(F.struct(F.lit(t).cast("long").alias(TS), F.lit(s).cast("long").alias(SEQ), F.lit(v).alias("value")) for t, s, v in rows))
    return base.select(*keys).distinct().select(*keys, F.inline(held))


def marker_event(base: DataFrame, keys: Sequence[str], marker_ns: int) -> DataFrame:
    """One event at the marker for each key of ``base``."""
    return base.select(*keys).distinct().select(*keys, F.lit(marker_ns).cast("long").alias(TS), F.lit(0).cast("long").alias(SEQ))


def cursor_event(base: DataFrame, markers: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One event at the marker ``name`` of the named times ``markers(keys..., name, marker_ns)`` for each key of ``base``; none where a key has no such marker."""
    own = markers.where(F.col("name") == name).groupBy(*keys).agg(F.max("marker_ns").cast("long").alias(TS))
    return in_parts(own, base, keys).select(*keys, TS, F.lit(0).cast("long").alias(SEQ))


def pulse_widths(levels: DataFrame, keys: Sequence[str] = (), bucket_ns: int | None = None) -> DataFrame:
    """One row for each high level that has ended: its start and ``width_ns``."""
    clean = along(changes(levels, keys, bucket_ns=bucket_ns), keys, {"_next": after(TS)}, bucket_ns=bucket_ns)
    return clean.where("value and _next is not null").select(*keys, TS, SEQ, (F.col("_next") - F.col(TS)).alias("width_ns"))


def pulses_at(levels: DataFrame, probes: DataFrame, keys: Sequence[str] = (), bucket_ns: int | None = None) -> DataFrame:
    """``probes`` with the run that holds at their time: value, start and end, width, period, and duty in millionths.

    The period goes to the second next edge. What has no end is null.
    """
    runs = along(changes(levels, keys, bucket_ns=bucket_ns), keys, {"_end": after(TS)}, bucket_ns=bucket_ns)
    runs = along(runs, keys, {"_second": after("_end")}, bucket_ns=bucket_ns).withColumn("_start", F.col(TS))
    found = as_of(probes, runs, keys, {"value": "value", "_start": "start_ns", "_end": "end_ns", "_second": "second_ns"}, bucket_ns=bucket_ns)
    width, period = F.col("end_ns") - F.col("start_ns"), F.col("second_ns") - F.col("start_ns")
    return found.withColumns(
        {"width_ns": width, "period_ns": period, "duty_ppm": F.call_function("div", width.cast("decimal(19,0)") * F.lit(1_000_000).cast("decimal(7,0)"), period)}
    ).drop("second_ns")


def edge_delta(levels: DataFrame, pairs: DataFrame, keys: Sequence[str] = (), a: str = "a_ns", b: str = "b_ns") -> DataFrame:
    """``pairs`` with both times moved to the nearest edge (the earlier of two equally near), their distance, and 1/distance in Hz."""
    from .retrieval import nearest_boundary

    steps = transitions(levels, keys).select(*keys, TS, SEQ)
    rows = pairs
    for column in (a, b):
        own = rows.withColumnRenamed(column, TS).withColumn(SEQ, F.lit(0).cast("long"))
        rows = nearest_boundary(own, steps, keys, None, f"snapped_{column}").drop(SEQ).withColumnRenamed(TS, column)
    delta = F.abs(F.col(f"snapped_{b}") - F.col(f"snapped_{a}"))
    return rows.withColumn("delta_ns", delta).withColumn("frequency_hz", F.when(delta > 0, 1e9 / delta))


def forward_value(levels: DataFrame, keys: Sequence[str], value: bool, bucket_ns: int | None = None) -> DataFrame:
    """Every row with the time of the next row, itself included, that has ``value``."""
    return along(levels, keys, {"next_ns": next_one(F.when(F.col("value") == value, F.col(TS)))}, bucket_ns=bucket_ns)


__all__ = [
    "activity", "changes", "cursor_event", "edge_delta", "edges", "forward_value", "logic_gate", "marker_event", "marker_relation", "marker_window",
    "next_edge", "next_edges", "pulse_widths", "pulses_at", "transitions", "value_at", "with_initial",
]
