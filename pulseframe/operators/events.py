"""Operators on event streams: instants without payload."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEQ, TS, require
from .timeline import along, as_of, before, count, greedy, held_off, highest, last_part, number_within, part_codes, scan_sorted, total


def event_gate(events: DataFrame, gate: DataFrame, keys: Sequence[str] = (), active_high: bool = True, bucket_ns: int | None = None) -> DataFrame:
    """Events while the gate is active. The gate starts low; a gate change at an event's time comes first.

    ``bucket_ns`` divides long timelines among tasks (see ``timeline.as_of``).
    """
    open_ = F.coalesce("_gate", F.lit(False)) == F.lit(active_high)
    return as_of(events, gate, keys, {"value": "_gate"}, bucket_ns=bucket_ns).where(open_).drop("_gate")


def event_control(
    events: DataFrame, keys: Sequence[str] = (), delay_ns: int = 0, holdoff_ns: int = 0, rearms: DataFrame | None = None, bucket_ns: int | None = None
) -> DataFrame:
    """Events thinned by hold-off and, with ``rearms``, by an arm that each accepted event spends; emitted ``delay_ns`` later.

    The hold-off runs from the time before delay. A rearm at an event's time comes first. Events start armed.
    """
    require(events, keys)
    if rearms is None:
        kept = greedy(events, keys, holdoff_ns, bucket_ns=bucket_ns) if holdoff_ns else events
    else:
        both = events.withColumn("_side", F.lit(1)).unionByName(rearms.select(*keys, TS, SEQ).withColumn("_side", F.lit(0)), allowMissingColumns=True)
        if not holdoff_ns:
            both = number_within(both, keys, F.col("_side") == 0, "_n", ["_side"], bucket_ns, counted=F.col("_side") == 1)
            kept = both.where("_side = 1 and _n = 0").select(*events.columns)
        else:
            kept = _armed_holdoff(both, keys, holdoff_ns, bucket_ns).select(*events.columns)
    return kept.withColumn(TS, F.col(TS) + delay_ns)


def restarts(both: DataFrame, keys: Sequence[str], at: str, holdoff_ns: int, bucket_ns: int | None) -> DataFrame:
    """``both`` sides with ``_piece``: a rearm (side 0) at least the hold-off after every event before it starts anew."""
    rows = along(both, keys, {"_highest": highest(F.when(F.col("_side") == 1, F.col(at)))}, ["_side"], bucket_ns)
    cut = (F.col("_side") == 0) & (F.col("_highest").isNull() | (F.col(TS) >= F.col("_highest") + holdoff_ns))
    return along(rows.withColumn("_cut", cut), keys, {"_piece": total("_cut")}, ["_side"], bucket_ns).drop("_highest", "_cut")


def _armed_holdoff(both: DataFrame, keys: Sequence[str], holdoff_ns: int, bucket_ns: int | None) -> DataFrame:
    """Both rules at once: a scan of each piece, from one accepted event to the next by binary search; with buckets by their maps."""
    if bucket_ns is not None:
        return held_off(both, keys, F.lit(holdoff_ns), bucket_ns, rearmed=True)
    rows = restarts(both, keys, TS, holdoff_ns, bucket_ns)
    names, parts = list(rows.columns), [*keys, "_piece"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, armed, allowed = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ts, side = (batch.column(names.index(c)).to_numpy() for c in (TS, "_side"))
            new = part_codes(batch, parts)
            new[0] = last_part(batch, parts, 0) != part
            take = np.zeros(batch.num_rows, bool)
            edges = [*([] if new[0] else [0]), *np.flatnonzero(new), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if new[a]:
                    armed, allowed = True, None
                events, rearms = a + np.flatnonzero(side[a:b] == 1), a + np.flatnonzero(side[a:b] == 0)
                i = a
                while i < b:
                    if not armed:
                        k = np.searchsorted(rearms, i)
                        if k == len(rearms):
                            break
                        i, armed = int(rearms[k]), True
                    late = i if allowed is None else max(i, a + int(np.searchsorted(ts[a:b], allowed)))
                    k = np.searchsorted(events, late)
                    if k == len(events):
                        break
                    i = int(events[k])
                    take[i], armed, allowed = True, False, ts[i] + holdoff_ns
                    i += 1
            part = last_part(batch, parts, batch.num_rows - 1)
            yield batch.filter(pa.array(take))

    return scan_sorted(rows, parts, [TS, "_side", SEQ], choose, rows.schema)


def event_counter(events: DataFrame, keys: Sequence[str] = (), start: int = 0, step: int = 1, t0: int = 0, bucket_ns: int | None = None) -> DataFrame:
    """Number level: ``start`` at ``t0``, then ``start + n * step`` at the n-th event."""
    require(events, keys)
    counted = along(events.select(*keys, TS, SEQ), keys, {"_n": count()}, bucket_ns=bucket_ns)
    first = events.select(*keys).distinct().select(*keys, F.lit(t0).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ), F.lit(start).cast("long").alias("value"))
    return first.unionByName(counted.select(*keys, TS, SEQ, (F.col("_n") * step + start).cast("long").alias("value")))


def sr_latch(sets: DataFrame, resets: DataFrame, keys: Sequence[str] = (), initial: bool = False, t0: int = 0, bucket_ns: int | None = None) -> DataFrame:
    """Level that sets turn high and resets low; sets come first at one time, so that both together end low.

    Starts with ``initial`` at ``t0``; rows follow only where the state changes. ``seq`` numbers the merged inputs.
    """
    both = sets.select(*keys, TS, SEQ, F.lit(True).alias("value"), F.lit(0).alias("_side"))
    both = both.unionByName(resets.select(*keys, TS, SEQ, F.lit(False).alias("value"), F.lit(1).alias("_side")))
    found = along(both, keys, {"_before": before("value"), "_n": count()}, ["_side"], bucket_ns)
    moved = found.where(F.col("value") != F.coalesce("_before", F.lit(initial))).select(*keys, TS, F.col("_n").alias(SEQ), "value")
    first = both.select(*keys).distinct().select(*keys, F.lit(t0).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ), F.lit(initial).alias("value"))
    return first.unionByName(moved)


def pulse_lane(events: DataFrame, keys: Sequence[str] = (), pulse_ns: int = 1000, t0: int = 0, bucket_ns: int | None = None) -> DataFrame:
    """Level with a pulse at each event, low at ``t0``; events during a pulse are dropped."""
    kept = greedy(events.select(*keys, TS, SEQ), keys, pulse_ns, bucket_ns=bucket_ns)
    ends = F.array(F.struct(F.col(TS).alias("t"), F.lit(True).alias("value")), F.struct((F.col(TS) + pulse_ns).alias("t"), F.lit(False).alias("value")))
    rows = kept.select(*keys, SEQ, F.inline(ends)).select(*keys, F.col("t").alias(TS), SEQ, "value")
    first = events.select(*keys).distinct().select(*keys, F.lit(t0).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ), F.lit(False).alias("value"))
    return first.unionByName(rows)
