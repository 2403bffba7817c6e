"""Formulations that the stream operators share.

As-of reads and ordered merges are a union of both sides and one sort by (ts, side, seq): no range join. Long
single timelines are divided into time buckets whose carry comes from a small table of bucket summaries
(:func:`along`). Greedy choices restart wherever the timeline pauses long enough, so that only a bounded scan is
sequential. A null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.unsigned import floor_div
from ..schema import SEQ, TS, require
from ..shared import shared_path


def ordered(keys: Sequence[str], *extra: str) -> WindowSpec:
    """The timeline of each key, in time order; ``extra`` columns break ties before seq."""
    return Window.partitionBy(*keys).orderBy(TS, *extra, SEQ)


def running(keys: Sequence[str], *extra: str) -> WindowSpec:
    return ordered(keys, *extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def following(keys: Sequence[str], *extra: str) -> WindowSpec:
    return ordered(keys, *extra).rowsBetween(Window.currentRow, Window.unboundedFollowing)


@dataclass(frozen=True)
class Along:
    """Something read along a timeline; made by :func:`before`, :func:`after`, :func:`latest`, :func:`next_one`, :func:`count` and :func:`total`.

    ``own`` is its window function within a part, ``edge`` the aggregate that a part hands on, ``carry`` what a part gets
    from the edges of the others, given a window over the parts of a key, and ``join`` puts carry and own value together.
    """

    own: Callable[[WindowSpec], Column]
    edge: Callable[[Column], Column]
    carry: Callable[[WindowSpec, Column], Column]
    join: Callable[[Column, Column], Column]


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


_ALL_BEFORE, _ALL_AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
_SO_FAR, _FROM_HERE = (Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing)


def before(value: str | Column) -> Along:
    """The value of the row before; null for the first row, and a struct of the value if null has to be told from none."""
    held = F.struct(_column(value).alias("x"))
    return Along(
        lambda w: F.lag(held).over(w), lambda order: F.max_by(held, order), lambda w, edge: F.lag(edge).over(w), lambda carry, own: F.coalesce(own, carry)["x"]
    )


def after(value: str | Column) -> Along:
    """The value of the row after."""
    held = F.struct(_column(value).alias("x"))
    return Along(
        lambda w: F.lead(held).over(w), lambda order: F.min_by(held, order), lambda w, edge: F.lead(edge).over(w), lambda carry, own: F.coalesce(own, carry)["x"]
    )


def latest(value: str | Column) -> Along:
    """The last value so far that is not null, this row's included."""
    x = _column(value)
    return Along(
        lambda w: F.last(x, ignorenulls=True).over(w.rowsBetween(*_SO_FAR)),
        lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        lambda w, edge: F.last(edge, ignorenulls=True).over(w.rowsBetween(*_ALL_BEFORE)),
        lambda carry, own: F.coalesce(own, carry),
    )


def next_one(value: str | Column) -> Along:
    """The first value from here on that is not null, this row's included."""
    x = _column(value)
    return Along(
        lambda w: F.first(x, ignorenulls=True).over(w.rowsBetween(*_FROM_HERE)),
        lambda order: F.min_by(x, F.when(x.isNotNull(), order)),
        lambda w, edge: F.first(edge, ignorenulls=True).over(w.rowsBetween(*_ALL_AFTER)),
        lambda carry, own: F.coalesce(own, carry),
    )


def total(value: str | Column) -> Along:
    """The sum so far, this row's included."""
    x = _column(value).cast("long")
    return Along(
        lambda w: F.sum(x).over(w.rowsBetween(*_SO_FAR)),
        lambda order: F.sum(x),
        lambda w, edge: F.sum(edge).over(w.rowsBetween(*_ALL_BEFORE)),
        lambda carry, own: F.coalesce(own, F.lit(0).cast("long")) + F.coalesce(carry, F.lit(0).cast("long")),
    )


def count() -> Along:
    """The number of rows so far, this one included."""
    return total(F.lit(1))


def highest(value: str | Column) -> Along:
    """The largest value so far, this row's included."""
    x = _column(value)
    return Along(
        lambda w: F.max(x).over(w.rowsBetween(*_SO_FAR)), lambda order: F.max(x), lambda w, edge: F.max(edge).over(w.rowsBetween(*_ALL_BEFORE)), lambda carry, own: F.greatest(own, carry)
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names, and read back."""
    path = shared_path(df.sparkSession, "timeline")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def along(df: DataFrame, keys: Sequence[str], columns: dict[str, Along], extra: Sequence[str] = (), bucket_ns: int | None = None) -> DataFrame:
    """``df`` with columns read along the timeline of each key, in the order of ts_ns, ``extra``, seq.

    With ``bucket_ns`` the timelines are divided into time buckets that different tasks sort, and what a bucket gets
    from the others comes from a window over one summary row per bucket. The result doesn't depend on the width, if no
    two rows of a key agree in the whole order. The rows are then written to the shared folder first, since they are read
    twice, for the summary and with it: a chain of such steps would otherwise repeat what came before at every step.
    """
    if bucket_ns is None:
        w = ordered(keys, *extra)
        none = F.lit(None)
        return df.withColumns({name: x.join(none, x.own(w)) for name, x in columns.items()})
    parts = [*keys, "_bucket"]
    rows = settled(df.withColumn("_bucket", floor_div(F.col(TS), bucket_ns)))
    order = F.struct(TS, *extra, SEQ)
    edges = rows.groupBy(*parts).agg(*(x.edge(order).alias(f"_edge_{name}") for name, x in columns.items()))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.select(*parts, *(x.carry(w, F.col(f"_edge_{name}")).alias(f"_carry_{name}") for name, x in columns.items()))
    w = ordered(parts, *extra)
    rows = same_parts(rows, edges, parts).withColumns({name: x.join(F.col(f"_carry_{name}"), x.own(w)) for name, x in columns.items()})
    return rows.drop("_bucket", *(f"_carry_{name}" for name in columns))


def number_within(df: DataFrame, keys: Sequence[str], starts: Column, out: str, extra: Sequence[str] = (), bucket_ns: int | None = None, counted: Column | None = None) -> DataFrame:
    """``df`` with the number from 0 of each row in its segment, which a row where ``starts`` holds begins; of ``counted`` rows only."""
    one = F.lit(1) if counted is None else counted.cast("long")
    rows = along(df.withColumn("_starts", starts), keys, {"_so_far": total(one)}, extra, bucket_ns)
    rows = along(rows, keys, {"_at_start": latest(F.when(F.col("_starts"), F.col("_so_far") - one))}, extra, bucket_ns)
    return rows.withColumn(out, F.col("_so_far") - one - F.coalesce("_at_start", F.lit(0).cast("long"))).drop("_starts", "_so_far", "_at_start")


def changes(levels: DataFrame, keys: Sequence[str], value: str = "value", bucket_ns: int | None = None) -> DataFrame:
    """Rows whose value differs from the key's row before; the first row stays."""
    rows = along(levels, keys, {"_last": before(F.struct(F.col(value).alias("v")))}, bucket_ns=bucket_ns)
    return rows.where(F.col("_last").isNull() | ~F.col(value).eqNullSafe(F.col("_last.v"))).drop("_last")


def tagged(df: DataFrame, side: int, column: str) -> DataFrame:
    """Keys and times beside the whole row as a struct named ``column``."""
    return df.withColumn(column, F.struct(*df.columns)).withColumn("_side", F.lit(side))


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    inclusive: bool = True,
    forward: bool = False,
    bucket_ns: int | None = None,
) -> DataFrame:
    """``left`` with the values of ``right`` (old name: new name) at its times, null where there is none.

    Backward: the latest right row at or before the time (before it, unless ``inclusive``). Forward: the first
    right row after it (at or after it, if ``inclusive``). Of right rows at one time the last by seq counts
    backward, the first forward. With ``bucket_ns`` a key's timeline is divided into time buckets that are
    sorted by different tasks; what a bucket starts (or ends) with comes from one row for each bucket.
    """
    require(left, keys)
    require(right, keys, *columns)
    right_side = 0 if inclusive != forward else 2
    own = left.select(*keys, TS, SEQ, F.struct(*left.columns).alias("_left"), F.lit(1).alias("_side"))
    other = right.select(*keys, TS, SEQ, F.struct(*(F.col(a).alias(b) for a, b in columns.items())).alias("_right"), F.lit(right_side).alias("_side"))
    both = own.unionByName(other, allowMissingColumns=True)
    read = next_one("_right") if forward else latest("_right")
    found = along(both, keys, {"_found": read}, ["_side"], bucket_ns).where(F.col("_side") == 1)
    return found.select("_left.*", *(F.col(f"_found.{b}").alias(b) for b in columns.values()))


def same_parts(rows: DataFrame, summary: DataFrame, parts: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``summary`` (at most one row for each part); null keys are parts too."""
    other = summary.select(*(F.col(p).alias(f"_of_{p}") for p in parts), *(c for c in summary.columns if c not in parts))
    on = F.lit(True)
    for p in parts:
        on = on & F.col(p).eqNullSafe(F.col(f"_of_{p}"))
    return rows.join(other, on, how).drop(*(f"_of_{p}" for p in parts))


def in_parts(rows: DataFrame, which: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The ``rows`` whose part is one of ``which``."""
    return same_parts(rows, which.select(*parts).distinct(), parts, "left_semi")


def merged(inputs: Sequence[DataFrame], keys: Sequence[str], value: str = "value", initial: Column | None = None, bucket_ns: int | None = None) -> DataFrame:
    """Ordered merge of level streams: one row per input row, with the current value of every input as v0, v1, ...

    At equal times the input of lower index comes first. Before its first row an input has ``initial`` (false).
    """
    start = F.lit(False) if initial is None else initial
    rows = None
    for i, df in enumerate(inputs):
        require(df, keys, value)
        own = df.select(*keys, TS, SEQ, F.lit(i).alias("_input"), F.struct(F.col(value).alias("x")).alias(f"_{i}"))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    rows = along(rows, keys, {f"_h{i}": latest(f"_{i}") for i in range(len(inputs))}, ["_input"], bucket_ns)
    return rows.select(*keys, TS, SEQ, "_input", *(F.coalesce(F.col(f"_h{i}.x"), start).alias(f"v{i}") for i in range(len(inputs))))


def with_initial(levels: DataFrame, keys: Sequence[str], value: Column, t0: int = 0) -> DataFrame:
    """Prepend the initial row that every level stream has at ``t0``, for each key that occurs."""
    first = levels.select(*keys).distinct().select(*keys, F.lit(t0).cast("long").alias(TS), F.lit(-1).cast("long").alias(SEQ), value.alias("value"))
    return first.unionByName(levels.select(*keys, TS, SEQ, "value"))


def scan_sorted(df: DataFrame, parts: Sequence[str], order: Sequence[str], step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Feed the rows of each part to ``step`` in order, batch by batch, so that no part is held in memory as a whole."""
    dealt = df.repartition(*parts) if parts else df.repartition(1)
    return dealt.sortWithinPartitions(*parts, *order).mapInArrow(step, schema)


def part_codes(batch: pa.RecordBatch, parts: Sequence[str]) -> np.ndarray:
    """True where a row's part differs from the row before (the first row counts as different); nulls are equal to nulls only."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in parts:
        column = batch.column(batch.schema.get_field_index(name))
        known = column.is_valid()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), False)
        moved = pc.or_(differs, pc.xor(known.slice(1), known.slice(0, len(known) - 1)))
        new[1:] |= moved.to_numpy(zero_copy_only=False)
    return new


def last_part(batch: pa.RecordBatch, parts: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(p))[row].as_py() for p in parts)


def pieces(batches: Iterator[pa.RecordBatch], parts: Sequence[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The stretches of one part in each batch, and whether each is the first of its part."""
    part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = part_codes(batch, parts)
        new[0] = part is None or last_part(batch, parts, 0) != part
        part = last_part(batch, parts, batch.num_rows - 1)
        edges = [*([] if new[0] else [0]), *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield bool(new[a]), batch.slice(a, b - a)


def greedy(df: DataFrame, keys: Sequence[str], hold_ns: int | Column, at: str = TS, bucket_ns: int | None = None) -> DataFrame:
    """Rows accepted one after the other: the first, then each at least ``hold_ns`` after the last accepted one.

    A row at least the hold after the row before it is accepted whatever came earlier, so the timeline restarts
    there; the sequential choice runs within these pieces, by jumps of binary search in sorted batches. Pieces of one
    key go to different tasks. With ``bucket_ns`` also a timeline that never pauses is shared (:func:`held_off`). ``hold_ns`` may be a column that is constant within a key. With ``at`` other than ts_ns
    rows are in the order of that time, and buckets are of it.
    """
    hold = F.lit(hold_ns).cast("long") if isinstance(hold_ns, int) else hold_ns.cast("long")
    if bucket_ns is not None and at == TS:
        return held_off(df.withColumn("_side", F.lit(1)), keys, hold, bucket_ns).drop("_side")
    rows = df.withColumn("_hold", hold)
    if at != TS:
        rows = rows.withColumnsRenamed({TS: "_ts", at: TS})
    rows = along(rows, keys, {"_last": before(TS)}, bucket_ns=bucket_ns)
    rows = rows.withColumn("_cut", F.coalesce(F.col(TS) - F.col("_last") >= F.col("_hold"), F.lit(True)))
    rows = along(rows, keys, {"_piece": total("_cut")}, bucket_ns=bucket_ns).drop("_last")
    parts = [*keys, "_piece"]
    schema = rows.schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_time = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(batch.schema.get_field_index(TS)).to_numpy()
            holds = batch.column(batch.schema.get_field_index("_hold")).to_numpy()
            new = part_codes(batch, parts)
            new[0] = last_part(batch, parts, 0) != part
            starts = np.flatnonzero(new)
            take = np.zeros(batch.num_rows, bool)
            edges = [*([] if new[0] else [0]), *starts, batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                i = a
                if not new[a] and last_time is not None:
                    i = a + int(np.searchsorted(times[a:b], last_time + holds[a]))
                while i < b:
                    take[i], last_time = True, times[i]
                    i += max(1, int(np.searchsorted(times[i:b], times[i] + holds[i])))
            part = last_part(batch, parts, batch.num_rows - 1)
            yield batch.filter(pa.array(take))

    found = scan_sorted(rows, parts, [TS, SEQ], choose, schema).drop("_hold", "_cut", "_piece")
    return found if at == TS else found.withColumnsRenamed({TS: at, "_ts": TS})


#: A time before all others, as what is allowed at the start of a timeline.
EVER = -(1 << 63)


def _last_jumps(following: np.ndarray) -> np.ndarray:
    """Where jumps from each place end, ``following`` being the next place or the length for none; by doubling of the jumps."""
    at = np.where(following < len(following), following, np.arange(len(following)))
    while True:
        twice = at[at]
        if np.array_equal(twice, at):
            return at
        at = twice


def _bucket_map(ts: np.ndarray, is_event: np.ndarray, hold: int, rearmed: bool) -> tuple:
    """What a bucket makes of the state it is entered with: for each stretch of entry times the state that it is left with.

    ``ends`` are the last event times of the stretches, ``allowed`` and ``armed`` the states behind; ``first`` is the first event behind a rearm (null: none), ``rearms`` whether
    there is one. Entries further than the hold behind the bucket's first row come from a missing arm only, so of later stretches only that of ``first`` is kept.
    """
    places = np.flatnonzero(is_event)
    t = ts[places]
    n = len(t)
    rearms = np.flatnonzero(~is_event)
    following = np.maximum(np.searchsorted(t, t + hold), np.arange(n) + 1)
    armed = np.ones(n, bool)
    if rearmed:
        after_rearm = np.append(np.searchsorted(places, rearms), n)
        following = np.maximum(following, after_rearm[np.searchsorted(rearms, places)])
    last = _last_jumps(following) if n else following
    if rearmed and n:
        armed = places[last] < (rearms[-1] if len(rearms) else -1)
    first = int(after_rearm[0]) if rearmed and len(rearms) and after_rearm[0] < n else None
    turn = np.flatnonzero(np.append(last[1:] != last[:-1], True)) if n else np.zeros(0, np.int64)
    keep = np.append(True, t[turn][:-1] < ts[0] + hold) if n else np.zeros(0, bool)
    if first is not None:
        keep[np.searchsorted(turn, first)] = True
    turn = turn[keep]
    return t[turn], t[last[turn]] + hold, armed[turn], None if first is None else int(t[first]), len(rearms) > 0


def held_off(df: DataFrame, keys: Sequence[str], hold: Column, bucket_ns: int, rearmed: bool = False) -> DataFrame:
    """Events that hold-off, and with ``rearmed`` an arm that each spends, let pass, for timelines that never pause.

    ``df`` has ``_side`` 1 for events and 0 for rearms. Time buckets go to different tasks. Each maps the state it is entered with, when the next event is allowed and whether it is armed, to the one it
    is left with, by jumps from each event to the next accepted one. The maps, a row for each bucket, are applied one after the other, and each bucket
    chooses its events from the state that it is then known to be entered with. ``hold`` is constant within a key.
    """
    parts, order = [*keys, "_bucket"], [TS, "_side", SEQ]
    rows = settled(df.withColumns({"_bucket": floor_div(F.col(TS), bucket_ns), "_hold": hold.cast("long")}))
    state = "_ends array<long>, _allowed array<long>, _armed array<boolean>, _first long, _rearms boolean, _hold long"
    kinds = dict(df.dtypes)
    of_keys = "".join(f"{k} {kinds[k]}, " for k in keys)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def bucket() -> pa.RecordBatch:
            ts, side = (np.concatenate([x.column(len(parts) + i).to_numpy() for x in held]) for i in (0, 1))
            own = int(held[0].column(len(parts) + 3)[0].as_py())
            ends, allowed, armed, first, rearms = _bucket_map(ts, side == 1, own, rearmed)
            values = [pa.array([ends], pa.list_(pa.int64())), pa.array([allowed], pa.list_(pa.int64())), pa.array([armed], pa.list_(pa.bool_())), pa.array([first], pa.int64()), pa.array([rearms]), pa.array([own])]
            return pa.RecordBatch.from_arrays([*(held[0].column(i).slice(0, 1) for i in range(len(parts))), *values], names=[*parts, "_ends", "_allowed", "_armed", "_first", "_rearms", "_hold"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = part_codes(batch, parts)
            new[0] = bool(held) and last_part(batch, parts, 0) != last_part(held[-1], parts, held[-1].num_rows - 1)
            begin = 0
            for a in [*np.flatnonzero(new), batch.num_rows]:
                if a > begin:
                    held.append(batch.slice(begin, a - begin))
                if a < batch.num_rows:
                    yield bucket()
                    held = []
                begin = a
        if held:
            yield bucket()

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, allowed, armed = None, EVER, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = part_codes(batch, keys) if keys else np.zeros(batch.num_rows, bool)
            new[0] = last_part(batch, keys, 0) != part
            found = []
            for first, row in zip(new.tolist(), batch.select(range(len(parts), batch.num_columns)).to_pylist(), strict=True):
                if first:
                    allowed, armed = EVER, True
                found.append((allowed, armed))
                least = allowed if armed else row["_first"] if row["_first"] is not None and row["_first"] > allowed else allowed
                if armed or row["_first"] is not None:
                    i = int(np.searchsorted(row["_ends"], least))
                    if i < len(row["_ends"]):
                        allowed, armed = row["_allowed"][i], row["_armed"][i]
                    else:
                        armed = armed or row["_rearms"]
                else:
                    armed = row["_rearms"]
            part = last_part(batch, keys, batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(parts))), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_())], names=[*parts, "_enter", "_with"])

    slim = rows.select(*parts, TS, "_side", SEQ, "_hold")
    maps = scan_sorted(slim, parts, order, summed, f"{of_keys}_bucket long, {state}")
    states = scan_sorted(maps, keys, ["_bucket"], entered, f"{of_keys}_bucket long, _enter long, _with boolean")
    known = same_parts(rows, states, parts, "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, armed, allowed = None, True, EVER
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: i for i, n in enumerate(batch.schema.names)}
            ts, side, holds = (batch.column(at[c]).to_numpy() for c in (TS, "_side", "_hold"))
            new = part_codes(batch, parts)
            new[0] = last_part(batch, parts, 0) != part
            take = np.zeros(batch.num_rows, bool)
            edges = [*([] if new[0] else [0]), *np.flatnonzero(new), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if new[a]:
                    allowed, armed = batch.column(at["_enter"])[a].as_py(), batch.column(at["_with"])[a].as_py()
                events, rearms = a + np.flatnonzero(side[a:b] == 1), a + np.flatnonzero(side[a:b] == 0)
                i = a
                while i < b:
                    if not armed:
                        k = np.searchsorted(rearms, i)
                        if k == len(rearms):
                            break
                        i, armed = int(rearms[k]), True
                    k = np.searchsorted(events, max(i, a + int(np.searchsorted(ts[a:b], allowed))))
                    if k == len(events):
                        break
                    i = int(events[k])
                    take[i], armed, allowed = True, not rearmed, int(ts[i] + holds[i])
                    i += 1
            part = last_part(batch, parts, batch.num_rows - 1)
            yield batch.filter(pa.array(take))

    return scan_sorted(known, parts, order, choose, known.schema).drop("_bucket", "_hold", "_enter", "_with")


def carried(df: DataFrame, keys: Sequence[str], value: str, bucket_ns: int, out: str = "carried") -> DataFrame:
    """Last non-null ``value`` at or before each row, for timelines too long for one task."""
    return along(df, keys, {out: latest(value)}, bucket_ns=bucket_ns)


def numbered(df: DataFrame, keys: Sequence[str], bucket_ns: int, out: str = "number") -> DataFrame:
    """Row number from 1 in time order, for timelines too long for one task."""
    return along(df, keys, {out: count()}, bucket_ns=bucket_ns)
