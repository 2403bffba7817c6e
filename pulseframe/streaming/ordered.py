"""Stateful stream operators: rows wait until the watermark passes them and are then applied in order.

One mechanism serves all (:func:`apply_ordered`): a stateful processor with event-time timers holds each key's waiting
rows and the operator's own state. Each input has a watermark of its own (:func:`stream_rows`), and Spark applies the
least of them, so that no row is applied while another input may still bring an earlier one.

* What a batch brings of a key and has to wait lies in parts of at most PART_ROWS rows in a map state, with the first time of each beside it, and the first that is due sets the key's one
  timer: state is called a few times for each key and batch, however many time slots its rows are in and whatever waits. Rows that need not wait, those of a key that ends for instance, never go there.
* An end is a row of its key and moves no watermark (its event time is null). Once all inputs of a key have ended, what waits is applied and the
  key closed; other keys go on. An end that tells how many rows its input has of the key waits for them, so files can come in any order.
* A mark (``is_mark``) moves the watermark of its input and is nothing else: no earlier row will come from it.
* Rows older than what was applied of their key are dropped, or moved to the last applied time (``late='clamp'``). Spark's own filter of late rows,
  which knows nothing of keys, is not used.
* Timers also end keys that have been silent for ``idle_ms``.
* Rows are held as columns from their shuffle on. A step gets them one by one, or all that are applied at once as arrays (:class:`ColumnStep`).
* A stream can also bring stretches: many rows of a key in one (:func:`stretch_bytes`), so that Spark handles as many rows as there are stretches. An operator with ``chained`` and
  a :class:`ColumnStep` gives them to the next.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.timeline import part_codes
from ..schema import SEQ, TS, StreamError

Step = Callable[[dict[str, Any], dict[str, Any]], list[dict[str, Any]]]
Finish = Callable[[dict[str, Any]], list[dict[str, Any]]]
Columns = dict[str, np.ndarray]

#: Where a row's time is for watermarks; Spark's are in milliseconds.
EVENT_TIME = "event_time"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that the processor reads and steps don't see.
OWN = ("is_end", "is_mark", "end_rows")
#: Columns of stretches beside keys and ends; ``latest`` is the last time in one.
STRETCH, LATEST = "stretch", "latest"
FRAME_ROWS = 4096
#: Rows of a part of what waits of a key; so many times as much is held before it is applied up to the next part.
PART_ROWS, PARTS_HELD = 4096, 8


@dataclass(frozen=True)
class ColumnStep:
    """A step over all rows of a key that are applied at once: ``apply(state, columns, ended)`` gets them in order and gives columns of equal length.

    With ``ended`` nothing comes after them and what is left is given too; there may then be no columns. What it keeps from call to call lies in ``state``.
    """

    apply: Callable[[dict[str, Any], Columns, bool], dict[str, Any]]


def _narrow(steps: np.ndarray) -> np.ndarray:
    """Whole numbers in the least bytes that hold all of them."""
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    return steps.astype(next(w for w in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(w).min <= low and high <= np.iinfo(w).max))


def stretch_bytes(rows: Columns) -> bytes:
    """Rows of one key (ts_ns, seq, more whole numbers, doubles or truth values, none null) as bytes: a line of JSON that tells what follows, then each column.

    Whole numbers are their first one and the steps from one to the next, without bytes if there is no step.
    """
    head: list[list] = []
    data = []
    for name, own in rows.items():
        first = None
        if own.dtype.kind not in "ifb":
            raise StreamError(f"{name} can't lie in a stretch")
        if own.dtype.kind == "i":
            own = own.astype(np.int64, copy=False)
            first, steps = int(own[0]) if len(own) else 0, np.diff(own, prepend=own[:1])
            own = _narrow(steps) if steps.any() else steps[:0].astype(np.int8)
        data.append(own.tobytes())
        head.append([name, own.dtype.str, first, len(data[-1])])
    return b"".join([json.dumps([len(rows[TS]), head]).encode(), b"\n", *data])


def stretch_columns(stretch: bytes) -> Columns:
    """What :func:`stretch_bytes` put together."""
    line = stretch.index(b"\n") + 1
    n, head = json.loads(stretch[:line])
    out = {}
    for name, kind, first, size in head:
        own = np.frombuffer(stretch, kind, size // np.dtype(kind).itemsize, line)
        out[name] = own if first is None else own.cumsum(dtype=np.int64) + first if size else np.full(n, first, np.int64)
        line += size
    return out


def _size(rows: Columns) -> int:
    return len(rows[TS]) if rows else 0


def _some(rows: Columns, which: Any) -> Columns:
    return {c: v[which] for c, v in rows.items()}


def _joined(parts: Sequence[Columns]) -> Columns:
    parts = [x for x in parts if _size(x)]
    return parts[0] if len(parts) == 1 else {c: np.concatenate([x[c] for x in parts]) for c in parts[0]} if parts else {}


def _in_order(rows: Columns) -> Columns:
    if _size(rows) < 2 or (np.diff(rows[TS]) > 0).all():
        return rows
    return _some(rows, np.lexsort((rows[SEQ], rows["side"], rows[TS])))


class Ordered(StatefulProcessor):
    """Applies a step to each key's rows in (ts_ns, side, seq) order, once the watermark has passed them."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], step: Step | ColumnStep, late: str, finish: Finish | None, idle_ms: int | None, inputs: int, slot_ms: int, lag_ms: int, nullable: Sequence[tuple[str, str]], form: str = "rows"):
        self.nullable, self.form = list(nullable), form
        self.keys, self.columns, self.step, self.late, self.finish = list(keys), list(columns), step, late, finish
        self.idle_ms, self.inputs, self.slot_ms, self.lag_ms = idle_ms, inputs, slot_ms, lag_ms
        self.timed = EVENT_TIME in columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "text string")
        self.own = handle.getValueState("own", "data binary")
        self.slots = handle.getMapState("slots", "part long", "first long")
        self.rows = handle.getMapState("rows", "part long", "data binary")

    def load(self) -> dict[str, Any]:
        """What is known of a key, of one size however much waits: times applied, newest and first waiting, ends, counted rows, parts so far, both timers, and whether it is stored."""
        if self.head.exists():
            return json.loads(self.head.get()[0])
        return {"applied": None, "newest": None, "first": None, "ends": 0, "arrived": 0, "expected": 0, "parts": 0, "timer": None, "quiet": None, "stored": False}

    def save(self, head: dict) -> None:
        head["stored"] = True
        self.head.update((json.dumps(head),))

    def due(self, ts: Any) -> Any:
        """When the slot of a time, or of each of many, is applied."""
        return (ts // (self.slot_ms * 1_000_000) + 1) * self.slot_ms + self.lag_ms

    def put(self, rows: Columns, head: dict) -> None:
        rows = _in_order(rows)
        for i in range(0, _size(rows), PART_ROWS):
            held, part = _some(rows, slice(i, i + PART_ROWS)), head["parts"]
            head["parts"] += 1
            self.rows.updateValue((part,), (pickle.dumps(held),))
            self.slots.updateValue((part,), (int(held[TS][0]),))
        if _size(rows):
            first = int(rows[TS][0])
            head["first"] = first if head["first"] is None else min(head["first"], first)

    def take(self, head: dict, watermark_ms: int | None, more: Columns | None = None) -> Iterator[Columns]:
        """The waiting rows that are due, all without a watermark, and ``more`` in order; what isn't due of the parts that are read is put back."""
        parts = sorted((first[0], part[0]) for part, first in self.slots.iterator()) if head["parts"] else []
        held, rest, head["first"] = [more or {}], [], None
        for first, part in parts:
            if watermark_ms is not None and self.due(first) > watermark_ms:
                head["first"] = first
                break
            if sum(map(_size, held)) > PARTS_HELD * PART_ROWS:
                rows = _in_order(_joined(held))
                n = int(np.searchsorted(rows[TS], first))
                yield _some(rows, slice(n))
                held = [_some(rows, slice(n, None))]
            own = pickle.loads(self.rows.getValue((part,))[0])
            self.rows.removeKey((part,))
            self.slots.removeKey((part,))
            n = _size(own) if watermark_ms is None else int(np.count_nonzero(self.due(own[TS]) <= watermark_ms))
            held.append(_some(own, slice(n)))
            rest.append(_some(own, slice(n, None)))
        self.put(_joined(rest), head)
        yield _in_order(_joined(held))

    def apply(self, key: tuple, chunks: Iterable[Columns], head: dict, watermark_ms: int, ended: bool = False) -> Iterator[pd.DataFrame]:
        state, out = pickle.loads(self.own.get()[0]) if head["applied"] is not None and self.own.exists() else {}, []
        if isinstance(self.step, ColumnStep):
            held: Columns = {}
            for rows in chunks:
                if _size(held):
                    yield from self.column_frame(self.step.apply(state, held, False), key, head, watermark_ms)
                held = rows
                if _size(rows):
                    head["applied"] = int(rows[TS][-1])
            if ended or _size(held):
                yield from self.column_frame(self.step.apply(state, held, ended), key, head, watermark_ms, ended)
        else:
            for row in self.each(chunks):
                head["applied"] = row[TS]
                found = self.step(state, row)
                if not found:
                    continue
                if self.timed:
                    found = [x | {EVENT_TIME: max(row[TS] // 1_000_000, watermark_ms + 1)} for x in found]
                out += found
                if len(out) >= FRAME_ROWS:
                    yield from self.frame(key, out)
                    out = []
            if ended:
                last = max((head["applied"] or 0) // 1_000_000, watermark_ms + 1)
                found = self.finish(state) if self.finish is not None else []
                out += [x | {EVENT_TIME: last} for x in found] + [{TS: head["applied"] or 0, SEQ: 0, "is_end": True, EVENT_TIME: last}] if self.timed else found
            yield from self.frame(key, out)
        if not ended and head["applied"] is not None:
            self.own.update((pickle.dumps(state),))

    def each(self, chunks: Iterable[Columns]) -> Iterator[dict]:
        for rows in chunks:
            names = list(rows)
            for values in zip(*(v.tolist() for v in rows.values()), strict=True):
                yield dict(zip(names, values, strict=True))

    def column_frame(self, found: dict[str, Any], key: tuple, head: dict, watermark_ms: int, ended: bool = False) -> Iterator[pd.DataFrame]:
        """What a step gave as columns; for the next operator as a stretch, with the end of its key."""
        size = len(next(iter(found.values()), ()))
        if self.timed and (size or ended):
            at = max((head["applied"] or 0) // 1_000_000, watermark_ms + 1)
            none = {c: np.zeros(0, np.int64) for c in (TS, SEQ)}
            values = {k: np.full(1, v, np.int64 if type(v) is int else object) for k, v in zip(self.keys, key, strict=True)}
            own = {"is_end": np.array([ended]), STRETCH: np.array([stretch_bytes(found or none)], object), EVENT_TIME: np.array([at], "M8[ms]").astype("M8[ns]")} | values
            yield pd.DataFrame({c: own[c] for c in self.columns}, copy=False)
        elif size:
            values = {k: np.full(size, v) if type(v) is int else [v] * size for k, v in zip(self.keys, key, strict=True)}
            yield pd.DataFrame({c: values[c] if c in values else found[c] if c in found else [None] * size for c in self.columns}, copy=False)

    def frame(self, key: tuple, out: list[dict]) -> Iterator[pd.DataFrame]:
        if out:
            values = {k: [v] * len(out) for k, v in zip(self.keys, key, strict=True)}
            held = pd.DataFrame({c: values[c] if c in values else [x.get(c) for x in out] for c in self.columns}, dtype=object)
            if self.timed:
                held[EVENT_TIME] = pd.to_datetime(held[EVENT_TIME].astype("int64"), unit="ms")
                held["is_end"] = held["is_end"].eq(True)
            yield held

    def set_timer(self, head: dict, name: str, wanted: int | None) -> None:
        """Move one of the key's timers: ``timer``, for what waits, or ``quiet``, which ends a silent key. They may be at one time and are then one."""
        if head[name] != wanted:
            other = head["quiet" if name == "timer" else "timer"]
            if head[name] is not None and head[name] != other:
                self.handle.deleteTimer(head[name])
            if wanted is not None and wanted != other:
                self.handle.registerTimer(wanted)
            head[name] = wanted

    def wake(self, head: dict) -> None:
        self.set_timer(head, "timer", None if head["first"] is None else self.due(head["first"]))

    def end_key(self, key: tuple, head: dict, watermark_ms: int, more: Columns | None = None) -> Iterator[pd.DataFrame]:
        """Apply what waits and ``more``, then what is left when a key ends; its state goes."""
        applied = head["applied"]
        yield from self.apply(key, self.take(head, None, more), head, watermark_ms, ended=True)
        for name in ("timer", "quiet"):
            self.set_timer(head, name, None)
        for state, there in ((self.head, head["stored"]), (self.own, applied is not None), (self.slots, head["parts"]), (self.rows, head["parts"])):
            if there:
                state.clear()

    def taken(self, frame: pd.DataFrame, head: dict) -> Columns:
        """The rows of a batch but for ends and marks, with their nulls as they were (:func:`_exact`); ends are noted."""
        flags = dict(self.nullable)
        names = [c for c in frame.columns if c not in self.keys and c not in OWN]
        if self.form != "rows":
            own = dict(zip(frame.columns, frame.to_numpy(object).T.tolist(), strict=True))
            head["ends"] += int(sum(own["is_end"]))
            head["expected"] += int(sum(own["end_rows"]))
            rows = _of_stretches(own) if self.form == "stretches" else _unpacked({c: own[c] for c in names})
        else:
            ends, marks = (frame[c].to_numpy(bool) for c in ("is_end", "is_mark"))
            head["ends"] += int(ends.sum())
            head["expected"] += int(frame["end_rows"].to_numpy()[ends].sum())
            plain = [frame[c] if frame[c].dtype.kind in "iufb" else pd.Series(frame[c].tolist(), dtype=object) for c in names]
            rows = {c: v.to_numpy() for c, v in zip(names, plain, strict=True)}
            rows = _some(rows, ~(ends | marks)) if (ends | marks).any() else rows
        if not _size(rows):
            return {}
        for name, flag in flags.items():
            null = rows.pop(flag).astype(bool)
            if null.any():
                rows[name] = rows[name].astype(object)
                rows[name][null] = None
        return rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, watermark = self.load(), timerValues.getCurrentWatermarkInMs()
        own = _joined([self.taken(frame, head) for frame in rows])
        if head["timer"] is not None and head["timer"] <= watermark:
            # what the watermark has passed is applied before rows that come too late for it
            yield from self.apply(key, self.take(head, watermark), head, watermark)
        head["arrived"] += _size(own)
        if _size(own) and head["applied"] is not None:
            if self.late == "drop":
                own = _some(own, own[TS] >= head["applied"])
            else:
                own = own | {TS: np.maximum(own[TS], head["applied"])}
        if _size(own):
            newest = int(own[TS].max())
            head["newest"] = newest if head["newest"] is None else max(newest, head["newest"])
        if head["ends"] >= self.inputs and head["arrived"] >= head["expected"]:
            yield from self.end_key(key, head, watermark, own)
            return
        now = self.due(own[TS]) <= watermark if _size(own) else np.zeros(0, bool)
        if now.any():
            yield from self.apply(key, [_in_order(_some(own, now))], head, watermark)
            own = _some(own, ~now)
        self.put(own, head)
        self.wake(head)
        if self.idle_ms is not None and head["newest"] is not None:
            self.set_timer(head, "quiet", head["newest"] // 1_000_000 + self.slot_ms + self.lag_ms + self.idle_ms)
        self.save(head)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, at = self.load(), expiredTimerInfo.getExpiryTimeInMs()
        watermark = timerValues.getCurrentWatermarkInMs()
        ends = head["quiet"] == at
        if head["timer"] == at:
            if not ends:
                head["timer"] = None
            yield from self.apply(key, self.take(head, watermark), head, watermark)
            if not ends:
                self.wake(head)
                self.save(head)
        if ends:
            head["quiet"] = None if head["quiet"] != head["timer"] else head["quiet"]
            yield from self.end_key(key, head, watermark)


def apply_ordered(
    rows: DataFrame, keys: Sequence[str], step: Step | ColumnStep, payload: str, late: str = "drop", finish: Finish | None = None, idle_ms: int | None = None, inputs: int = 1, slot_ms: int = 1000, lag_ms: int = 0, chained: bool = False
) -> DataFrame:
    """Apply ``step(state, row) -> output rows``, or a :class:`ColumnStep`, to each key's rows in (ts_ns, side, seq) order.

    ``rows`` comes from :func:`stream_rows`, or the union of several; ``payload`` is the DDL of the outputs beside the
    keys. Rows wait in slots of ``slot_ms``; a slot is applied when the watermark is past its end by ``lag_ms``. ``finish(state)`` (not of a :class:`ColumnStep`) gives what is left when a key ends, by a row with
    ``is_end`` of each of the ``inputs`` or after ``idle_ms`` without rows. With ``chained`` the result has an event time, a watermark and ends of its
    own, so that :func:`chained_rows` feeds it to a further operator of the same query; ``payload`` then has to have ts_ns and seq, and what a :class:`ColumnStep` gives must fit :func:`stretch_bytes`. An operator whose rows
    appear later than their ts_ns gives the next one that time as ``lag_ms``, where it has other inputs. The state store has to be RocksDB's, which is set where none is.
    """
    if late not in ("drop", "clamp"):
        raise StreamError("late rows are dropped or clamped")
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)
    rows, nullable = (rows, []) if STRETCH in rows.columns else _exact(rows, [*keys, TS, SEQ, "side", *OWN])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    more = f", is_end boolean, {EVENT_TIME} timestamp" if chained else ""
    payload = f"{STRETCH} binary" if chained and isinstance(step, ColumnStep) else payload
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), payload]) + more
    columns = [*keys, *(p.split()[0] for p in (payload + more).split(", "))]
    form = "stretches" if STRETCH in rows.columns else "packed" if all(kinds[c] in PACKABLE for c in rows.columns if c not in keys) else "rows"
    processor = Ordered(keys, columns, step, late, finish, idle_ms, inputs, slot_ms, lag_ms, nullable, form)
    rows = _packed(rows, keys) if form == "packed" else rows
    return rows.groupBy(*keys).transformWithStateInPandas(processor, ddl, "Append", "EventTime", eventTimeColumnName=EVENT_TIME if chained else "")


#: Types whose arrays keep every value as it is on the way to Python; whole numbers and truth values go as bytes.
WHOLE = ("bigint", "int", "smallint", "tinyint")
PACKABLE = (*WHOLE, "double", "boolean", "string", "binary")


def _packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key that follow each other as one row: Spark hands rows to a stateful processor one by one, which costs more than most steps.

    ``n_rows`` rows lie in a row; ends and marks are only counted. Whole numbers are their first value (``first_of_``) and steps in as few bytes as the batch's largest step
    takes, so that a row's bytes by its number of rows tell their width; truth values are bytes, 2 for null; other types are arrays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [c for c in rows.columns if c not in keys and c not in OWN]
    numbers, flags = [c for c in names if kinds[c] in WHOLE], [c for c in names if kinds[c] == "boolean"]
    others = [c for c in names if c not in numbers and c not in flags]
    ddl = ", ".join([
        *(f"`{k}` {kinds[k]}" for k in keys), "n_rows long, is_end long, end_rows long", *(f"`{c}` binary, `first_of_{c}` long" for c in numbers),
        *(f"`{c}` binary" for c in flags), *(f"`{c}` array<{kinds[c]}>" for c in others),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda b, c: b.column(b.schema.get_field_index(c))
            ends, marks = (column(batch, c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_end", "is_mark"))
            out = ends | marks
            first = np.flatnonzero(part_codes(batch, keys))
            sizes = np.add.reduceat((~out).astype(np.int64), first)
            expected = np.where(ends, column(batch, "end_rows").to_numpy(zero_copy_only=False), 0)
            plain = batch.filter(pa.array(~out)) if out.any() else batch
            edges = np.append(0, np.cumsum(sizes))
            starts = edges[:-1][sizes > 0]
            values = [*(column(batch, k).take(pa.array(first)) for k in keys), pa.array(sizes), *(pa.array(np.add.reduceat(x.astype(np.int64), first)) for x in (ends, expected))]

            def as_bytes(own: np.ndarray, edges: np.ndarray = edges) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * own.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])

            for c in numbers:
                own = column(plain, c)
                if own.null_count:
                    raise StreamError(f"{c} can't be null")
                own = own.to_numpy().astype(np.int64)
                steps = np.diff(own, prepend=own[:1])
                steps[starts] = 0
                since = np.zeros(len(first), np.int64)
                since[sizes > 0] = own[starts]
                values += [as_bytes(_narrow(steps)), pa.array(since)]
            for c in flags:
                own = column(plain, c)
                known = own.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
                values.append(as_bytes(np.where(own.is_null().to_numpy(zero_copy_only=False), np.uint8(2), known)))
            for c in others:
                values.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), column(plain, c)))
            yield pa.RecordBatch.from_arrays(values, names=[*keys, "n_rows", "is_end", "end_rows", *(x for c in numbers for x in (c, f"first_of_{c}")), *flags, *others])

    return rows.mapInArrow(pack, ddl)


def _unpacked(own: dict[str, list]) -> Columns:
    """The columns of rows that :func:`_packed` put together."""
    runs = [(i, n) for i, n in enumerate(own["n_rows"]) if n]
    out: Columns = {}
    for name, values in own.items():
        if not runs or name == "n_rows" or name.startswith("first_of_") and name.removeprefix("first_of_") in own:
            continue
        if f"first_of_{name}" in own:
            out[name] = np.concatenate([np.frombuffer(values[i], f"i{len(values[i]) // n}").cumsum(dtype=np.int64) + own[f"first_of_{name}"][i] for i, n in runs])
        elif isinstance(values[runs[0][0]], bytes):
            found = np.concatenate([np.frombuffer(values[i], np.uint8) for i, _ in runs])
            out[name], null = found == 1, found == 2
            if null.any():
                out[name] = out[name].astype(object)
                out[name][null] = None
        else:
            out[name] = np.concatenate([values[i] for i, _ in runs])
    return out


def _of_stretches(own: dict[str, list]) -> Columns:
    """The rows of stretches by the names that an operator gives their columns."""
    parts = []
    for stretch, side, names in zip(own[STRETCH], own["side"], own["names"], strict=True):
        found = stretch_columns(stretch)
        parts.append({TS: found[TS], SEQ: found[SEQ], "side": np.full(len(found[TS]), side)} | {a: found[b] for a, b in json.loads(names).items() if b in found})
    return _joined(parts)


def _exact(rows: DataFrame, never_null: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Whole numbers that may be null as 0 with a flag beside them: pandas would make doubles of them, which hold 53 bits."""
    names = [f.name for f in rows.schema.fields if f.nullable and f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and f.name not in never_null]
    pairs = [(n, f"null_of_{n}") for n in names]
    return rows.select(*(F.coalesce(n, F.lit(0).cast(rows.schema[n].dataType)).alias(n) if n in names else n for n in rows.columns), *(F.col(a).isNull().alias(b) for a, b in pairs)), pairs


def _in_form(df: DataFrame, keys: Sequence[str], side: int | Column, columns: dict[str, str], *more: Column) -> DataFrame:
    """The columns that the processor reads; those of :data:`OWN` that ``df`` lacks say no. Of stretches they are in the stretch, their names beside it."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    expected = F.coalesce(F.col("end_rows").cast("long"), F.lit(0).cast("long")) if "end_rows" in df.columns else F.lit(0).cast("long")
    number = side if isinstance(side, Column) else F.lit(side)
    if STRETCH in df.columns:
        return df.select(*keys, flag("is_end").alias("is_end"), expected.alias("end_rows"), number.alias("side"), F.lit(json.dumps(columns)).alias("names"), STRETCH, *more)
    own = [flag("is_end").alias("is_end"), flag("is_mark").alias("is_mark"), expected.alias("end_rows")]
    return df.select(*keys, TS, SEQ, number.alias("side"), *own, *(F.col(b).alias(a) for a, b in columns.items()), *more)


def stream_rows(df: DataFrame, keys: Sequence[str], side: int | Column = 0, delay: str = "0 seconds", **columns: str) -> DataFrame:
    """A stream in the form that :func:`apply_ordered` takes, with a watermark ``delay`` behind its latest time.

    ``df`` may also have stretches (keys, latest, stretch of :func:`stretch_bytes`, ends too). Where it has ``is_end``, such a row ends its key in this input; ``end_rows``, if there, is how many rows the input has of that key in all. A row with ``is_mark``
    says that nothing before its ts_ns will come.
    """
    stretches = STRETCH in df.columns
    own = _in_form(df, keys, side, columns, *([LATEST] if stretches else []))
    at = F.timestamp_micros(F.call_function("div", F.col(LATEST if stretches else TS), F.lit(1000)))
    at = at if stretches else F.when(~F.col("is_end"), at)
    # the watermark is the input's, but late rows are judged by key: so its column goes
    return own.withColumn(EVENT_TIME, at).withWatermark(EVENT_TIME, delay).drop(EVENT_TIME, LATEST if stretches else EVENT_TIME)


def chained_rows(df: DataFrame, keys: Sequence[str], side: int = 0, **columns: str) -> DataFrame:
    """The result of an operator with ``chained`` in the form that the next one takes; its watermark goes on."""
    return _in_form(df, keys, side, columns)


def together(inputs: Sequence[DataFrame]) -> DataFrame:
    """Several inputs as one; the least of their watermarks counts."""
    if len({STRETCH in x.columns for x in inputs}) > 1:
        raise StreamError("inputs have rows or stretches, not both")
    out = inputs[0]
    for other in inputs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


class InOrder(StatefulProcessor):
    """Applies a step at once to rows that come in order from batch to batch, and are sorted within one; ``step(state, row)`` gives columns of equal length.

    What a batch brings of a key is held, its results only up to FRAME_ROWS rows and those of one row.
    """

    def __init__(self, keys: Sequence[str], step: Callable[[dict, dict], dict[str, np.ndarray]]):
        self.keys, self.step = list(keys), step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", "data binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = pickle.loads(self.own.get()[0]) if self.own.exists() else {}
        held = sorted((row for frame in rows for row in frame.to_dict("records")), key=itemgetter(TS, SEQ))
        out, size = [], 0
        for row in held:
            found = self.step(state, row)
            out.append(found)
            size += len(found[TS])
            if size >= FRAME_ROWS:
                yield self.frame(key, out)
                out, size = [], 0
        self.own.update((pickle.dumps(state),))
        if size:
            yield self.frame(key, out)

    def frame(self, key: tuple, out: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        values = {c: np.concatenate([x[c] for x in out]) for c in out[0]}
        return pd.DataFrame({k: pd.Series([v] * len(values[TS]), dtype=object) for k, v in zip(self.keys, key, strict=True)} | values)


def follow_levels(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The level stream of a growing capture's blocks (``readStream.format("pulse_blocks")``): each batch adds the runs of the newly committed positions.

    The committed prefix brings a channel's blocks in order, so nothing waits; the state is the last bit of each channel.
    """
    spark = blocks.sparkSession
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    rows = blocks.select(*keys, (F.col("start_pos") * F.col("step_ns")).alias(TS), F.col("start_pos").alias(SEQ), "start_pos", "n", "step_ns", "data")
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{TS} long, {SEQ} long, value boolean"])
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(keys, block_runs), ddl, "Append", "None")


def latch_step(state: dict, row: dict) -> list[dict]:
    """Set (side 0) and reset (side 1) to level changes."""
    new = row["side"] == 0
    if state.get("value", False) == new:
        return []
    state["value"] = new
    return [{TS: row[TS], SEQ: row[SEQ], "value": new}]


def counter_step(start: int = 0, step: int = 1) -> Step:
    def count(state: dict, row: dict) -> list[dict]:
        state["n"] = state.get("n", 0) + 1
        return [{TS: row[TS], SEQ: row[SEQ], "value": start + step * state["n"]}]

    return count


def gate_step(active_high: bool = True) -> Step:
    """Level changes (side 0, ``level``) and events (side 1): events while active."""

    def gate(state: dict, row: dict) -> list[dict]:
        if row["side"] == 0:
            state["open"] = bool(row["level"]) == active_high
            return []
        return [{TS: row[TS], SEQ: row[SEQ]}] if state.get("open", not active_high) else []

    return gate


def logic_step(inputs: int, operation: str) -> Step:
    """Levels of several inputs (side: the input, ``level``) to changes of their combination; all start low."""

    def combined(values: list[bool]) -> bool:
        high = sum(values)
        plain = {"NOT": high == 0, "AND": high == len(values), "OR": high > 0, "XOR": high % 2 == 1, "NAND": high < len(values), "NOR": high == 0, "XNOR": high % 2 == 0}
        return plain[operation]

    def logic(state: dict, row: dict) -> list[dict]:
        values = state.setdefault("values", [False] * inputs)
        before = combined(values)
        values[row["side"]] = bool(row["level"])
        now = combined(values)
        return [{TS: row[TS], SEQ: row[SEQ], "value": now}] if now != before else []

    return logic


def holdoff_step(delay_ns: int = 0, holdoff_ns: int = 0, manual: bool = False) -> Step:
    """Rearms (side 0) and events (side 1): events thinned by hold-off and arm."""

    def control(state: dict, row: dict) -> list[dict]:
        if row["side"] == 0:
            state["armed"] = True
            return []
        if not state.get("armed", True) or row[TS] < state.get("allowed", row[TS]):
            return []
        state["allowed"], state["armed"] = row[TS] + holdoff_ns, not manual
        return [{TS: row[TS] + delay_ns, SEQ: row[SEQ]}]

    return control


def match_step(every: int = 1, holdoff_ns: int = 0, at: str = "end", manual: bool = False) -> Step:
    """Rearms (side 0) and matching words (side 1: ``duration_ns``, ``value``): the words that count, by the rules of ``match_words``."""

    def match(state: dict, row: dict) -> list[dict]:
        if row["side"] == 0:
            state["armed"], state["count"] = True, 0
            return []
        t = row[TS] + (row["duration_ns"] if at == "end" else 0)
        if not state.get("armed", True) or t < state.get("allowed", t):
            return []
        state["count"] = state.get("count", 0) + 1
        if state["count"] < every:
            return []
        state.update(count=0, allowed=t + holdoff_ns, armed=not manual)
        return [{TS: row[TS], SEQ: row[SEQ], "value": row["value"], "match_ns": t}]

    return match


def text_step(inputs: int, text: Callable[[list[int]], str]) -> Step:
    """Number levels of several inputs (side: the input, ``value``) to changes of their text; all start at 0."""

    def show(state: dict, row: dict) -> list[dict]:
        values = state.setdefault("values", [0] * inputs)
        values[row["side"]] = row["value"]
        now = text(values)
        if inputs > 1 and state.get("text") == now:
            return []
        state["text"] = now
        return [{TS: row[TS], SEQ: row[SEQ], "value": now}]

    return show


def route_step(state: dict, row: dict) -> list[dict]:
    """File names (side 0, ``name``) and words (side 1, ``value``): words with the file in force; those before the first name are left out.

    A word waits until the names' watermark has passed it, so that no name at or before it can still come.
    """
    if row["side"] == 0:
        state["name"], state["window"] = row["name"], state.get("window", 0) + 1
        return []
    return [{TS: row[TS], SEQ: row[SEQ], "value": row["value"], "filename": state["name"], "window": state["window"]}] if "name" in state else []


def numbered_route_step(front: str) -> Step:
    """As :func:`route_step` with names that count up: ``front`` and the number of the name row (side 0)."""

    def route(state: dict, row: dict) -> list[dict]:
        if row["side"] == 0:
            return route_step(state, row | {"name": f"{front}{state.get('window', 0) + 1}"})
        return route_step(state, row)

    return route


def edge_step(mode: str = "both", debounce_ns: int = 0, min_pulse_ns: int = 0) -> Step:
    """Rows with ``level`` to edge events."""

    def edge(state: dict, row: dict) -> list[dict]:
        new = bool(row["level"])
        if "value" not in state:
            state.update(value=new, since=row[TS])
            return []
        if new == state["value"]:
            return []
        wide = row[TS] - state["since"] >= min_pulse_ns
        state.update(value=new, since=row[TS])
        if not wide or mode == "rising" and not new or mode == "falling" and new or row[TS] - state.get("last", -(1 << 62)) < debounce_ns:
            return []
        state["last"] = row[TS]
        return [{TS: row[TS], SEQ: row[SEQ]}]

    return edge


def block_runs(state: dict, row: dict) -> dict[str, np.ndarray]:
    """Packed blocks in position order (``start_pos``, ``n``, ``step_ns``, ``data``) to the level rows they add, as columns."""
    bits = np.unpackbits(np.frombuffer(row["data"], np.uint8), bitorder="little")[: row["n"]]
    at = np.flatnonzero(np.diff(bits, prepend=state.get("last", bits[0] ^ 1))) if len(bits) else np.zeros(0, np.int64)
    if len(bits):
        state["last"] = bits[-1]
    place = row["start_pos"] + at
    return {TS: place * row["step_ns"], SEQ: place, "value": bits[at].astype(bool)}


def block_step(state: dict, row: dict) -> list[dict]:
    """As :func:`block_runs`, row by row."""
    return [{TS: t, SEQ: s, "value": v} for t, s, v in zip(*(x.tolist() for x in block_runs(state, row).values()), strict=True)]


def framer_step(fixed: int | None = None, max_gap_ns: int | None = None, max_words: int = 4096) -> tuple[Step, Finish]:
    """Boundaries (side 0) and words (side 1: ``duration_ns``, ``value``) to packets, and what a key's end leaves."""

    def close(state: dict) -> list[dict]:
        held = state.pop("words", [])
        return [{"start_ns": held[0][0], "end_ns": held[-1][1], "n_words": len(held), "values": [w[2] for w in held]}] if held else []

    def frame(state: dict, row: dict) -> list[dict]:
        if row["side"] == 0:
            return close(state)
        held = state.get("words", [])
        out = close(state) if held and max_gap_ns is not None and row[TS] - held[-1][1] > max_gap_ns else []
        state.setdefault("words", []).append((row[TS], row[TS] + row["duration_ns"], row["value"]))
        return out + (close(state) if len(state["words"]) >= min(fixed or max_words, max_words) else [])

    return frame, close


def framer_columns(fixed: int | None = None, max_gap_ns: int | None = None, max_words: int = 4096) -> ColumnStep:
    """As :func:`framer_step`, over columns."""
    limit = min(fixed or max_words, max_words)

    def frame(state: dict, rows: Columns, ended: bool) -> dict[str, Any]:
        names = (TS, "end", "value")
        held = state.pop("words", {c: np.zeros(0, np.int64) for c in names})
        # boundaries before each word, and before what comes next
        closed, now = np.zeros(len(held[TS]), np.int64), 0
        if _size(rows):
            word = rows["side"] != 0
            before = np.cumsum(~word)
            closed, now = np.append(closed, before[word]), int(before[-1])
            own = (rows[TS][word], rows[TS][word] + rows["duration_ns"][word], rows["value"][word])
            held = {c: np.append(held[c], v) for c, v in zip(names, own, strict=True)}
        n = len(held[TS])
        if not n:
            return {}
        cut = np.append(True, closed[1:] != closed[:-1])
        if max_gap_ns is not None:
            cut[1:] |= held[TS][1:] - held["end"][:-1] > max_gap_ns
        at = np.flatnonzero(cut)
        starts = np.flatnonzero((np.arange(n) - np.repeat(at, np.diff(at, append=n))) % limit == 0)
        ends = np.append(starts[1:], n)
        if not ended and now == closed[-1] and n - starts[-1] < limit:
            state["words"] = _some(held, slice(starts[-1], None))
            starts, ends = starts[:-1], ends[:-1]
        values = held["value"].tolist()
        listed = [values[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        return {"start_ns": held[TS][starts], "end_ns": held["end"][ends - 1], "n_words": ends - starts, "values": listed}

    return ColumnStep(frame)


def gap_sessions(words: DataFrame, keys: Sequence[str], gap: str, watermark: str, time: str = "ts") -> DataFrame:
    """Packets by pauses alone, with Spark's session windows: start, end, n_words."""
    windows = words.withWatermark(time, watermark).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n_words")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_words")


def presence_counts(words: DataFrame, keys: Sequence[str], width: str, watermark: str, time: str = "ts") -> DataFrame:
    """Words that start in each time window."""
    windows = words.withWatermark(time, watermark).groupBy(*keys, F.window(time, width).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n_words")).select(*keys, F.col("w.start").alias("start"), "n_words")
