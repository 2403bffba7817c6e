"""Sequences of counted conditions as one automaton over a timeline.

The state is the stage that is looked for, how far its count has come and whether the last row met it. A piece of a
timeline maps the state that it is entered with to the one it is left with; maps of pieces are applied in turn, so that one
sort serves any number of stages, and with time buckets many tasks share one timeline.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unsigned import floor_div
from ..schema import TS
from .timeline import pieces, scan_sorted


@dataclass(frozen=True)
class Counted:
    """A stage's count: of rows where its match begins, or of adjacent matching rows."""

    count: int
    adjacent: bool


#: Stage, count so far, whether the last row matched, time of the last completion (of the last stage only).
State = tuple[int, int, bool, int]
START: State = (0, 0, False, 0)


def begins_of(m: np.ndarray, on: bool) -> np.ndarray:
    """Rows where a match begins, ``on`` telling whether the row before the first one matched."""
    return np.flatnonzero(m & ~np.append(on, m[:-1]))


def runs_of(m: np.ndarray, carried: int = 0) -> np.ndarray:
    """How many adjacent rows up to each one match, with ``carried`` more before the first row."""
    at = np.arange(len(m))
    last_miss = np.maximum.accumulate(np.where(m, -1, at)) if len(m) else at
    return np.where(m, at - last_miss + np.where(last_miss < 0, carried, 0), 0)


def advance(state: State, stages: Sequence[Counted], ts: np.ndarray, masks: np.ndarray) -> State:
    """The state behind a piece of a timeline; bit k of ``masks`` tells whether a row meets stage k."""
    k, c, on, at = state
    i, n = 0, len(ts)
    while k < len(stages) and i < n:
        m = (masks[i:] >> k) & 1 == 1
        if stages[k].adjacent:
            runs = runs_of(m, c)
            hits = np.flatnonzero(runs >= stages[k].count)
            done = int(hits[0]) if len(hits) else None
            c = int(runs[-1])
        else:
            begins, need = begins_of(m, on), stages[k].count - c
            done = int(begins[need - 1]) if len(begins) >= need else None
            c, on = c + len(begins), bool(m[-1])
        if done is None:
            break
        at = int(ts[i + done])
        i = int(np.searchsorted(ts, at, "right"))
        k, c, on = k + 1, 0, False
    return k, c, on, at


def _fresh(stages: Sequence[Counted], ts: np.ndarray, masks: np.ndarray) -> list[np.ndarray]:
    """For each stage (and the end, last) the states behind the piece if the stage is first looked for at each of its rows or behind it."""
    n = len(ts)
    places = np.arange(n + 1)
    behind = np.searchsorted(ts, ts, "right")
    out = [np.empty((n + 1, 4), np.int64)]
    for k in range(len(stages) - 1, -1, -1):
        m = (masks >> k) & 1 == 1
        need = stages[k].count
        if stages[k].adjacent:
            runs = runs_of(m)
            hits = np.flatnonzero(runs >= need)
            which = np.searchsorted(hits, places + need - 1)
            count, on = np.minimum(runs[-1], n - places), np.zeros(n + 1, bool)
        else:
            hits = begins_of(m, False)
            earlier = np.searchsorted(hits, places)
            # a search that begins inside a run of matches counts its own first row
            inside = np.append(m, False) & ~np.isin(places, hits)
            which = earlier + need - 1 - inside
            count, on = len(hits) - earlier + inside, (places < n) & m[-1]
            own = inside & (need == 1)
        done = which < len(hits)
        x = np.append(hits, n)[np.minimum(which, len(hits))]
        if not stages[k].adjacent:
            x, done = np.where(own, places, x), done | own
        state = np.stack([np.full(n + 1, k), count, on, np.zeros(n + 1, np.int64)], axis=1)
        state[done] = _behind(k, x[done], len(stages), ts, behind, out[0])
        out.insert(0, state)
    return out


def _behind(k: int, x: np.ndarray, stages: int, ts: np.ndarray, behind: np.ndarray, following: np.ndarray) -> np.ndarray:
    """States behind the piece if stage k is completed at rows ``x``."""
    if k + 1 == stages:
        return np.stack([np.full(len(x), stages), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), ts[x]], axis=1)
    return following[behind[x]]


def piece_maps(stages: Sequence[Counted], ts: np.ndarray, masks: np.ndarray) -> list[dict]:
    """What a piece makes of every state: for each stage a map from what its count still needs to the state behind.

    ``upto`` are the last needs of stretches that lead to one state, ``to`` these states. ``skip``: a match that goes on from the
    row before doesn't begin here. Needs beyond all stretches add ``more`` to the count, or lead to the state ``rest``. A map
    has at most as many stretches as the stage counts and as the piece has matches.
    """
    fresh = _fresh(stages, ts, masks)
    behind = np.searchsorted(ts, ts, "right")
    out = []
    for k, stage in enumerate(stages):
        m = (masks >> k) & 1 == 1
        rest = None
        if stage.adjacent:
            length = len(m) if m.all() else int(np.argmin(m))
            hits, skip, more = np.arange(min(length, stage.count)), False, length
            if length < len(m):
                rest = fresh[k][length].tolist()
        else:
            begins = begins_of(m, False)
            hits, skip, more = begins[: stage.count + 1], bool(m[0]), len(begins)
        to = _behind(k, hits, len(stages), ts, behind, fresh[k + 1])
        turn = np.flatnonzero(np.append((to[1:] != to[:-1]).any(axis=1), True)) if len(hits) else np.zeros(0, np.int64)
        out.append({"stage": k, "upto": (turn + 1).tolist(), "to": to[turn].ravel().tolist(), "skip": skip, "more": more, "on": bool(m[-1]), "rest": rest})
    return out


def apply_map(state: State, stage: Counted, found: dict) -> State:
    """The state behind a piece, by the piece's map for the stage of ``state``."""
    k, c, on, at = state
    skipped = int(on and found["skip"]) if not stage.adjacent else 0
    i = int(np.searchsorted(found["upto"], stage.count - c + skipped))
    if i < len(found["upto"]):
        k, c, on, at = found["to"][4 * i : 4 * i + 4]
        return k, c, bool(on), at
    if found["rest"] is not None:
        k, c, on, at = found["rest"]
        return k, c, bool(on), at
    return k, c + found["more"] - skipped, not stage.adjacent and found["on"], at


def completions(rows: DataFrame, keys: Sequence[str], stages: Sequence[Counted], bucket_ns: int | None = None) -> DataFrame:
    """keys, trigger_ns: where each key of ``rows`` (keys, ts_ns, ``_m``) completes all stages one after the other.

    A row's bit k of ``_m`` tells whether it meets stage k; a key has one row for each time. Keys that don't complete are left out. Without
    ``bucket_ns`` each key's rows are one sorted pass; with it, buckets go to different tasks, and a row for each stage of each piece of a bucket is what a key's own pass reads.
    """
    of_keys = [rows.schema[k] for k in keys]
    result = T.StructType([*of_keys, T.StructField("trigger_ns", T.LongType())])
    last = len(stages)

    def finished(own: pa.RecordBatch, at: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(k)).slice(0, 1) for k in keys), pa.array([at], pa.int64())], names=[*keys, "trigger_ns"])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = START
        for first, own in pieces(batches, keys):
            state = START if first else state
            if state[0] < last:
                state = advance(state, stages, own.column(len(keys)).to_numpy(), own.column(len(keys) + 1).to_numpy())
                if state[0] == last:
                    yield finished(own, state[3])

    slim = rows.select(*keys, TS, "_m")
    if bucket_ns is None:
        return scan_sorted(slim, keys, [TS], direct, result)
    parts = [*keys, "_bucket"]
    longs = T.ArrayType(T.LongType())
    fields = {"stage": T.LongType(), "upto": longs, "to": longs, "skip": T.BooleanType(), "more": T.LongType(), "on": T.BooleanType(), "rest": longs}
    kinds = {"stage": pa.int64(), "upto": pa.list_(pa.int64()), "to": pa.list_(pa.int64()), "skip": pa.bool_(), "more": pa.int64(), "on": pa.bool_(), "rest": pa.list_(pa.int64())}
    table = T.StructType([*of_keys, T.StructField("_at", T.LongType()), *(T.StructField(f"_{n}", kind) for n, kind in fields.items())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in pieces(batches, parts):
            ts = own.column(len(parts)).to_numpy()
            maps = piece_maps(stages, ts, own.column(len(parts) + 1).to_numpy())
            ids = own.select(list(keys)).take(pa.array([0] * last)).columns if keys else []
            values = [pa.array([x[n] for x in maps], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([int(ts[0])] * last, pa.int64()), *values], names=[*keys, "_at", *(f"_{n}" for n in kinds)])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, piece = START, None
        for first, own in pieces(batches, keys):
            if first:
                state, piece = START, None
            for row in own.select(range(len(keys), own.num_columns)).to_pylist():
                if row["_at"] != piece and row["_stage"] == state[0]:
                    piece = row["_at"]
                    state = apply_map(state, stages[state[0]], {n: row[f"_{n}"] for n in kinds})
                    if state[0] == last:
                        yield finished(own, state[3])

    maps = scan_sorted(slim.withColumn("_bucket", floor_div(F.col(TS), bucket_ns)).select(*parts, TS, "_m"), parts, [TS], mapped, table)
    return scan_sorted(maps, keys, ["_at", "_stage"], walked, result)
