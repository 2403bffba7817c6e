"""Decoders over packed blocks: 64 samples to a machine word, without exploding samples or changes.

Blocks of all channels that begin at one position are one fragment, a row. A fragment is scanned by itself with bit operations: a channel's
changes are ``w ^ (w << 1 | bit before)``. What a fragment has to know of those before it are a few bits and numbers, which windows over one small row per
fragment give: each channel's last bit, how many samples were accepted and how many since assembly last began anew. Words that lie in one
fragment are put together there by array operations; of a word that crosses fragments each gives its piece, and pieces are joined by the number
of the word's first sample. The result doesn't depend on the fragments' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timeline import same_parts, settled
from ..schema import SEQ, TS, StreamError

ONE, TOP = np.uint64(1), np.uint64(63)
#: Whole words of a batch that is handed on, at least, unless a scan ends.
BATCH_WORDS = 100_000


def last_bit(data: Column, n: Column) -> Column:
    """The last sample of a packed block, 0 or 1."""
    byte = F.conv(F.hex(F.substring(data, F.floor((n - 1) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, ((n - 1) % 8).cast("int")).bitwiseAND(F.lit(1))


def bits_before(blocks: DataFrame, keys: Sequence[str], data: dict[str, str]) -> DataFrame:
    """keys, start_pos and, for each name of ``data``, the last bit of that column in the block before; null at the first.

    Only one byte of each block goes into the window, not the packed samples.
    """
    last = blocks.select(*keys, "start_pos", *(last_bit(F.col(column), F.col("n")).alias(name) for name, column in data.items()))
    w = Window.partitionBy(*keys).orderBy("start_pos")
    return last.select(*keys, "start_pos", *(F.lag(name).over(w).alias(name) for name in data))


class Bits:
    """A channel's samples of one fragment as 64-bit words, and the sample before it."""

    def __init__(self, data: bytes | None, n: int, before: int):
        size = -(-n // 64) * 8
        self.words = np.frombuffer((data or b"")[:size].ljust(size, b"\0"), "<u8")
        self.before = np.uint64(before)

    def shifted(self) -> np.ndarray:
        """Each sample's predecessor in its place."""
        out = self.words << ONE
        out[1:] |= self.words[:-1] >> TOP
        out[:1] |= self.before
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64)) & ONE


def valid(n: int) -> np.ndarray:
    """Words whose first ``n`` bits are set."""
    out = np.full(-(-n // 64), ~np.uint64(0))
    if n % 64:
        out[-1] = (ONE << np.uint64(n % 64)) - ONE
    return out


def places(mask: np.ndarray) -> np.ndarray:
    """Positions of the set bits; only words that have any are unpacked."""
    some = np.flatnonzero(mask)
    if not len(some):
        return some
    row, bit = np.nonzero(np.unpackbits(mask[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[row] * 64 + bit


#: What a scan finds in a fragment: accepted samples, restarts of assembly (never both at one place), and the values of accepted samples by output.
Scan = Callable[[dict[str, Bits], int], tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]]


@dataclass
class Assembly:
    """How accepted samples become words: ``cycles`` samples of ``width`` bits each, the first one lowest or highest."""

    scan: Scan
    outputs: list[str]
    cycles: int
    width: int
    first_low: bool

    def shift(self, phase: np.ndarray) -> np.ndarray:
        return ((phase if self.first_low else self.cycles - 1 - phase) * self.width).astype(np.uint64)


def fragments(blocks: DataFrame, keys: Sequence[str], channels: dict[str, int]) -> DataFrame:
    """One row for each start position: keys, start_pos, n, step_ns, the data of each named channel, and its bit before."""
    own = blocks.where(F.col("channel").isin(sorted(set(channels.values()))))
    data = {f"data_{name}": F.first(F.when(F.col("channel") == c, F.col("data")), ignorenulls=True) for name, c in channels.items()}
    rows = settled(own.groupBy(*keys, "start_pos").agg(F.max("n").alias("n"), F.max("step_ns").alias("step_ns"), *(x.alias(name) for name, x in data.items())))
    return same_parts(rows, bits_before(rows, keys, {f"before_{x}": f"data_{x}" for x in channels}), [*keys, "start_pos"], "left")


def _scanned(batch: pa.RecordBatch, keys: Sequence[str], names: Sequence[str], scan: Scan, unknown: dict[str, int]) -> Iterator[tuple]:
    """Row number, start_pos, step_ns and what the scan finds for each fragment of a batch."""
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    starts, sizes, steps = (column[c].to_pylist() for c in ("start_pos", "n", "step_ns"))
    for i in range(batch.num_rows):
        n, bits = sizes[i], {}
        for name in names:
            before = column[f"before_{name}"][i].as_py()
            held = column[f"data_{name}"][i].as_buffer()
            data = held.to_pybytes() if held is not None else None
            bits[name] = Bits(data, n, (unknown[name] if unknown[name] >= 0 else (data or b"\0")[0] & 1) if before is None else before)
        accepted, restarts, values = scan(bits, n)
        inside = valid(n)
        yield i, starts[i], steps[i], accepted & inside, restarts & inside, values


def assemble(rows: DataFrame, keys: Sequence[str], names: Sequence[str], assembly: Assembly, unknown: dict[str, int]) -> DataFrame:
    """keys, ts_ns, seq (position), duration_ns and a value for each output of every whole word of ``fragments``.

    ``unknown`` gives the sample before a channel's first one, -1 for the first one's own value.
    """
    cycles, k = assembly.cycles, len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, _, accepted, restarts, _ in _scanned(batch, keys, names, assembly.scan, unknown):
                number, cut, last = int(np.bitwise_count(accepted).sum()), np.flatnonzero(restarts), 0
                if len(cut):
                    word = int(cut[-1])
                    bit = int(restarts[word]).bit_length()
                    last = int(np.bitwise_count(accepted[word + 1 :]).sum()) + (int(accepted[word]) >> bit).bit_count()
                found.append((number, last if len(cut) else None))
            columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(k)), batch.column(batch.schema.get_field_index("start_pos")), *columns], names=[*keys, "start_pos", "accepted", "since"])

    schema = rows.select(*keys, "start_pos").schema.add("accepted", "long").add("since", "long")
    sums = rows.mapInArrow(count, schema)
    w = Window.partitionBy(*keys).orderBy("start_pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # of the fragments before: all accepted ones, and those accepted up to the last restart, counted up to the fragment that holds it
    sums = sums.withColumn("total", F.coalesce(F.sum("accepted").over(w), zero))
    sums = sums.withColumn("origin", F.when(F.col("since").isNotNull(), F.col("total") + F.col("accepted") - F.col("since")))
    sums = sums.select(*keys, "start_pos", "total", F.coalesce(F.last("origin", ignorenulls=True).over(w), zero).alias("origin"))
    known = same_parts(rows, sums, [*keys, "start_pos"], "left")

    def words(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                totals, origins = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("total", "origin"))
                held, size = [], 0
                for i, start, step, accepted, restarts, values in _scanned(batch, keys, names, assembly.scan, unknown):
                    at = places(accepted)
                    if len(at):
                        held.append((i, *_words(assembly, at, places(restarts), totals[i], origins[i], values, start, step, whole)))
                        size += len(held[-1][1])
                    if size >= BATCH_WORDS:
                        yield _batch(batch, keys, held, assembly.outputs)
                        held, size = [], 0
                if size:
                    yield _batch(batch, keys, held, assembly.outputs)

        return run

    out = rows.select(*keys).schema.add("word", "long").add("n", "long").add(TS, "long").add("last_ns", "long").add(SEQ, "long")
    for name in assembly.outputs:
        out = out.add(name, "long")
    done = known.mapInArrow(words(True), out)
    if cycles > 1:
        ends = [F.sum("n").alias("n"), F.min(TS).alias(TS), F.max("last_ns").alias("last_ns"), F.min(SEQ).alias(SEQ)]
        joined = known.mapInArrow(words(False), out).groupBy(*keys, "word").agg(*ends, *(F.bit_or(x).alias(x) for x in assembly.outputs))
        done = done.unionByName(joined.where(F.col("n") == cycles))
    return done.select(*keys, TS, SEQ, (F.col("last_ns") - F.col(TS)).alias("duration_ns"), *assembly.outputs)


def _words(assembly: Assembly, at: np.ndarray, cuts: np.ndarray, total: int, origin: int, values: Callable[[np.ndarray], list[np.ndarray]], start: int, step: int, whole: bool) -> tuple:
    """Words that lie in a fragment, or the pieces of those that reach over its ends: first sample's number, samples, first and last time, position, values."""
    cycles, index = assembly.cycles, np.arange(len(at))
    back = np.searchsorted(cuts, at)
    begin = np.where(back > 0, total + np.searchsorted(at, cuts)[np.maximum(back - 1, 0)] if len(cuts) else 0, origin)
    phase = (total + index - begin) % cycles
    word = total + index - phase
    first = np.flatnonzero(np.diff(word, prepend=word[0] - 1))
    size = np.diff(np.append(first, len(at)))
    if whole:
        take = size == cycles
    else:
        take = size < cycles
        take[1:-1] = False
        if len(take) > 1:
            take[0] &= word[0] < total
        if len(cuts) and cuts[-1] > at[-1]:
            take[-1] &= word[first[-1]] < total
    first, size = first[take], size[take]
    own = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    edges = np.cumsum(size) - size
    shift = assembly.shift(phase[own])
    out = [np.bitwise_or.reduceat(v << shift, edges).view(np.int64) if len(edges) else np.zeros(0, np.int64) for v in values(at[own])]
    head, tail = start + at[first], start + at[first + size - 1]
    return (word[first], size, head * step, tail * step, head, *out)


def _batch(batch: pa.RecordBatch, keys: Sequence[str], held: list[tuple], outputs: Sequence[str]) -> pa.RecordBatch:
    own = pa.array(np.repeat([x[0] for x in held], [len(x[1]) for x in held]))
    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in list(zip(*held, strict=True))[1:]]
    return pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in range(len(keys))), *columns], names=[*keys, "word", "n", TS, "last_ns", SEQ, *outputs])


def spi(blocks: DataFrame, keys: Sequence[str], clock: int, cs: int | None, lines: dict[str, int], mode: int = 0, bits: int = 8, cs_active: str = "low", msb_first: bool = True) -> DataFrame:
    """Words of serial lines from packed blocks: line, ts_ns (first edge), seq (its position), duration_ns, value.

    As ``decode.spi`` on the channels' levels: clock edges strictly inside a chip-select window, data just before the edge, incomplete words dropped. ``clock``, ``cs`` and ``lines``
    are channel numbers; blocks of all channels begin at the same positions. A position without a block of a channel is low there.
    """
    if bits > 64:
        raise StreamError("a word has at most 64 bits")
    selected = cs is not None and cs_active != "disabled"
    channels = {"clock": clock, **({"cs": cs} if selected else {}), **{f"line_{x}": c for x, c in lines.items()}}
    rising, high = mode in (0, 3), cs_active == "high"

    def scan(held: dict[str, Bits], n: int) -> tuple:
        w, before = held["clock"].words, held["clock"].shifted()
        edges = w & ~before if rising else before & ~w
        restarts = np.zeros_like(w)
        if selected:
            x = held["cs"]
            active, was = (x.words, x.shifted()) if high else (~x.words, ~x.shifted())
            edges, restarts = edges & active & was, active & ~was
        past = [Bits(None, n, 0) for _ in lines]
        for own, name in zip(past, lines, strict=True):
            own.words = held[f"line_{name}"].shifted()
        return edges, restarts, lambda at: [own.at(at) for own in past]

    unknown = {name: 0 for name in channels} | {"clock": -1} | ({"cs": 0 if high else 1} if selected else {})
    found = assemble(fragments(blocks, keys, channels), keys, list(channels), Assembly(scan, list(lines), bits, 1, not msb_first), unknown)
    tall = F.inline(F.array(*(F.struct(F.lit(x).alias("line"), F.col(x).alias("value")) for x in lines)))
    return found.select(*keys, TS, SEQ, "duration_ns", tall).select(*keys, "line", TS, SEQ, "duration_ns", "value")


def parallel_bus(
    blocks: DataFrame, keys: Sequence[str], strobe: int, data: Sequence[int], mode: str = "rising", cycles: int = 1, little_endian: bool = True,
    enable: int | None = None, enable_high: bool = True, cs: int | None = None, cs_active: str = "low",
) -> DataFrame:
    """Words of a parallel bus from packed blocks: ts_ns, seq (position), duration_ns, value; as ``decode.parallel_bus`` on the channels' levels.

    ``strobe``, ``data``, ``enable`` and ``cs`` are channel numbers. A strobe before its first sample counts as low.
    """
    if len(data) * cycles > 64 or mode not in ("rising", "falling", "any", "high", "low"):
        raise StreamError("a word has at most 64 bits; the strobe's mode is rising, falling, any, high or low")
    controls = {name: (c, high) for name, c, high in (("enable", enable, enable_high), ("cs", cs, cs_active == "high")) if c is not None}
    channels = {"strobe": strobe, **{name: c for name, (c, _) in controls.items()}, **{f"line_{i}": c for i, c in enumerate(data)}}

    def scan(held: dict[str, Bits], n: int) -> tuple:
        w = held["strobe"].words
        before = held["strobe"].shifted()
        hits = {"rising": w & ~before, "falling": before & ~w, "any": w ^ before, "high": w, "low": ~w}[mode]
        ok, off = ~np.zeros_like(w), np.zeros_like(w)
        for name, (_, high) in controls.items():
            x = held[name]
            active, was = (x.words, x.shifted()) if high else (~x.words, ~x.shifted())
            ok, off = ok & active, off | (was & ~active)

        def values(at: np.ndarray) -> list[np.ndarray]:
            bus = np.zeros(len(at), np.uint64)
            for i in range(len(data)):
                bus |= held[f"line_{i}"].at(at) << np.uint64(i)
            return [bus]

        return hits & ok, (hits & ~ok) | off, values

    unknown = {name: 0 for name in channels}
    return assemble(fragments(blocks, keys, channels), keys, list(channels), Assembly(scan, ["value"], cycles, len(data), little_endian), unknown)
