"""Serial and parallel protocols: level streams to words and packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import TAGS
from ..functions.unsigned import floor_div
from ..schema import SEQ, TS, StreamError
from .levels import transitions
from .timeline import EVER, after, along, as_of, before, changes, greedy, latest, merged, number_within, part_codes, same_parts, total


def _bits(order: Column, count: int, msb_first: bool) -> Column:
    """Place of the bit that came at ``order`` (from 0) among ``count``."""
    return F.lit(count) - 1 - order if msb_first else order


def _value(bit: Column, place: Column) -> Column:
    return F.bit_or(F.when(bit, F.expr("1L")).otherwise(F.expr("0L")) * F.when(place < 63, F.pow(F.lit(2.0), place).cast("long")).otherwise(F.lit(-(1 << 63))))


def uart(
    line: DataFrame, keys: Sequence[str], baud: float, data_bits: int = 8, parity: str = "none", stop_bits: float = 1, msb_first: bool = False, inverted: bool = False, bucket_ns: int | None = None
) -> DataFrame:
    """Frames of a serial line: ts_ns, seq, duration_ns, value, framing_error, parity_error.

    A frame starts at a row of the start level and is read at bit middles; the next start is looked for from a
    quarter bit before its end. A word with an error is given all the same. The last level holds forever.
    Without ``bucket_ns`` the rows are sorted once and read in one pass, of which a batch and the open frame are in memory.
    """
    if not 5 <= data_bits <= 9 or parity not in ("none", "odd", "even", "mark", "space"):
        raise StreamError("5 to 9 data bits; parity none, odd, even, mark or space")
    bit = 1e9 / baud
    with_parity = parity != "none"
    frame = 1 + data_bits + with_parity + stop_bits
    level = changes(line, keys, bucket_ns=bucket_ns).withColumn("value", F.col("value") != F.lit(inverted))
    hold = int((frame - 0.25) * bit + 0.5)
    offsets = [int((1.5 + i) * bit + 0.5) for i in range(data_bits + with_parity)]
    if stop_bits:
        offsets.append(int((1 + data_bits + with_parity + min(stop_bits, 1) / 2) * bit + 0.5))
    if bucket_ns is None:
        rows = level.select(*keys, TS, SEQ, "value").sortWithinPartitions(*keys, TS, SEQ)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{TS} long, {SEQ} long, duration_ns long, value long, framing_error boolean, parity_error boolean"])
        return rows.mapInArrow(_frames(list(keys), hold, offsets, int(frame * bit + 0.5), data_bits, parity, msb_first), ddl)
    starts = greedy(level.where(~F.col("value")).select(*keys, TS, SEQ), keys, hold, bucket_ns=bucket_ns)
    reads = F.posexplode(F.array(*(F.lit(x).cast("long") for x in offsets)))
    probes = starts.select(*keys, F.col(TS).alias("_start"), F.col(SEQ).alias("_seq"), reads.alias("_k", "_off"))
    probes = probes.select(*keys, (F.col("_start") + F.col("_off")).alias(TS), F.col("_k").cast("long").alias(SEQ), "_start", "_seq", "_k")
    read = as_of(probes, level, keys, {"value": "_bit"}, bucket_ns=bucket_ns)
    is_data = F.col("_k") < data_bits
    place = _bits(F.col("_k"), data_bits, msb_first)
    stop_at = data_bits + with_parity
    words = read.groupBy(*keys, "_start", "_seq").agg(
        _value(is_data & F.col("_bit"), F.when(is_data, place).otherwise(0)).alias("value"),
        F.coalesce(F.bool_or((F.col("_k") == stop_at) & ~F.col("_bit")), F.lit(False)).alias("framing_error"),
        F.bool_or((F.col("_k") == data_bits) & F.col("_bit")).alias("_parity"),
    )
    ones = F.bit_count("value") % 2 == 1
    expected = {"odd": ~ones, "even": ones, "mark": F.lit(True), "space": F.lit(False), "none": F.lit(False)}[parity]
    return words.select(
        *keys,
        F.col("_start").alias(TS),
        F.col("_seq").alias(SEQ),
        F.lit(int(frame * bit + 0.5)).cast("long").alias("duration_ns"),
        "value",
        "framing_error",
        (F.col("_parity") != expected if with_parity else F.lit(False)).alias("parity_error"),
    )


def _frames(keys: list[str], hold: int, offsets: list[int], duration: int, data_bits: int, parity: str, msb_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The frames of level changes (keys, ts_ns, seq, value) that come sorted by key and time: a pass over batches that hold many keys or a piece of one.

    Keys are laid end to end on one axis, so that starts and reads of a whole batch are found by binary search. What a batch can't decide, the frame
    that is open at its end or the level that holds there, goes before the next one.
    """
    at, reach = np.array(offsets, np.int64), max(hold, offsets[-1]) + 1
    names = [*keys, TS, SEQ, "duration_ns", "value", "framing_error", "parity_error"]
    with_parity = parity != "none"

    def decoded(rows: pa.RecordBatch, allowed: int, final: bool) -> Iterator[pa.RecordBatch | tuple[pa.RecordBatch, int]]:
        """Batches of frames and at last, unless ``final``, what is kept and from when on a frame may start."""
        new = part_codes(rows, keys)
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        ts, seq = (rows.column(len(keys) + i).to_numpy() for i in (0, 1))
        level = rows.column(len(keys) + 2)
        high, low = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (level, pc.invert(level)))
        since = ts - ts[first][group]
        span = int(since.max()) + reach + 1
        if len(first) > 1 and span > (1 << 62) // len(first):
            half = int(first[len(first) // 2])
            yield from decoded(rows.slice(0, half), allowed, True)
            yield from decoded(rows.slice(half), EVER, final)
            return
        place = since + group * span
        falls = np.flatnonzero(low & ((group > 0) | (ts >= allowed)))
        following, chosen, i = np.searchsorted(place[falls], place[falls] + hold).tolist(), [], 0
        while i < len(following):
            chosen.append(i)
            i = following[i]
        starts = falls[np.array(chosen, np.int64)]
        rest = None
        if not final:
            done = int(np.count_nonzero((group[starts] < group[-1]) | (ts[starts] + at[-1] < ts[-1])))
            rest = int(starts[done]) if done < len(starts) else len(ts) - 1
            starts = starts[:done]
            if done and group[starts[-1]] == group[-1]:
                allowed = int(ts[starts[-1]]) + hold
            elif group[-1] > 0:
                allowed = EVER
        if len(starts):
            read = np.searchsorted(place, (place[starts][:, None] + at).ravel(), "right") - 1
            bits = high[read].reshape(len(starts), -1)
            value = np.zeros(len(starts), np.int64)
            for k in range(data_bits):
                value |= bits[:, k].astype(np.int64) << (data_bits - 1 - k if msb_first else k)
            no = np.zeros(len(starts), bool)
            odd = bits[:, :data_bits].sum(1) % 2 == 1
            expected = {"odd": ~odd, "even": odd, "mark": ~no, "space": no, "none": no}[parity]
            bad_stop = low[read].reshape(bits.shape)[:, -1] if len(at) > data_bits + with_parity else no
            bad_parity = bits[:, data_bits] != expected if with_parity else no
            of_keys = (rows.column(j).take(pa.array(starts)) for j in range(len(keys)))
            yield pa.RecordBatch.from_arrays([*of_keys, *map(pa.array, (ts[starts], seq[starts], np.full(len(starts), duration), value, bad_stop, bad_parity))], names=names)
        if rest is not None:
            yield rows.slice(rest), allowed

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, allowed = None, EVER
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            for found in decoded(rows, allowed, False):
                if isinstance(found, tuple):
                    held, allowed = found
                else:
                    yield found
        if held is not None:
            yield from decoded(held, allowed, True)

    return read


def uart_errors(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error events of :func:`uart` words, at their start."""
    return words.where("framing_error or parity_error").select(*keys, TS, SEQ)


def uart_frames(words: DataFrame, keys: Sequence[str], baud: float, stop_bits: float = 1) -> DataFrame:
    """Start, data and stop (or error) pieces of each frame; tags are the three largest unsigned numbers."""
    bit = int(1e9 / baud + 0.5)
    stop = int(stop_bits * bit)
    bad = F.col("framing_error") | F.col("parity_error")
    pieces = F.array(
        F.struct(F.col(TS).alias("t"), F.lit(bit).cast("long").alias("d"), F.lit(TAGS["start"]).alias("v")),
        F.struct((F.col(TS) + bit).alias("t"), (F.col("duration_ns") - bit - stop).alias("d"), F.col("value").alias("v")),
        F.struct((F.col(TS) + F.col("duration_ns") - stop).alias("t"), F.lit(stop).cast("long").alias("d"), F.when(bad, F.lit(TAGS["error"])).otherwise(F.lit(TAGS["stop"])).alias("v")),
    )
    return words.select(*keys, SEQ, F.inline(pieces)).select(*keys, F.col("t").alias(TS), SEQ, F.col("d").alias("duration_ns"), F.col("v").alias("value"))


NEVER = -1


def spi_samples(
    clock: DataFrame, cs: DataFrame | None, lines: dict[str, DataFrame], keys: Sequence[str], mode: int = 0, cs_active: str = "low", bucket_ns: int | None = None
) -> DataFrame:
    """Sampling points: edges of the mode's direction strictly inside a window, with each line's level just before.

    ``_start`` and ``_end`` tell the window (end null: still open). Without chip select the whole capture is one window
    from NEVER on. Clock, chip select and lines are merged and sorted once.
    """
    rising = mode in (0, 3)
    edges = transitions(clock, keys, bucket_ns).where(F.col("value") == F.lit(rising))
    rows = edges.select(*keys, TS, SEQ, F.lit(0).alias("_input"))
    if cs is not None and cs_active != "disabled":
        level = along(changes(cs, keys, bucket_ns=bucket_ns), keys, {"_next": after(TS)}, bucket_ns=bucket_ns)
        window = F.when(F.col("value") == F.lit(cs_active == "high"), F.struct(F.col(TS).alias("start"), F.col("_next").alias("end")))
        rows = rows.unionByName(level.select(*keys, TS, SEQ, F.lit(1).alias("_input"), F.struct(window.alias("x")).alias("_cs")), allowMissingColumns=True)
    for i, (name, line) in enumerate(lines.items(), 2):
        rows = rows.unionByName(line.select(*keys, TS, SEQ, F.lit(i).alias("_input"), F.struct(F.col("value").alias("x")).alias(f"_{name}")), allowMissingColumns=True)
    held = [*(["cs"] if "_cs" in rows.columns else []), *lines]
    found = along(rows, keys, {f"_held_{x}": latest(f"_{x}") for x in held}, ["_input"], bucket_ns).where("_input = 0")
    bits = [F.coalesce(F.col(f"_held_{x}.x"), F.lit(False)).alias(f"bit_{x}") for x in lines]
    if "_cs" not in rows.columns:
        return found.select(*keys, TS, SEQ, F.lit(NEVER).cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"), *bits)
    window = F.col("_held_cs.x")
    return found.select(*keys, TS, SEQ, window["start"].alias("_start"), window["end"].alias("_end"), *bits).where(f"_start is not null and (_end is null or {TS} < _end)")


def _spi_cells(samples: DataFrame, keys: Sequence[str], bits: int, bucket_ns: int | None) -> DataFrame:
    """Samples with the number of their word in its window, and of their bit in the word."""
    rows = along(samples, keys, {"_last": before("_start")}, bucket_ns=bucket_ns)
    rows = number_within(rows, keys, ~F.col("_start").eqNullSafe(F.col("_last")), "_number", (), bucket_ns)
    return rows.withColumns({"_word": F.expr("0L") + F.floor(F.col("_number") / bits), "_bit": F.col("_number") % bits})


def _spi_words(cells: DataFrame, names: Sequence[str], keys: Sequence[str], bits: int, msb_first: bool) -> DataFrame:
    """One row for each word, whole or not, with its number of bits."""
    place = _bits(F.col("_bit"), bits, msb_first)
    return cells.groupBy(*keys, "_start", "_end", "_word").agg(
        F.min(TS).alias(TS), (F.max(TS) - F.min(TS)).alias("duration_ns"), F.count(F.lit(1)).alias("_n"), *(_value(F.col(f"bit_{x}"), place).alias(x) for x in names)
    )


def spi(
    clock: DataFrame, cs: DataFrame | None, lines: dict[str, DataFrame], keys: Sequence[str], mode: int = 0, bits: int = 8, cs_active: str = "low", msb_first: bool = True, bucket_ns: int | None = None
) -> DataFrame:
    """Words of each line (mosi, miso): line, ts_ns (first edge), seq (number in its window), duration_ns, value, window_ns."""
    cells = _spi_cells(spi_samples(clock, cs, lines, keys, mode, cs_active, bucket_ns), keys, bits, bucket_ns)
    whole = _spi_words(cells, list(lines), keys, bits, msb_first).where(F.col("_n") == bits)
    tall = F.inline(F.array(*(F.struct(F.lit(x).alias("line"), F.col(x).alias("value")) for x in lines)))
    return whole.select(*keys, "_start", "_word", TS, "duration_ns", tall).select(
        *keys, "line", TS, F.col("_word").alias(SEQ), "duration_ns", "value", F.col("_start").alias("window_ns")
    )


def spi_transactions(
    clock: DataFrame,
    cs: DataFrame | None,
    lines: dict[str, DataFrame],
    keys: Sequence[str],
    mode: int = 0,
    bits: int = 8,
    cs_active: str = "low",
    msb_first: bool = True,
    most_words: int = 65_536,
    bucket_ns: int | None = None,
) -> DataFrame:
    """One packet for each window, empty ones too: start_ns, end_ns, part, words by line, incomplete_bits, complete.

    A window of more than ``most_words`` words is given in parts of so many, so that no list grows without bound (a
    capture without chip select is one window); the last part tells of incomplete bits.
    """
    cells = _spi_cells(spi_samples(clock, cs, lines, keys, mode, cs_active, bucket_ns), keys, bits, bucket_ns)
    words = _spi_words(cells, list(lines), keys, bits, msb_first).withColumn("part", F.floor(F.col("_word") / most_words))

    def listed(name: str) -> Column:
        whole = F.collect_list(F.when(F.col("_n") == bits, F.struct("_word", F.col(name).alias("value"))))
        return F.transform(F.sort_array(whole), lambda w: w["value"]).alias(name)

    parts = words.groupBy(*keys, "_start", "part").agg(*map(listed, lines), F.max(F.when(F.col("_n") < bits, F.col("_n"))).alias("_rest"))
    if cs is None or cs_active == "disabled":
        windows = clock.select(*keys).distinct().select(*keys, F.lit(NEVER).cast("long").alias("_start"), F.lit(None).cast("long").alias("_window_end"))
    else:
        level = along(changes(cs, keys, bucket_ns=bucket_ns), keys, {"_window_end": after(TS)}, bucket_ns=bucket_ns)
        windows = level.where(F.col("value") == F.lit(cs_active == "high")).select(*keys, F.col(TS).alias("_start"), "_window_end")
    rows = same_parts(windows, parts, [*keys, "_start"], "left")
    rest = F.coalesce(F.col("_rest"), F.lit(0).cast("long"))
    return rows.select(
        *keys, F.col("_start").alias("start_ns"), F.col("_window_end").alias("end_ns"), F.coalesce("part", F.lit(0).cast("long")).alias("part"), F.lit("spi").alias("protocol"),
        *(F.coalesce(x, F.array().cast("array<bigint>")).alias(x) for x in lines),
        F.lit(bits).alias("word_bits"), rest.alias("incomplete_bits"), (F.col("_window_end").isNotNull() & (rest == 0)).alias("complete"),
    )


def word_cells(samples: DataFrame, keys: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """Cell of each sampling point: from the middle to the point before to the middle to the next, within its window."""
    place = F.struct(TS, "_start")
    rows = along(samples, keys, {"_back": before(place), "_ahead": after(place)}, bucket_ns=bucket_ns)
    middle = lambda side: F.when(F.col(f"{side}._start").eqNullSafe(F.col("_start")), floor_div(F.col(f"{side}.{TS}") + F.col(TS), 2))
    return rows.withColumns({"cell_start": F.coalesce(middle("_back"), "_start"), "cell_end": F.coalesce(middle("_ahead"), "_end", TS)}).drop("_back", "_ahead")


def bus_triggers(strobe: DataFrame, keys: Sequence[str], mode: str = "rising", step_ns: int = 1, end_ns: int | None = None, bucket_ns: int | None = None) -> DataFrame:
    """Times at which a strobe reads the bus.

    Edge modes rising, falling, any: a strobe that is high at position 0 rises there. Level modes high and low
    give every sample of ``step_ns`` at that level, the last run up to ``end_ns``.
    """
    level = changes(strobe, keys, bucket_ns=bucket_ns)
    if mode in ("rising", "falling", "any"):
        moved = along(level, keys, {"_before": before("value")}, bucket_ns=bucket_ns).where(F.col("value") != F.coalesce("_before", F.lit(False)))
        return (moved if mode == "any" else moved.where(F.col("value") == F.lit(mode == "rising"))).select(*keys, TS, SEQ)
    if mode not in ("high", "low"):
        raise StreamError(f"unknown strobe mode {mode}")
    runs = along(level, keys, {"_next": after(TS)}, bucket_ns=bucket_ns).withColumn("_end", F.coalesce("_next", F.lit(end_ns)))
    runs = runs.where((F.col("value") == F.lit(mode == "high")) & (F.col("_end") > F.col(TS)))
    return runs.select(*keys, F.explode(F.sequence(F.col(TS), F.col("_end") - 1, F.lit(step_ns).cast("long"))).alias(TS), SEQ)


def _bus_rows(triggers: DataFrame, data: Sequence[DataFrame], controls: dict[str, DataFrame], keys: Sequence[str], bucket_ns: int | None) -> DataFrame:
    """Triggers with the bus value (line 0 least significant) and the controls' levels at their time, changes at it included.

    All inputs are merged and sorted once; ``_off_{name}`` counts how often a control became false.
    """
    rows = triggers.select(*keys, TS, SEQ, F.lit(len(data) + len(controls)).alias("_input"))
    named = {**{f"_{i}": line for i, line in enumerate(data)}, **{f"_{name}": changes(x, keys, bucket_ns=bucket_ns) for name, x in controls.items()}}
    for i, (name, line) in enumerate(named.items()):
        rows = rows.unionByName(line.select(*keys, TS, SEQ, F.lit(i).alias("_input"), F.struct(F.col("value").alias("x")).alias(name)), allowMissingColumns=True)
    read = {f"_held{name}": latest(name) for name in named} | {f"_off_{name}": total(F.coalesce(~F.col(f"_{name}.x"), F.lit(False))) for name in controls}
    rows = along(rows, keys, read, ["_input"], bucket_ns).where(F.col("_input") == len(named))
    bus = F.lit(0).cast("long")
    for i in range(len(data)):
        one = F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")
        bus = bus.bitwiseOR(F.when(F.coalesce(F.col(f"_held_{i}.x"), F.lit(False)), one).otherwise(F.lit(0).cast("long")))
    levels = [F.col(f"_held_{name}.x").alias(f"_is_{name}") for name in controls]
    return rows.select(*keys, TS, SEQ, bus.alias("value"), *levels, *(f"_off_{name}" for name in controls))


def parallel_samples(
    strobe: DataFrame, data: Sequence[DataFrame], keys: Sequence[str], mode: str = "rising", step_ns: int = 1, end_ns: int | None = None, bucket_ns: int | None = None
) -> DataFrame:
    """Triggers of the strobe (see :func:`bus_triggers`) with the bus value at that time, changes at it included."""
    return _bus_rows(bus_triggers(strobe, keys, mode, step_ns, end_ns, bucket_ns), data, {}, keys, bucket_ns)


def parallel_bus(
    strobe: DataFrame,
    data: Sequence[DataFrame],
    keys: Sequence[str],
    mode: str = "rising",
    cycles: int = 1,
    little_endian: bool = True,
    enable: DataFrame | None = None,
    enable_high: bool = True,
    cs: DataFrame | None = None,
    cs_active: str = "low",
    step_ns: int = 1,
    end_ns: int | None = None,
    bucket_ns: int | None = None,
) -> DataFrame:
    """Words of ``cycles`` bus samples: ts_ns of the first, duration_ns to the last, value.

    Samples count only while enabled and selected; one that doesn't, and any disabling, starts a new word, and an
    incomplete word is dropped. Before its first row a control is low.
    """
    controls = {}
    for name, level, active in (("enable", enable, enable_high), ("cs", cs, cs_active == "high")):
        if level is not None:
            controls[name] = level.withColumn("value", F.col("value") == F.lit(active))
    triggers = bus_triggers(strobe, keys, mode, step_ns, end_ns, bucket_ns)
    rows = _bus_rows(triggers, data, controls, keys, bucket_ns)
    ok, offs = F.lit(True), F.lit(0).cast("long")
    for name, active in (("enable", enable_high), ("cs", cs_active == "high")):
        if name in controls:
            ok = ok & F.coalesce(F.col(f"_is_{name}"), F.lit(not active))
            offs = offs + F.coalesce(f"_off_{name}", F.lit(0).cast("long"))
    rows = rows.select(*keys, TS, SEQ, "value", ok.alias("_ok"), offs.alias("_offs"))
    rows = along(rows, keys, {"_last": before(F.struct("_ok", "_offs"))}, bucket_ns=bucket_ns)
    starts = ~F.col("_ok") | F.coalesce(~F.col("_last._ok") | (F.col("_last._offs") != F.col("_offs")), F.lit(True))
    rows = along(rows.withColumn("_starts", starts), keys, {"_segment": total("_starts")}, bucket_ns=bucket_ns)
    rows = number_within(rows, keys, F.col("_starts"), "_number", (), bucket_ns, counted=F.col("_ok")).where("_ok")
    width, number = len(data), F.col("_number")
    order = number % cycles
    shift = (order if little_endian else F.lit(cycles - 1) - order) * width
    rows = rows.withColumns({"_word": F.floor(number / cycles), "_part": F.col("value") * F.pow(F.lit(2.0), shift).cast("long")})
    words = rows.groupBy(*keys, "_segment", "_word").agg(
        F.min(TS).alias(TS), F.min(SEQ).alias(SEQ), (F.max(TS) - F.min(TS)).alias("duration_ns"), F.bit_or("_part").alias("value"), F.count(F.lit(1)).alias("_n")
    )
    return words.where(F.col("_n") == cycles).select(*keys, TS, SEQ, "duration_ns", "value")


def sampling_points(samples: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, spacing_ns: int, bucket_ns: int | None = None) -> DataFrame:
    """Sampling points in [start, end), of a key all or none: none if two are nearer than ``spacing_ns``."""
    inside = samples.where((F.col(TS) >= start_ns) & (F.col(TS) < end_ns))
    gaps = along(inside, keys, {"_last": before(TS)}, bucket_ns=bucket_ns).withColumn("_gap", F.col(TS) - F.col("_last"))
    least = gaps.groupBy(*keys).agg(F.min("_gap").alias("_least"))
    return same_parts(inside, least, keys).where(F.col("_least").isNull() | (F.col("_least") >= spacing_ns)).drop("_least")


def i2c(scl: DataFrame, sda: DataFrame, keys: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """Packets of a two-wire bus: ts_ns, end_ns, kind, value, acked.

    Kinds: START, START REPEAT, STOP, ADDRESS WRITE, ADDRESS READ, DATA WRITE, DATA READ. Both lines are reduced
    to one row per instant; bits are read where the clock rises; the ninth is the acknowledgement (low).
    """
    both = merged([changes(x, keys, bucket_ns=bucket_ns) for x in (scl, sda)], keys, initial=F.lit(True), bucket_ns=bucket_ns)
    both = along(both, keys, {"_next": after(TS)}, ["_input"], bucket_ns)
    both = both.where(F.col("_next").isNull() | (F.col("_next") != F.col(TS))).select(*keys, TS, SEQ, "v0", "v1")
    both = along(both, keys, {"_last": before(F.struct("v0", "v1"))}, bucket_ns=bucket_ns)
    was_clock, was_data = F.coalesce("_last.v0", F.lit(True)), F.coalesce("_last.v1", F.lit(True))
    high = F.col("v0") & was_clock
    mark = F.when(high & was_data & ~F.col("v1"), "start").when(high & ~was_data & F.col("v1"), "stop")
    both = both.select(*keys, TS, SEQ, "v0", "v1", was_clock.alias("_was"), mark.alias("_mark"))
    both = along(both, keys, {"_state": latest("_mark"), "_segment": total(F.col("_mark").isNotNull())}, bucket_ns=bucket_ns)
    both = along(both, keys, {"_prior": before("_state")}, bucket_ns=bucket_ns)
    active = F.coalesce(F.col("_prior") == "start", F.lit(False))
    marks = both.where(F.col("_mark").isNotNull()).select(
        *keys, TS, F.col(TS).alias("end_ns"),
        F.when((F.col("_mark") == "start") & active, "START REPEAT").when(F.col("_mark") == "start", "START").when(active, "STOP").alias("kind"),
        F.lit(None).cast("long").alias("value"), F.lit(None).cast("boolean").alias("acked"),
    ).where("kind is not null")
    is_bit = (F.col("_state") == "start") & F.col("_mark").isNull() & F.col("v0") & ~F.col("_was")
    rows = both.withColumn("_is_bit", F.coalesce(is_bit, F.lit(False)))
    bits = number_within(rows, keys, F.col("_mark").isNotNull(), "_number", (), bucket_ns, counted=F.col("_is_bit")).where("_is_bit")
    bits = bits.withColumns({"_byte": F.floor(F.col("_number") / 9), "_k": F.col("_number") % 9})
    data = bits.groupBy(*keys, "_segment", "_byte").agg(
        F.min(TS).alias(TS), F.max(TS).alias("end_ns"), F.count(F.lit(1)).alias("_n"),
        _value((F.col("_k") < 8) & F.col("v1"), F.greatest(F.lit(7) - F.col("_k"), F.lit(0).cast("long"))).alias("_v"), F.bool_or((F.col("_k") == 8) & ~F.col("v1")).alias("acked"),
    ).where("_n = 9")
    heads = data.where("_byte = 0").select(*keys, "_segment", (F.col("_v") % 2 == 1).alias("_read"))
    data = same_parts(data, heads, [*keys, "_segment"])
    first = F.col("_byte") == 0
    kind = F.when(first & F.col("_read"), "ADDRESS READ").when(first, "ADDRESS WRITE").when(F.col("_read"), "DATA READ").otherwise("DATA WRITE")
    data = data.select(*keys, TS, "end_ns", kind.alias("kind"), F.when(first, F.shiftright("_v", 1)).otherwise(F.col("_v")).cast("long").alias("value"), "acked")
    return marks.unionByName(data)
