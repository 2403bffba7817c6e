"""Streams over files, run until they end, give what the batch operators give; so does every step alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import decode, events, levels, text, words
from pulseframe.streaming import decoders as d
from pulseframe.streaming import ordered as o

MS = 1_000_000
SCHEMA = "k int, ts_ns long, seq long, level boolean, is_end boolean, end_rows long"


def level_rows(n=90, seed=5, step=MS):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(10_000), n))
    return [(i % 3, t * step, i, rng.random() < 0.5, False, None) for i, t in enumerate(times)]


def ends_of(rows):
    """An end of each key at its last time, with the number of its rows."""
    return [(k, max(r[1] for r in rows if r[0] == k), 0, False, True, sum(r[0] == k for r in rows)) for k in sorted({r[0] for r in rows})]


def run_stream(spark, folder, rows, build, files=None):
    """The result over files, one in each batch: ``files``, or thirty shuffled rows each and then an end of each key."""
    if files is None:
        files = [random.Random(i).sample(rows[i : i + 30], len(rows[i : i + 30])) for i in range(0, len(rows), 30)] + [ends_of(rows)]
    for i, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:04}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = f"q{abs(hash(str(folder)))}"
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_latch_stream_equals_batch(spark, tmp_path):
    rows = level_rows()
    side = F.when(F.col("seq") % 2 == 0, 0).otherwise(1)
    build = lambda s: o.apply_ordered(o.stream_rows(s, ["k"], side, "2 seconds"), ["k"], o.latch_step, LATCH)
    table = spark.createDataFrame(rows, SCHEMA)
    batch = events.sr_latch(table.where("seq % 2 = 0"), table.where("seq % 2 = 1"), ["k"]).where("seq >= 0")
    assert plain(run_stream(spark, tmp_path, rows, build), "k", "ts_ns", "value") == plain(batch, "k", "ts_ns", "value")


def test_timers_release_and_end_silent_keys(spark, tmp_path):
    """Key 0 stops early: the watermark of the others releases its rows and, after the idle time, ends it."""
    rows = [(0, 10 * MS, 0, True, False, None), (0, 20 * MS, 1, True, False, None)] + [(1, t * 1000 * MS, t, True, False, None) for t in range(1, 60)]
    step, finish = o.framer_step(fixed=100)

    def build(source):
        own = source.withColumns({"duration_ns": F.lit(10).cast("long"), "value": F.col("seq")})
        return o.apply_ordered(o.stream_rows(own, ["k"], 1, duration_ns="duration_ns", value="value"), ["k"], step, "start_ns long, end_ns long, n_words long, values array<long>", finish=finish, idle_ms=5000)

    found = run_stream(spark, tmp_path, rows, build, [rows[:30], rows[30:]])
    assert [(r["k"], r["n_words"], r["values"]) for r in found.collect()] == [(0, 2, [0, 1])]


S = 1000 * MS
LATCH = "ts_ns long, seq long, value boolean"


def latch_of(source, **options):
    """Seq even sets, odd resets."""
    side = F.when(F.col("seq") % 2 == 0, 0).otherwise(1)
    return o.apply_ordered(o.stream_rows(source, ["k"], side, "1 second"), ["k"], o.latch_step, LATCH, **options)


def row(k, second, seq):
    return (k, second * S, seq, False, False, None)


def test_end_of_one_key_keeps_the_rows_of_another(spark, tmp_path):
    files = [[row(1, 1, 0), row(2, 1, 2)], [(1, S, 0, False, True, None)], [row(2, 2, 3)], [row(2, 3, 4)], [(2, 3 * S, 0, False, True, None)]]
    found = run_stream(spark, tmp_path, None, latch_of, files)
    assert plain(found, "k", "ts_ns", "value") == sorted([(1, S, True), (2, 2 * S, False), (2, 3 * S, True), (2, S, True)], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ends_in_any_file_order(spark, tmp_path, seed):
    """Ends that tell their rows lie in any file, also before rows of their key; nothing of any key is lost."""
    rng, rows = random.Random(seed), level_rows(60, seed, 10 * MS)
    files = [rows[i : i + 10] for i in range(0, 60, 10)]
    for end in ends_of(rows):
        files[rng.randrange(6)].append(end)
    found = run_stream(spark, tmp_path, None, latch_of, files)
    table = spark.createDataFrame(rows, SCHEMA)
    batch = events.sr_latch(table.where("seq % 2 = 0"), table.where("seq % 2 = 1"), ["k"]).where("seq >= 0")
    assert plain(found, "k", "ts_ns", "value") == plain(batch, "k", "ts_ns", "value")


@pytest.mark.parametrize("late", ["drop", "clamp"])
def test_late_rows_in_a_stream(spark, tmp_path, late):
    files = [[row(1, 10, 0), row(1, 20, 1)], [row(1, 100, 2)], [row(1, 5, 3), row(1, 99, 5)], [(1, 100 * S, 0, False, True, None)]]
    build = lambda s: o.apply_ordered(o.stream_rows(s, ["k"], 0, "1 second"), ["k"], o.counter_step(), "ts_ns long, seq long, value long", late=late)
    found = plain(run_stream(spark, tmp_path, None, build, files), "ts_ns", "seq", "value")
    moved = [(20 * S, 3, 3)] if late == "clamp" else []
    n = 3 + len(moved)
    assert found == sorted([(10 * S, 0, 1), (20 * S, 1, 2), *moved, (99 * S, 5, n), (100 * S, 2, n + 1)], key=str)


def test_mark_releases_without_being_a_row(spark, tmp_path):
    def build(source):
        marked = source.withColumns({"is_mark": F.col("is_end"), "is_end": F.lit(False)})
        return latch_of(marked)

    files = [[row(1, 1, 0)], [(2, 100 * S, 0, False, True, None)], [(2, 200 * S, 0, False, True, None)]]
    assert plain(run_stream(spark, tmp_path, None, build, files), "k", "value") == [(1, True)]


def test_user_step_as_a_stream(spark, tmp_path):
    from pulseframe.functions.udf import stream_step

    step = lambda state, r: [{"ts_ns": r["ts_ns"], "seq": r["seq"], "big": r["big"]}]
    finish = lambda state: [{"ts_ns": -1, "seq": -1, "big": None}]
    operator = stream_step(step, "ts_ns long, seq long, big long", late="drop", finish=finish)
    build = lambda s: operator(o.stream_rows(s.withColumn("big", F.expr("if(seq = 1, null, (1L << 60) + seq)")), ["k"], big="big"), ["k"])
    files = [[row(1, 1, 0), row(1, 2, 1)], [row(1, 90, 2)], [row(1, 3, 7)], [(1, 90 * S, 0, False, True, None)]]
    found = plain(run_stream(spark, tmp_path, None, build, files), "seq", "big")
    # the row of 3 s comes after the watermark, but nothing later of its key was applied, so it isn't late
    assert found == sorted([(-1, None), (0, 1 << 60), (1, None), (2, (1 << 60) + 2), (7, (1 << 60) + 7)], key=str)


def test_state_touched_by_a_batch_does_not_grow_with_what_waits():
    """A processor over a state that counts its calls: a batch of one row costs the same whether 10 or 10,000 rows wait."""
    import pandas as pd

    class State(dict):
        calls = 0

        def touch(self):
            State.calls += 1

        def getValue(self, k):  # noqa: N802
            self.touch()
            return self[k]

        def containsKey(self, k):  # noqa: N802
            self.touch()
            return k in self

        def updateValue(self, k, v):  # noqa: N802
            self.touch()
            self[k] = v

        def exists(self):
            return () in self

        def get(self):
            self.touch()
            return self[()]

        def update(self, v):
            self.touch()
            self[()] = v

    class Handle:
        def registerTimer(self, at):  # noqa: N802
            State.calls += 1

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    costs = []
    for waiting in (10, 10_000):
        p = o.Ordered(["k"], ["k"], o.latch_step, "drop", None, None, 1, 1000, 0, [])
        p.handle, p.head, p.own, p.slots, p.rows = Handle(), State(), State(), State(), State()
        frame = lambda first, n: pd.DataFrame([{"k": 1, "ts_ns": (first + i) * S, "seq": i, "side": 0, "is_end": False, "is_mark": False, "end_rows": 0} for i in range(n)])
        list(p.handleInputRows((1,), iter([frame(1, waiting)]), Times()))
        before = State.calls
        list(p.handleInputRows((1,), iter([frame(waiting + 1, 1)]), Times()))
        costs.append((State.calls - before, len(p.head[()][0])))
    assert costs[0][0] == costs[1][0] and costs[1][1] < costs[0][1] + 20


def drive(step, rows, finish=None):
    """A step over rows in the order that the processor applies them in."""
    state, out = {}, []
    for row in sorted(rows, key=lambda r: (r["ts_ns"], r["side"], r["seq"])):
        out += step(state, row)
    return out + (finish(state) if finish else [])


def sides(*inputs, name="level"):
    return [{"ts_ns": t, "seq": s, "side": side, name: v} for side, rows in enumerate(inputs) for t, s, v in rows]


@pytest.fixture
def lines(spark):
    """Random level lines, as step rows and as tables of one key."""

    def make(n, rows=60, seed=1, top=2000):
        rng = random.Random(seed)
        every = [[(t, i * 1000 + j, rng.random() < 0.5) for j, t in enumerate(sorted(rng.sample(range(top), rows)))] for i in range(n)]
        return every, [spark.createDataFrame([(1, *r) for r in x], "k int, ts_ns long, seq long, value boolean") for x in every]

    return make


def same(out, batch, *columns):
    assert sorted((tuple(x[c] for c in columns) for x in out), key=str) == plain(batch, *columns) and out


@pytest.mark.parametrize("operation", ["AND", "NOR", "XOR"])
def test_logic(lines, operation):
    own, tables = lines(3)
    batch = levels.logic_gate(tables, ["k"], operation).where("seq >= 0")
    same(drive(o.logic_step(3, operation), sides(*own)), batch, "ts_ns", "value")


def test_edges_gate_and_control(spark, lines):
    own, tables = lines(2)
    same(drive(o.edge_step("both", 70, 5), sides(own[0])), levels.edges(tables[0], ["k"], "both", 70, 5), "ts_ns", "seq")
    same(drive(o.gate_step(), sides(*own)), events.event_gate(tables[1], tables[0], ["k"]), "ts_ns", "seq")
    batch = events.event_control(tables[1], ["k"], 3, 90, tables[0])
    same(drive(o.holdoff_step(3, 90, True), sides(*own)), batch, "ts_ns", "seq")
    batch = events.event_counter(tables[0], ["k"], 3, 2).where("seq >= 0")
    same(drive(o.counter_step(3, 2), sides(own[0])), batch, "ts_ns", "value")


@pytest.mark.parametrize("manual", [False, True])
def test_matches(spark, manual):
    rng = random.Random(3)
    found = [(t, i, rng.randrange(1, 40)) for i, t in enumerate(sorted(rng.sample(range(3000), 200)))]
    rearms = [(t, 1000 + i, 0) for i, t in enumerate(sorted(rng.sample(range(3000), 30)))]
    table = spark.createDataFrame([(1, t, s, n, n) for t, s, n in found], "k int, ts_ns long, seq long, duration_ns long, value long")
    arms = spark.createDataFrame([(1, t, s) for t, s, _ in rearms], "k int, ts_ns long, seq long")
    rows = [{"ts_ns": t, "seq": s, "side": 1, "duration_ns": n, "value": n} for t, s, n in found] + (sides([(t, s, 0) for t, s, _ in rearms]) if manual else [])
    batch = words.match_words(table, ["k"], F.lit(True), every=2, holdoff_ns=50, rearms=arms if manual else None)
    same(drive(o.match_step(2, 50, "end", manual), rows), batch, "ts_ns", "seq", "match_ns")


def test_texts(spark):
    rows = [[(t, i * 100 + t, t % 4) for t in range(i, 60, 7)] for i in range(2)]
    tables = [spark.createDataFrame([(1, *r) for r in x], "k int, ts_ns long, seq long, value long") for x in rows]
    same(drive(o.text_step(2, lambda v: f"{v[0]}-{v[1]:02}"), sides(*rows, name="value")), text.text_formatter(tables, ["k"], "{0}-{1:02}"), "ts_ns", "value")


def test_framer(spark):
    rng = random.Random(4)
    rows = [(t, i, i) for i, t in enumerate(sorted(rng.sample(range(4000), 90)))]
    step, finish = o.framer_step(fixed=4, max_gap_ns=100)
    out = drive(step, [{"ts_ns": t, "seq": s, "side": 1, "duration_ns": 10, "value": v} for t, s, v in rows], finish)
    table = spark.createDataFrame([(1, t, s, 10, v) for t, s, v in rows], "k int, ts_ns long, seq long, duration_ns long, value long")
    batch = words.frame_packets(table, ["k"], fixed=4, max_gap_ns=100).withColumn("values", F.transform("words", lambda w: w["value"]))
    same(out, batch, "start_ns", "end_ns", "n_words", "values")


def test_serial_decoders(lines):
    own, tables = lines(4, rows=150, seed=9)
    for settings in ({}, {"parity": "even", "msb_first": True}, {"inverted": True, "stop_bits": 2}):
        step, finish = d.uart_step(1e8, **settings)
        same(drive(step, sides(own[0]), finish), decode.uart(tables[0], ["k"], 1e8, **settings), "ts_ns", "duration_ns", "value", "framing_error", "parity_error")
    for settings in ({}, {"mode": 1, "msb_first": False, "cs_active": "high"}, {"cs_active": "disabled"}):
        step, finish = d.spi_step(["mosi", "miso"], bits=3, **settings)
        out = drive(step, sides(*own), finish)
        same(out, decode.spi(tables[0], tables[1], {"mosi": tables[2], "miso": tables[3]}, ["k"], bits=3, **settings), "line", "ts_ns", "seq", "duration_ns", "value", "window_ns")
    step, finish = d.i2c_step()
    same(drive(step, sides(own[0], own[1]), finish), decode.i2c(tables[0], tables[1], ["k"]), "ts_ns", "end_ns", "kind", "value", "acked")


def test_parallel_decoder(lines):
    own, tables = lines(4, rows=120, seed=11)
    rows = sides(own[0], own[1]) + [x | {"side": 2} for x in sides(own[2])] + [x | {"side": 4} for x in sides(own[3])]
    for settings in ({}, {"mode": "any", "little_endian": False}, {"mode": "falling"}):
        out = drive(d.parallel_step(2, cycles=2, enable_high=True, **settings), rows)
        same(out, decode.parallel_bus(tables[3], tables[:2], ["k"], cycles=2, enable=tables[2], **settings), "ts_ns", "duration_ns", "value")


def test_late_rows_and_routes():
    route = o.numbered_route_step("f")
    rows = sides([(5, 0, 0), (9, 1, 0)], [(4, 2, 7), (5, 3, 8), (9, 4, 9)], name="value")
    assert [(x["value"], x["filename"]) for x in drive(route, rows)] == [(8, "f1"), (9, "f2")]


def test_blocks_follow_each_other():
    state = {}
    block = lambda start, data, n: {"start_pos": start, "n": n, "step_ns": 3, "data": data}
    assert [(r["ts_ns"], r["value"]) for r in o.block_step(state, block(0, b"\xf0", 8))] == [(0, False), (12, True)]
    assert o.block_step(state, block(8, b"", 0)) == []
    assert [(r["ts_ns"], r["value"]) for r in o.block_step(state, block(8, b"\x0f", 6))] == [(36, False)]


def test_state_touched_does_not_grow_with_the_slots_of_a_batch():
    """Rows of a thousand slots wait, are released and end by as many calls of state and timers as rows of one slot, in order."""
    import pandas as pd

    calls = 0

    def counted(f):
        def call(*args):
            nonlocal calls
            calls += 1
            return f(*args)

        return call

    class State:
        def __init__(self):
            held = self.held = {}
            self.exists = counted(lambda: () in held)
            self.get = counted(lambda: held[()])
            self.update = counted(lambda v: held.__setitem__((), v))
            self.iterator = counted(lambda: iter(list(held.items())))
            self.getValue = counted(held.get)
            self.updateValue = counted(held.__setitem__)
            self.removeKey = counted(held.pop)
            self.containsKey = counted(held.__contains__)
            self.keys = counted(lambda: iter(list(held)))
            self.clear = counted(held.clear)

    class Handle:
        def __init__(self):
            self.timers = set()
            self.registerTimer, self.deleteTimer = counted(self.timers.add), counted(self.timers.discard)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    costs = []
    for slots in (1, 1000):
        calls = 0
        p = o.Ordered(["k"], ["k", "ts_ns", "seq", "value"], o.counter_step(), "drop", None, None, 1, 1000, 0, [])
        p.handle = Handle()
        p.head, p.own, p.slots, p.rows = State(), State(), State(), State()
        frame = lambda seqs, end=False: pd.DataFrame([{"k": 1, "ts_ns": (i * slots // 1000) * S, "seq": i, "side": 0, "is_end": end, "is_mark": False, "end_rows": 1000 * end} for i in seqs])
        out = list(p.handleInputRows((1,), iter([frame(range(999, -1, -2))]), At(0)))
        out += list(p.handleInputRows((1,), iter([frame(range(0, 1000, 2))]), At(0)))
        while p.handle.timers and min(p.handle.timers) <= slots * 500:
            at = min(p.handle.timers)
            out += list(p.handleExpiredTimer((1,), At(slots * 500), type("", (), {"getExpiryTimeInMs": lambda self, at=at: at})()))
            p.handle.timers.discard(at)
        out += list(p.handleInputRows((1,), iter([frame([0], True)]), At(slots * 500)))
        found = pd.concat(out)
        assert found["seq"].tolist() == list(range(1000)) and found["value"].tolist() == list(range(1, 1001))
        assert not p.handle.timers and not any(x.held for x in (p.head, p.own, p.slots, p.rows))
        costs.append(calls)
    assert costs[1] < costs[0] + 20


def columns_of(rows):
    import numpy as np

    return {c: np.array([r[c] for r in rows]) for c in rows[0]} if rows else {}


def drive_columns(step, rows, cuts):
    """A column step over rows in order, cut into pieces, with what is left at the end."""
    rows, state, out = sorted(rows, key=lambda r: (r["ts_ns"], r["side"], r["seq"])), {}, []
    for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        found = step.apply(state, columns_of(rows[i:j]), j == len(rows))
        names = list(found)
        out += [dict(zip(names, values, strict=True)) for values in zip(*(x if isinstance(x, list) else x.tolist() for x in found.values()), strict=True)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_column_steps_equal_row_steps(seed):
    """However the rows are cut into batches; times tie, levels repeat, the key ends without rows."""
    rng = random.Random(seed)
    n = rng.choice([1, 2, 30, 400])
    line = [{"ts_ns": t, "seq": i, "side": 0, "level": rng.random() < 0.5} for i, t in enumerate(sorted(rng.choices(range(n * 12), k=n)))]
    cuts = sorted(rng.choices(range(n + 1), k=5)) + ([n] if seed % 2 else [])
    for settings in ({}, {"parity": "even", "msb_first": True}, {"inverted": True, "stop_bits": 2}, {"stop_bits": 0, "data_bits": 5}, {"parity": "mark", "stop_bits": 1.5}):
        step, finish = d.uart_step(1e8, **settings)
        assert drive_columns(d.uart_columns(1e8, **settings), line, cuts) == drive(step, line, finish)
    words = [{"ts_ns": t, "seq": i, "side": rng.randrange(6), "duration_ns": rng.randrange(20), "value": i} for i, t in enumerate(sorted(rng.choices(range(n * 12), k=n)))]
    words = [w | {"side": min(w["side"], 1)} for w in words]
    for settings in ({"fixed": 3}, {"max_gap_ns": 15}, {"fixed": 4, "max_gap_ns": 25, "max_words": 2}, {}):
        step, finish = o.framer_step(**settings)
        assert drive_columns(o.framer_columns(**settings), words, cuts) == drive(step, words, finish)


def test_stretches_keep_their_rows():
    import numpy as np

    top = (1 << 63) - 1
    rows = {"ts_ns": np.array([-top, top, 0, 5]), "seq": np.array([7] * 4), "value": np.array([True, False, True, True]), "x": np.array([0.5, -1.0, np.inf, 0.0])}
    found = o.stretch_columns(o.stretch_bytes(rows))
    assert list(found) == list(rows) and all(found[c].tolist() == rows[c].tolist() for c in rows)
    none = o.stretch_columns(o.stretch_bytes({c: v[:0] for c, v in rows.items()}))
    assert all(len(none[c]) == 0 for c in rows)
    with pytest.raises(o.StreamError):
        o.stretch_bytes({"ts_ns": rows["ts_ns"], "name": np.array(["a"] * 4, object)})


def test_a_stream_of_stretches_handles_a_row_for_each(spark, tmp_path):
    """Serial decoder and framer over stretches of many level rows, in two batches: what the batch operators give, by a Spark row for each stretch."""
    rng = random.Random(8)
    lines = {k: [(t * 10, i, rng.random() < 0.5) for i, t in enumerate(sorted(rng.sample(range(20_000), 3000)))] for k in (1, 2, 3)}
    lines[3] = lines[3][:1]
    for batch, (low, high) in enumerate(((0, 1700), (1700, 3000))):
        rows = []
        for k, line in lines.items():
            part = [{"ts_ns": t, "seq": s, "value": v} for t, s, v in line[low:high]]
            last = k == 3 or batch == 1
            if part:
                rows.append((k, last, len(line) if last else 0, part[-1]["ts_ns"], o.stretch_bytes(columns_of(part))))
        spark.createDataFrame(rows, "k int, is_end boolean, end_rows long, latest long, stretch binary").coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    source = spark.readStream.schema("k int, is_end boolean, end_rows long, latest long, stretch binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = o.apply_ordered(o.stream_rows(source, ["k"], level="value"), ["k"], d.uart_columns(1e7), "ts_ns long, seq long, duration_ns long, value long", chained=True)
    packets = o.apply_ordered(o.chained_rows(found, ["k"], 1, duration_ns="duration_ns", value="value"), ["k"], o.framer_columns(fixed=7), "start_ns long, end_ns long, n_words long, values array<long>")
    query = packets.writeStream.format("memory").queryName("stretches").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 5
    table = spark.createDataFrame([(k, *r) for k, line in lines.items() for r in line], "k int, ts_ns long, seq long, value boolean")
    batch = words.frame_packets(decode.uart(table, ["k"], 1e7), ["k"], fixed=7).withColumn("values", F.transform("words", lambda w: w["value"]))
    assert plain(spark.table("stretches"), "k", "start_ns", "end_ns", "n_words", "values") == plain(batch, "k", "start_ns", "end_ns", "n_words", "values")


@pytest.mark.parametrize("most", [3, 1 << 14])
def test_line_stretches_are_the_line(spark, tmp_path, most):
    """Stretches of turns hold the rows of the line that the batch queries decode, and tell how many they are."""
    from pulseframe.plans import bindings as b

    texts = [(1, 0, "héllo"), (1, 1, "\x00\x7f"), (2, 0, "U"), (2, 1, "")]
    spark.createDataFrame(texts, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted(map(tuple, b.uart_line(spark, str(tmp_path)).collect()))
    rows = spark.read.parquet(f"{tmp_path}/conversations.parquet").where("length(text) > 0").select("conv_id", "turn", F.encode("text", "utf-8").alias("h"))
    ddl = "conv_id long, turn long, is_end boolean, end_rows long, latest long, stretch binary"
    found, ends = [], {}
    for r in rows.coalesce(1).mapInArrow(b._line_stretches(most), ddl).collect():
        own = o.stretch_columns(bytes(r["stretch"]))
        found += [(r["conv_id"], r["turn"], *x) for x in zip(own["ts_ns"].tolist(), own["seq"].tolist(), own["value"].tolist(), strict=True)]
        assert r["latest"] == own["ts_ns"].max()
        if r["is_end"]:
            ends[r["conv_id"], r["turn"]] = r["end_rows"]
    assert sorted(found) == want and ends == {k: sum(x[:2] == k for x in want) for k in {x[:2] for x in want}}


def test_serial_streams_read_a_row_for_each_turn(spark, tmp_path, monkeypatch):
    """r5_stream_uart and p6_stream_stacked bring a turn's line to Spark as one row of their input, not as one for each level change."""
    from pulseframe.plans import file_queries as q

    texts = [(1, 0, "Ünï"), (1, 1, "x" * 40), (2, 0, "\x00"), (2, 1, None), (3, 0, "")]
    spark.createDataFrame(texts, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(q, "shared_path", lambda spark, label: f"{tmp_path}/{label}")
    found = q.r5_stream_uart(spark, str(tmp_path)).collect()
    held = [(c, t, x.encode()) for c, t, x in texts if x]
    assert sorted((r["conv_id"], r["turn"], r["n_words"], bytes.fromhex(r["payload"])) for r in found) == [(c, t, len(x), x) for c, t, x in held]
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("input*")) == 3
    monkeypatch.setattr(q, "shared_path", lambda spark, label: f"{tmp_path}/p6/{label}")
    found = q.p6_stream_stacked(spark, str(tmp_path)).collect()
    want = [(c, t, 1000 + i * 10_000, x[i : i + 16]) for c, t, x in held for i in range(0, len(x), 16)]
    assert sorted((r["conv_id"], r["turn"], r["start_ns"], bytes.fromhex(r["payload"])) for r in found) == want
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("p6/input*")) == 3
