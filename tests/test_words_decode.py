"""Small literal cases of word operators, decoders, triggers and files."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import formats
from pulseframe.operators import decode, retrieval, text, trigger, words
from pulseframe.schema import StreamError
from pulseframe.sources import blocks, sinks

K = ["k"]
WORD = "k int, ts_ns long, seq long, duration_ns long, value long"


@pytest.fixture(scope="module")
def word_table(spark):
    return lambda rows: spark.createDataFrame([(1, t, i, d, v) for i, (t, d, v) in enumerate(rows)], WORD)


def values(df):
    return [r["value"] for r in df.orderBy("ts_ns", "seq").collect()]


def test_unsigned_comparison(word_table):
    rows = word_table([(0, 1, -1), (1, 1, 5), (2, 1, 300)])
    assert values(rows.where(words.matches("gt", 5))) == [-1, 300]
    assert values(rows.where(words.matches("eq", 0x2C, 0xFF))) == [300]
    assert values(rows.where(words.in_range(5, 400))) == [5, 300]
    assert values(rows.where(words.in_range(10, 5))) == []
    assert values(rows.where(words.in_set("0x5, 300"))) == [5, 300]
    with pytest.raises(StreamError):
        words.parse_set("a,b")


def test_match_policy(word_table, stream):
    rows = word_table([(t, 1, 1) for t in range(0, 100, 10)])
    hit = F.col("value") == 1
    found = lambda **x: [r["match_ns"] for r in words.match_words(rows, K, hit, **x).orderBy("ts_ns").collect()]
    assert found(every=3) == [21, 51, 81]
    assert found(holdoff_ns=25, at="start") == [0, 30, 60, 90]
    assert found(every=2, holdoff_ns=25) == [11, 51, 91]
    assert found(rearms=stream([35, 70])) == [1, 41, 71]


def test_fields(spark, word_table):
    assert values(words.extract_field(word_table([(0, 1, 0b1011_0000), (1, 1, -1)]), 4, 3)) == [0b011, 7]
    assert values(words.extract_field(word_table([(0, 1, -1)]), 70, 3)) == [0]
    rows = spark.createDataFrame([(1, 0, 0, 1, 0, bytearray(b"\x12\x34\x56"), None)], WORD + ", payload_bytes binary, payload_text string")
    assert values(words.extract_field(rows, 4, 8)) == [0x23]
    wide = spark.createDataFrame([(1, 0, 0, 1, 0, bytearray(range(1, 11)), None)], WORD + ", payload_bytes binary, payload_text string")
    row = words.extract_field(wide, 0, 72).first()
    assert (bytes(row["payload_bytes"]), row["value"]) == (bytes(range(1, 10)), 0x0203040506070809)


def test_word_ends(word_table):
    rows = word_table([(0, 0, 1), (10, 0, 1), (50, 5, 1), (60, 0, 1), (1_000_000_000, 0, 1)])
    assert [r["end_ns"] for r in words.word_ends(rows, K).orderBy("ts_ns").collect()] == [10, 20, 55, 70, 1_000_000_000]


def framed(df):
    return [[w["value"] for w in r["words"]] for r in df.orderBy("start_ns").collect()]


def test_framer(word_table, stream):
    rows = word_table([(i * 10, 5, v) for i, v in enumerate([1, 2, 0, 3, 4, 5, 0, 6])])
    assert framed(words.frame_packets(rows, K, fixed=3)) == [[1, 2, 0], [3, 4, 5], [0, 6]]
    cut = F.col("value") == 0
    assert framed(words.frame_packets(rows, K, delimiter=cut)) == [[1, 2, 0], [3, 4, 5, 0], [6]]
    assert framed(words.frame_packets(rows, K, delimiter=cut, include_delimiter=False)) == [[1, 2], [3, 4, 5], [6]]
    assert framed(words.frame_packets(rows, K, boundaries=stream([20, 45]))) == [[1, 2], [0, 3, 4], [5, 0, 6]]
    assert framed(words.frame_packets(word_table([(0, 5, 1), (6, 1, 2), (20, 1, 3)]), K, max_gap_ns=5)) == [[1, 2], [3]]
    gate = stream([(10, True), (30, False), (60, True)], "value")
    assert framed(words.frame_packets(rows, K, gate=gate)) == [[2, 0], [0, 6]]


def test_framer_equals_a_state_machine(spark):
    random.seed(9)
    for _ in range(4):
        rows = [(1, t * 3 + random.randrange(3), i, random.randrange(3), random.randrange(6)) for i, t in enumerate(sorted(random.sample(range(200), 60)))]
        marks = [(1, random.randrange(600), i) for i in range(6)]
        df = spark.createDataFrame(rows, WORD)
        found = framed(words.frame_packets(df, K, fixed=4, delimiter=F.col("value") == 0, max_gap_ns=9, boundaries=spark.createDataFrame(marks, "k int, ts_ns long, seq long")))
        want, now, last, todo = [], [], None, sorted(m[1] for m in marks)
        for _, t, _, d, v in rows:
            hit = [m for m in todo if m <= t]
            todo = [m for m in todo if m > t]
            if now and (hit or t - last > 9):
                want.append(now)
                now = []
            now.append(v)
            last = t + d
            if len(now) == 4 or v == 0:
                want.append(now)
                now = []
        assert found == want + ([now] if now else [])


def test_formatter(stream):
    one = stream([(0, 5), (10, -7)], "value", kinds="long")
    assert values(text.text_formatter([one], K, "f{0:04}_{n}{9}{x}")) == ["f0005_5{9}{x}", "f-007_-7{9}{x}"]
    two = stream([(5, 1)], "value", kinds="long")
    assert values(text.text_formatter([one, two], K, "{0}-{1}")) == ["5-0", "5-1", "-7-1"]


def test_formats(spark):
    row = spark.range(1).select(
        formats.value_text(F.lit(10).cast("long"), "Hex + ASCII").alias("a"), formats.value_text(F.lit(-1).cast("long"), "Decimal").alias("b"),
        formats.time_text(F.lit(1_234_567_890)).alias("c"), formats.time_text(F.lit(999)).alias("d"), formats.byte_label(F.unhex(F.lit("0aff"))).alias("e"),
        formats.little_endian(F.lit(0x01020304).cast("long"), 4).alias("f"), formats.position_of(F.lit(1_704_067_200_000_000_001), 3, True).alias("g"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("0x0A '.'", "18446744073709551615", "1.234567890 s", "999 ns", "0A FF")
    assert bytes(row["f"]) == b"\x04\x03\x02\x01" and row["g"] == (1_704_067_200_000_000_001 + 1) // 3


def uart_line(frames, bit=1000, start=1000):
    rows, t = [(0, True)], start
    for bits in frames:
        for b in bits:
            rows.append((t, b))
            t += bit
    return rows


def bits_of(v, n=8):
    return [bool(v >> i & 1) for i in range(n)]


def test_uart(stream):
    hello = [[False, *bits_of(c), True] for c in b"HELLO"]
    assert values(decode.uart(stream(uart_line(hello), "value"), K, 1e6)) == list(b"HELLO")
    line = uart_line([[False, *bits_of(0x41), sum(bits_of(0x41)) % 2 == 1, True], [False, *bits_of(0x43), False, True]])
    found = decode.uart(stream(line, "value"), K, 1e6, parity="even").orderBy("ts_ns").collect()
    assert [(r["value"], r["parity_error"], r["framing_error"]) for r in found] == [(0x41, False, False), (0x43, True, False)]
    bad = decode.uart(stream(uart_line([[False, *bits_of(0x55), False]]) + [(12_000, True)], "value"), K, 1e6).first()
    assert bad["value"] == 0x55 and bad["framing_error"]
    msb = decode.uart(stream(uart_line([[False, *reversed(bits_of(0xA1)), True]]), "value"), K, 1e6, msb_first=True)
    assert values(msb) == [0xA1]
    inverted = [(t, not v) for t, v in uart_line(hello)]
    assert values(decode.uart(stream(inverted, "value"), K, 1e6, inverted=True)) == list(b"HELLO")


def test_spi_incomplete_and_open_windows(stream):
    clock = stream([(0, False)] + [(10 + 5 * i, i % 2 == 0) for i in range(44)], "value")
    cs = stream([(0, True), (5, False), (112, True), (115, False)], "value")
    data = stream([(0, True)], "value")
    packets = decode.spi_transactions(clock, cs, {"mosi": data}, K).orderBy("start_ns").collect()
    assert [(p["mosi"], p["incomplete_bits"], p["complete"]) for p in packets] == [([255], 3, False), ([255], 3, False)]


def test_parallel_modes(stream):
    strobe = stream([(0, True), (10, False), (20, True), (30, False)], "value")
    data = [stream([(0, True), (20, False)], "value"), stream([(0, False), (10, True)], "value")]
    assert values(decode.parallel_bus(strobe, data, K)) == [1, 2]
    assert values(decode.parallel_bus(strobe, data, K, mode="falling")) == [3, 2]
    assert values(decode.parallel_bus(strobe, data, K, mode="any")) == [1, 3, 2, 2]
    assert values(decode.parallel_bus(strobe, data, K, mode="high", step_ns=5, end_ns=30)) == [1, 1, 2, 2]
    assert values(decode.parallel_bus(strobe, data, K, mode="any", cycles=2)) == [1 | 3 << 2, 2 | 2 << 2]
    assert values(decode.parallel_bus(strobe, data, K, mode="any", cycles=2, little_endian=False)) == [3 | 1 << 2, 2 | 2 << 2]
    enable = stream([(0, True), (15, False), (18, True)], "value")
    assert values(decode.parallel_bus(strobe, data, K, mode="any", cycles=3, enable=enable)) == []


def test_trigger_conditions_and_program(stream):
    rows = trigger.channel_rows([stream([(0, False), (10, True), (20, False), (30, True)], "value")], K)
    found = lambda *s: trigger.find_trigger(rows, K, trigger.Program(list(s)), 1)
    assert found(trigger.Stage({0: "rising"}, count=2)).first()["trigger_ns"] == 30
    assert found(trigger.Stage({0: "rising"}), trigger.Stage({0: "falling"})).first()["trigger_ns"] == 20
    assert found(trigger.Stage({0: "low"})).first()["trigger_ns"] == 0
    assert found(trigger.Stage({0: "either"}, inverted=True)).first()["trigger_ns"] == 0
    assert trigger.Program([trigger.Stage({4: "up"}, "AND", count=0)]).problems(1) == ["unknown_channel:0:4", "unknown_condition:0:up", "count_range:0"]
    with pytest.raises(StreamError):
        found()


def test_grid_and_histogram(stream, word_table):
    line = stream([(0, False), (15, True), (31, False), (32, True), (80, False)], "value")
    rows = retrieval.sampled_grid(line, K, 0, 100, 10).orderBy("start_ns").collect()
    assert [(r["kind"], r["start_ns"], r["end_ns"], r["first"], r["last"]) for r in rows] == [
        ("Level", 0, 10, False, False), ("Edge", 10, 20, False, True), ("Level", 20, 30, True, True), ("Activity", 30, 40, True, True),
        ("Level", 40, 80, True, True), ("Edge", 80, 90, True, False), ("Level", 90, 100, False, False),
    ]
    counts = retrieval.presence_histogram(word_table([(0, 0, 1), (9, 2, 1), (35, 30, 1)]), K, 0, 100, 10).orderBy("bucket").collect()
    assert [r["n_words"] for r in counts] == [2, 1, 0, 1, 1, 1, 1, 0, 0, 0]


def test_nearest(stream):
    found = retrieval.nearest_boundary(stream([10, 15, 99]), stream([10, 20]), K, 30).orderBy("ts_ns").collect()
    assert [r["nearest_ns"] for r in found] == [10, 10, None]


def test_capture_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.dsl", "w") as z:
        z.writestr("header", "[version]\nversion = 2\n[header]\ntotal probes = 2\nsamplerate = 300 MHz\ntotal samples = 16\ntotal blocks = 2\nprobe0 = clk\n")
        for c, data in enumerate([b"\xf0\x0f", b"\xff\xff"]):
            for i in range(2):
                z.writestr(f"L-{c}/{i}", data[i : i + 1])
    rows = blocks.capture_blocks(spark, str(tmp_path / "*.dsl"), "dsl")
    found = blocks.block_levels(rows, ["channel"]).orderBy("channel", "ts_ns").collect()
    assert [(r["channel"], r["ts_ns"], r["value"]) for r in found] == [(0, 0, False), (0, 12, True), (0, 36, False), (1, 0, True)]
    head = blocks.capture_summary(blocks.captures(spark, str(tmp_path / "*.dsl"), "dsl")).first()
    assert head["probe_names"] == ["clk", "Probe1"] and head["samples_per_block"] == 8
    assert blocks.bus_at(rows, ["capture_id"], 5).first()["value"] == 3
    with pytest.raises(StreamError):
        blocks.dsl_header("total probes = 1")


def test_session_round_trip(spark, tmp_path):
    meta = "[device 1]\ncapturefile = logic-1\ntotal probes = 3\nsamplerate = 1 MHz\nunitsize = 1\nprobe1 = a\n"
    with zipfile.ZipFile(tmp_path / "x.sr", "w") as z:
        for name, data in (("version", b"2"), ("metadata", meta), ("logic-1-2", bytes([0, 5])), ("logic-1-1", bytes([1, 2, 4, 7]))):
            z.writestr(name, data)
    rows = blocks.capture_blocks(spark, str(tmp_path / "x.sr"), "sr")
    mixed = sinks.interleave(rows, ["capture_id"], 3).orderBy("start_pos").collect()
    assert [bytes(r["data"]) for r in mixed] == [bytes([1, 2, 4, 7]), bytes([0, 5])]
    size = sinks.export_session(rows, f"file://{tmp_path}/y.sr", ["a", "b", "c"], 1_000_000, 3)
    assert size == (tmp_path / "y.sr").stat().st_size
    with zipfile.ZipFile(tmp_path / "y.sr") as z:
        assert z.testzip() is None and z.namelist() == ["version", "metadata", "logic-1-1", "logic-1-2"]
        assert z.read("logic-1-1") == bytes([1, 2, 4, 7]) and z.read("version") == b"2"
    again = blocks.capture_blocks(spark, str(tmp_path / "y.sr"), "sr")
    plain = lambda df: sorted((r["channel"], r["start_pos"], r["n"], bytes(r["data"])) for r in df.collect())
    assert plain(again) == plain(rows)
    head = blocks.captures(spark, str(tmp_path / "y.sr"), "sr").first()
    assert (head["trigger_sample"], head["samplerate_hz"], head["probe_names"], head["total_samples"]) == (3, 1e6, ["a", "b", "c"], 6)


def test_sessions_that_are_not_whole(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(c, s, n, bytearray(b"x" * 9)) for c, s, n in rows], "channel int, start_pos long, n int, data binary")
    whole = [(0, 0, 8), (1, 0, 8), (0, 8, 4), (1, 8, 4)]
    assert sinks.check_capture(make(whole), 2) == 12
    for rows, channels, trigger in (([], 2, None), (whole[:3], 2, None), (whole, 3, None), ([(0, 0, 8), (1, 0, 7)], 2, None), ([(0, 8, 4), (1, 8, 4)], 2, None), (whole, 2, 12)):
        with pytest.raises(StreamError):
            sinks.check_capture(make(rows), channels, trigger)
    with pytest.raises(StreamError):
        sinks.session_metadata(["a", "b\n"], 1)


def test_many_entries_close_an_archive():
    entry, record = sinks.zip_entry("logic-1-1", b"abc" * 50)
    for offset in (0, 5_000_000_000):
        central = sinks.central_record(record, 0) * 70_000
        end = sinks.directory_end(70_000, len(central), len(entry))
        assert len(zipfile.ZipFile(io.BytesIO(entry + central + end)).infolist()) == 70_000
        assert len(sinks.central_record(record, offset)) == len(record) + 4 + (12 if offset else 0)


def test_an_archive_beyond_two_gigabytes(spark, tmp_path):
    """Archives are read by entries: a file of 3 GB (a hole before the archive) is no binary value."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("header", "total probes = 1\nsamplerate = 1 GHz\ntotal samples = 4000\ntotal blocks = 500\n")
        for i in range(500):
            z.writestr(f"L-0/{i}", bytes([i % 256]))
    with open(tmp_path / "big.dsl", "wb") as f:
        f.seek(3_000_000_000)
        f.write(held.getvalue())
    rows = blocks.capture_blocks(spark, str(tmp_path / "big.dsl"), "dsl")
    assert sorted((r["block"], r["data"][0]) for r in rows.collect()) == [(i, i % 256) for i in range(500)]
    assert blocks.capture_blocks(spark, str(tmp_path / "big.dsl"), "dsl", max_samples=80).count() == 10


def test_files(spark, word_table, stream, tmp_path):
    rows = word_table([(5, 1, 65), (10, 1, 66), (20, 1, 67)])
    names = stream([(0, "a.bin"), (10, "b.bin"), (30, "c.bin")], "value", kinds="string")
    routed = sinks.routed(rows, names, K)
    sinks.write_files(sinks.file_chunks(routed, K, sinks.word_bytes(routed), chunk_bytes=1), f"file://{tmp_path}", K)
    assert (tmp_path / "1/a.bin").read_bytes() == b"A" and (tmp_path / "1/b.bin").read_bytes() == b"BC"
    assert sorted(p.name for p in (tmp_path / "1").iterdir() if not p.name.startswith(".")) == ["a.bin", "b.bin"]
    index = sinks.capture_index(routed, K).orderBy("file_num").collect()
    assert [(r["file_num"], r["filename"], r["bytes"], r["start_time_us"], r["duration_us"], r["start_pos"]) for r in index] == [
        (1, "a.bin", 1, "0.005000", "0.000000", 0), (2, "b.bin", 2, "0.010000", "0.010000", 1)
    ]
    assert [r["line"] for r in sinks.csv_lines(routed, K, True, 4).orderBy("ts_ns").collect()] == ["0,5,0041", "0,10,0042", "1,20,0043"]
    with pytest.raises(StreamError):
        sinks.routed(rows, None, K)


def test_line_clock(word_table, stream):
    rows = word_table([(t, 1, 0) for t in range(100, 106)])
    clock = stream([(0, False), (101, True), (103, False)], "value")
    row = sinks.line_clock_records(rows, stream([(0, "a.bin")], "value", kinds="string"), clock, K).first()
    assert tuple(row)[4:] == (1, 101, 3, 103, 1, 101, 3, 103)
    early = stream([(0, False), (50, True), (101, False), (102, True), (102, False)], "value")
    found = sinks.line_clock_records(rows, stream([(0, "a.bin")], "value", kinds="string"), early, K).collect()
    assert [tuple(r)[4:] for r in found] == [(2, 102, 2, 102, 2, 102, 2, 102)]


def test_uart_in_batches_of_any_size(spark):
    """Frames that cross batches, keys of one row and many keys in a batch are read as by time buckets; nothing of a line goes through more than one exchange."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        times = sorted(rng.sample(range(4000), rng.choice([1, 2, 30, 300])))
        rows += [(k, t * 7, i, rng.random() < 0.5) for i, t in enumerate(times)]
    line = spark.createDataFrame(rows, "k int, ts_ns long, seq long, value boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for settings in ({}, {"parity": "even", "msb_first": True}, {"inverted": True, "stop_bits": 0}):
            wanted = sorted(decode.uart(line, ["k"], 1e7, bucket_ns=5000, **settings).collect(), key=str)
            for size in (1, 3, 50, 10_000):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
                found = decode.uart(line, ["k"], 1e7, **settings)
                assert sorted(found.collect(), key=str) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
