"""Bucketed timelines equal plain ones, whatever the width; null and large keys are keys like any other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import decode, events, levels, retrieval, text, trigger, words
from pulseframe.operators.timeline import greedy, part_codes

K = ["k"]
KEYS = [1, None, (1 << 53), (1 << 53) + 1]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)

    def make(n, *payload):
        rows = []
        for k in KEYS:
            for i, t in enumerate(sorted(rng.sample(range(3000), n))):
                rows.append((k, t, i, *(rng.random() < 0.5 if p == "boolean" else rng.randrange(1, 60) for p in payload)))
        return rows

    level = [spark.createDataFrame(make(50, "boolean"), "k long, ts_ns long, seq long, value boolean") for _ in range(4)]
    word = spark.createDataFrame(make(60, "long", "long"), "k long, ts_ns long, seq long, duration_ns long, value long")
    return level, word


OPERATORS = {
    "next_edge": lambda lv, w, b: levels.next_edge(lv[0], lv[1], K, bucket_ns=b),
    "edges": lambda lv, w, b: levels.edges(lv[0], K, "both", 90, 5, b),
    "logic_gate": lambda lv, w, b: levels.logic_gate(lv[:3], K, "XOR", bucket_ns=b),
    "pulses_at": lambda lv, w, b: levels.pulses_at(lv[0], lv[1].drop("value"), K, b),
    "event_control": lambda lv, w, b: events.event_control(lv[0], K, 2, 70, lv[1], b),
    "rearm": lambda lv, w, b: events.event_control(lv[0], K, rearms=lv[1], bucket_ns=b),
    "counter": lambda lv, w, b: events.event_counter(lv[0], K, bucket_ns=b),
    "latch": lambda lv, w, b: events.sr_latch(lv[0], lv[1], K, bucket_ns=b),
    "match_words": lambda lv, w, b: words.match_words(w, K, F.col("value") > 9, every=2, holdoff_ns=40, rearms=lv[0], bucket_ns=b),
    "framer": lambda lv, w, b: words.frame_packets(w, K, 3, F.col("value") % 8 == 0, False, 90, boundaries=lv[1], gate=lv[0], bucket_ns=b),
    "formatter": lambda lv, w, b: text.text_formatter([w, w.withColumn("ts_ns", F.col("ts_ns") + 3)], K, "{0}/{1}", b),
    "grid": lambda lv, w, b: retrieval.sampled_grid(lv[0], K, 100, 2000, 10, b),
    "snapshot": lambda lv, w, b: retrieval.lane_snapshot(lv[0], K, 100, 900, 12, b),
    "decoder_table": lambda lv, w, b: retrieval.decoder_table(w, w.withColumn("ts_ns", F.col("ts_ns") + 1), K, 40, 2, b),
    "uart": lambda lv, w, b: decode.uart(lv[0], K, 1e8, bucket_ns=b),
    "spi": lambda lv, w, b: decode.spi_transactions(lv[0], lv[1], {"mosi": lv[2]}, K, bits=3, bucket_ns=b),
    "parallel": lambda lv, w, b: decode.parallel_bus(lv[0], lv[1:3], K, cycles=2, enable=lv[3], bucket_ns=b),
    "i2c": lambda lv, w, b: decode.i2c(lv[0], lv[1], K, b),
    "trigger": lambda lv, w, b: trigger.find_trigger(
        trigger.channel_rows(lv[:2], K, b), K, trigger.Program([trigger.Stage({0: "rising"}, count=2), trigger.Stage({1: "high"}, count=2, counting="consecutive")]), 2, b
    ),
}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_buckets_and_keys(spark, tables, name):
    level, word = tables
    own = OPERATORS[name]
    plain = own(level, word, None)
    found = rows_of(plain)
    assert found == rows_of(own(level, word, 170).select(*plain.columns))
    # each key alone, under another name
    at = plain.columns.index("k")
    for k in (None, (1 << 53) + 1):
        only = lambda df: df.where(F.col("k").eqNullSafe(F.lit(k))).withColumn("k", F.lit(7).cast("long"))  # noqa: B023, E731
        alone = rows_of(own([only(x) for x in level], only(word), None))
        assert alone == rows_of(plain.where(F.col("k").eqNullSafe(F.lit(k))).withColumn("k", F.lit(7).cast("long"))) and at == 0


def test_greedy_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, t, t) for t in range(0, 60, 10)] + [((1 << 53) + i, 5, i) for i in range(2)], "k long, ts_ns long, seq long")
    assert rows_of(greedy(rows, K, 25).where("k is null").select("ts_ns")) == [(0,), (30,)] and greedy(rows, K, 25).where("k is not null").count() == 2


def test_part_codes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": pa.array([None, None, 1 << 53, (1 << 53) + 1, None]), "s": pa.array(["a", "a", "a", "a", None])})
    assert part_codes(batch, ["k"]).tolist() == [True, False, True, True, True] and part_codes(batch, ["s"]).tolist() == [True, False, False, False, True]


def test_joins_keep_null_keys(spark, tables):
    level, word = tables
    assert trigger.retain_recent(word, K, 5000).count() == word.count()
    pins = spark.createDataFrame([(None, 0)], "k long, pin_ns long")
    assert trigger.retain_recent(word, K, 0, pins).where("k is null").count() == 60
    assert retrieval.presence_histogram(word, K, 0, 3000, 4).where("k is null").count() == 4
    assert levels.activity(level[0], K, 1, 3000).where("k is null").first()["active_groups"] > 0
    first = word.groupBy("k").agg(F.min("ts_ns").alias("trigger_ns"))
    assert trigger.slice_capture(word, first, K, 0, 10_000).count() == word.count()


def test_policies(spark):
    rows = spark.createDataFrame([(k, t, t) for k in (1, 2, None) for t in range(0, 100, 10)], "k long, ts_ns long, seq long")
    hit = spark.createDataFrame([(1, 50)], "k long, trigger_ns long")
    at = lambda **x: sorted((r["k"] or 0, r["ts_ns"]) for r in trigger.record(rows, hit, K, trigger.Policy(**x)).collect())
    assert at(before_ns=10, after_ns=20) == [(1, 40), (1, 50), (1, 60)]
    assert at(before_ns=0, after_ns=10, timeout_ns=20, timeout="force") == [(0, 20), (1, 20), (2, 20)]
    assert at(before_ns=0, after_ns=10, timeout_ns=20, timeout="stop") == []
    assert at(start="immediate", after_ns=10) == [(0, 0), (1, 0), (2, 0)]
    assert at(placement=0.5, total_ns=40) == [(1, 30), (1, 40), (1, 50), (1, 60)]
    assert trigger.Program.simple({0: "ignore", 3: "low"}).stages[0].conditions == {3: "low"}
    assert trigger.Program([trigger.Stage({0: "low", 1: "low"}, count=2)]).problems(2, trigger.Limits(count_step=2, all_predicates=1)) == ["count_step:0", "resources:2"]
    assert trigger.samples_of(1500, 1_000_000) == 2
    blocks = spark.createDataFrame([(1, i, bytearray(4)) for i in range(5)], "k long, block long, data binary")
    assert sorted(r["block"] for r in trigger.retain_bytes(blocks, K, 9).collect()) == [3, 4]


def test_small_functions(spark, tables, tmp_path):
    from pulseframe.functions import formats, payload, udf
    from pulseframe.schema import SEQ, TS
    from pulseframe.streaming import ordered as o

    level, word = tables
    assert words.semi_in_set(word, spark.createDataFrame([(5,), (261,)], "value long"), 255).count() == word.where("value = 5").count()
    found = words.match_words(word, K, F.lit(True))
    assert words.match_lane(found, K).where("value").count() > 0
    frames = decode.uart(level[0], K, 1e8)
    assert decode.uart_errors(frames, K).count() == frames.where("framing_error or parity_error").count()
    assert decode.uart_frames(frames, K, 1e8).count() == 3 * frames.count()
    cells = decode.word_cells(decode.spi_samples(level[0], level[1], {"mosi": level[2]}, K), K)
    assert cells.where("cell_start > ts_ns or cell_end < ts_ns").count() == 0 and cells.count() > 0
    assert [retrieval.pick_tier(n, 10) for n in (40, 41, 2561, 10**9)] == [0, 1, 2, 3]
    names = spark.createDataFrame([(1, 0, 0, "a{0}"), (1, 1500, 1, "b{n:03}")], "k long, ts_ns long, seq long, template string")
    shown = {r["value"][0] for r in text.timed_formatter(word.where("k = 1"), names, K, ["a{0}", "b{n:03}"]).collect()}
    assert shown == {"a", "b"}
    assert levels.forward_value(level[0], K, True).where("value and next_ns <> ts_ns").count() == 0
    assert retrieval.last_values(level[0], K).where("before is null").count() == 4
    double = udf.stream_udf(lambda r: r[["ts_ns"]].head(1), "ts_ns long", ["value"])
    assert double(word.where("k = 1"), K).count() == 1
    kind = payload.PayloadType("x", word.select("value").schema)
    assert payload.payloads_of(payload.with_payload(word, K, kind), K, kind).count() == word.count()
    label = formats.spi_label({"mosi": F.array(F.lit(1), F.lit(300)), "miso": F.lit(None).cast("array<int>")}, 12, F.lit(False), F.lit(3))
    assert spark.range(1).select(label).first()[0] == "MOSI [001 12C] · Incomplete (3 bits)"
    assert spark.range(1).select(formats.bytes_label(F.unhex(F.lit("0102" * 9))), formats.container_label(F.array(F.lit(1)), "list")).first() == ("[" + "01 02 " * 7 + "01 02 … +2]", "list[1]")
    timed = word.where("k = 1").withColumn("ts", F.timestamp_micros(F.col("ts_ns") * 1_000_000))
    assert o.gap_sessions(timed, K, "10 minutes", "1 hour").count() == o.gap_sessions(timed.repartition(3), K, "10 minutes", "1 hour").count() > 0
    assert sum(r["n_words"] for r in o.presence_counts(timed, K, "1 hour", "1 hour").collect()) == 60 and (TS, SEQ) == ("ts_ns", "seq")
