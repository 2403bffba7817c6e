"""Small literal cases of level and event operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import events, levels
from pulseframe.operators.timeline import as_of, carried, greedy
from pulseframe.schema import StreamError

K = ["k"]


def times(df):
    return sorted(r["ts_ns"] for r in df.collect())


def points(df, column="value"):
    return [(r["ts_ns"], r[column]) for r in sorted(df.collect(), key=lambda r: (r["ts_ns"], r["seq"]))]


def test_edge_modes(stream):
    line = stream([(0, False), (10, True), (20, False), (30, True)], "value")
    assert times(levels.edges(line, K, "rising")) == [10, 30]
    assert times(levels.edges(line, K, "falling")) == [20]
    assert times(levels.edges(line, K, "both")) == [10, 20, 30]
    with pytest.raises(StreamError):
        levels.edges(line, K, "up")


def test_edge_width_and_debounce(stream):
    line = stream([(0, False), (4, True), (12, False), (20, True), (28, False)], "value")
    assert times(levels.edges(line, K, "both", debounce_ns=10, min_pulse_ns=5)) == [12, 28]


def test_event_control(stream):
    found = events.event_control(stream([10, 15, 30]), K, delay_ns=5, holdoff_ns=10)
    assert times(found) == [15, 35]
    manual = events.event_control(stream([10, 20, 30, 40]), K, holdoff_ns=5, rearms=stream([20, 35]))
    assert times(manual) == [10, 20, 40]
    armed = events.event_control(stream([10, 20, 30, 40]), K, rearms=stream([20, 35]))
    assert times(armed) == [10, 20, 40]


def test_gate_change_at_the_event_comes_first(stream):
    assert times(events.event_gate(stream([5, 10, 20]), stream([(10, True), (20, False)], "value"), K)) == [10]
    assert times(events.event_gate(stream([5, 10, 20]), stream([(10, True), (20, False)], "value"), K, active_high=False)) == [5, 20]


def test_counter(stream):
    assert points(events.event_counter(stream([7, 9]), K, start=3, step=2)) == [(0, 3), (7, 5), (9, 7)]
    assert points(events.event_counter(stream([]), K)) == []


def test_latch(stream):
    found = events.sr_latch(stream([5, 6, 20]), stream([10, 20]), K)
    assert points(found) == [(0, False), (5, True), (10, False), (20, True), (20, False)]
    assert points(events.sr_latch(stream([5]), stream([3]), K, initial=True)) == [(0, True), (3, False), (5, True)]


def test_gates(stream):
    a, b = stream([(0, False), (10, True), (30, False)], "value"), stream([(0, False), (20, True)], "value")
    assert points(levels.logic_gate([a, b], K, "AND")) == [(0, False), (20, True), (30, False)]
    assert points(levels.logic_gate([a, b], K, "OR")) == [(0, False), (10, True)]
    assert points(levels.logic_gate([a, b], K, "XOR")) == [(0, False), (10, True), (20, False), (30, True)]
    assert points(levels.logic_gate([a, b], K, "NAND")) == [(0, True), (20, False), (30, True)]
    assert points(levels.logic_gate([a], K, "NOT")) == [(0, True), (10, False), (30, True)]


def test_gate_glitch_of_opposite_edges(stream):
    a, b = stream([(0, True), (10, False)], "value"), stream([(0, False), (10, True)], "value")
    assert points(levels.logic_gate([a, b], K, "OR"))[-2:] == [(10, False), (10, True)]
    assert points(levels.logic_gate([a, b], K, "OR", coalesce_ties=True)) == [(0, False), (0, True)]


def test_markers(stream):
    base = stream([0])
    assert points(levels.marker_relation(base, K, 50, "before")) == [(0, True), (50, False)]
    assert points(levels.marker_relation(base, K, 50, "at_or_after")) == [(0, False), (50, True)]
    assert points(levels.marker_relation(base, K, 0, "at_or_after")) == [(0, True)]
    assert points(levels.marker_window(base, K, 10, 20)) == [(0, False), (10, True), (20, False)]
    assert points(levels.marker_window(base, K, 10, 10)) == [(0, False)]
    with pytest.raises(StreamError):
        levels.marker_window(base, K, 20, 10)


def test_pulses(stream):
    line = stream([(100, True), (150, False), (300, True), (320, False)], "value")
    assert points(levels.pulse_widths(line, K), "width_ns") == [(100, 50), (300, 20)]
    row = levels.pulses_at(line, stream([160]), K).first()
    assert (row["value"], row["start_ns"], row["end_ns"], row["period_ns"], row["duty_ppm"]) == (False, 150, 300, 170, 882352)
    assert levels.pulses_at(line, stream([310]), K).first()["period_ns"] is None


def test_value_and_next_edge(stream):
    line = stream([(0, False), (10, True), (20, True), (30, False)], "value")
    assert [v for _, v in points(levels.value_at(line, stream([0, 10, 29, 99]), K))] == [False, True, True, False]
    found = levels.next_edge(line, stream([0, 10, 30]), K).orderBy("ts_ns").collect()
    assert [(r["edge_ns"], r["edge_value"]) for r in found] == [(10, True), (30, False), (None, None)]
    assert times(levels.next_edges(line, K, 0, 30, 5)) == [10]


def test_activity(stream):
    line = stream([(0, False), (10, True), (70, False), (130, True)], "value")
    row = levels.activity(line, K, 1, 192).first()
    assert (row["active_groups"], row["high_groups"], row["groups"]) == (3, 2, 3)


def test_activity_to_the_last_position(stream):
    line = stream([(0, False), (10, True), (70, False), (130, True), (5000, False), (5001, True)], "value")
    row = levels.activity(line, K, 1).first()
    # 5002 positions are 79 groups; high from 130 on, so that of all groups only number 1 ends low
    assert (row["active_groups"], row["high_groups"], row["groups"]) == (4, 78, 79)


def test_pulse_lane_drops_overlaps(stream):
    assert points(events.pulse_lane(stream([10, 500, 2000]), K, 1000)) == [(0, False), (10, True), (1010, False), (2000, True), (3000, False)]


def test_greedy_equals_a_loop(spark):
    import random

    random.seed(3)
    rows = [(random.randrange(6), random.randrange(3000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, ts_ns long, seq long")
    want = []
    for k in range(6):
        last = None
        for _, t, s in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or t - last >= 37:
                want.append((k, t, s))
                last = t
    assert sorted(map(tuple, greedy(df, K, 37).select("k", "ts_ns", "seq").collect())) == sorted(want)


@pytest.mark.parametrize("bucket", [7, 100, 10_000])
def test_carry_does_not_depend_on_the_bucket(spark, bucket):
    rows = [(1, t, t, (t * 7 % 11) if t % 5 == 0 else None) for t in range(3, 400, 3)]
    df = spark.createDataFrame(rows, "k int, ts_ns long, seq long, x long")
    last, want = None, []
    for _, t, _, x in rows:
        last = x if x is not None else last
        want.append(last)
    assert [r["carried"] for r in carried(df, K, "x", bucket).orderBy("ts_ns").collect()] == want


def test_as_of_ties(stream):
    left, right = stream([10]), stream([(5, True), (10, False)], "value")
    value = lambda **x: as_of(left, right, K, {"value": "v"}, **x).first()["v"]
    assert value() is False
    assert value(inclusive=False) is True
    assert value(forward=True) is False
    assert value(forward=True, inclusive=False) is None


def test_missing_columns(spark):
    with pytest.raises(StreamError):
        events.event_counter(spark.range(1).withColumn("k", F.lit(1)), K)


@pytest.mark.parametrize("bucket", [5, 40, 10_000])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_in_buckets(spark, bucket, forward, inclusive):
    import random

    random.seed(7)
    make = lambda n: [(random.choice([1, 2, None]), random.randrange(300), i, i) for i in range(n)]
    left, right = (spark.createDataFrame(make(n), "k int, ts_ns long, seq long, x long") for n in (80, 25))
    found = [as_of(left, right, K, {"x": "y"}, inclusive, forward, b) for b in (None, bucket)]
    plain, bucketed = (sorted(map(tuple, df.collect()), key=str) for df in found)
    assert plain == bucketed and len(plain) == 80
