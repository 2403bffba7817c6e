"""Hold-off and arming by maps of buckets equal a plain loop, also where a timeline never pauses."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.operators import events, timeline, words


def plain_choice(rows, hold, rearmed):
    """rows (ts, side, seq) of one key: accepted seq."""
    armed, allowed, out = True, None, []
    for t, side, seq in sorted(rows):
        if side == 0:
            armed = True
        elif armed and (allowed is None or t >= allowed):
            out.append(seq)
            armed, allowed = not rearmed, t + hold
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), min_size=1, max_size=40), st.integers(0, 25), st.booleans(), st.integers(-20, 90), st.booleans())
def test_map_of_a_bucket(rows, hold, rearmed, allowed, armed):
    """A bucket entered with any state is left with the state that the loop reaches."""
    rows = sorted((t, int(e) if rearmed else 1) for t, e in rows)
    armed = armed or not rearmed
    allowed = min(allowed, rows[0][0] + hold)
    ts, event = np.array([r[0] for r in rows]), np.array([r[1] == 1 for r in rows])
    ends, left, with_arm, first, rearms = timeline._bucket_map(ts, event, hold, rearmed)
    want = allowed, armed
    for t, side in rows:
        if side == 0:
            want = want[0], True
        elif want[1] and t >= want[0]:
            want = t + hold, not rearmed
    least = allowed if armed else max(first, allowed) if first is not None else allowed
    got = (allowed, armed or rearms)
    if armed or first is not None:
        i = int(np.searchsorted(ends, least))
        got = (int(left[i]), bool(with_arm[i])) if i < len(ends) else got
    assert got == want


def dense(n, seed, keys=(1, None)):
    """Rows of each key that never pause, and rearms among them."""
    rng = random.Random(seed)
    return [(k, t, i, int(rng.random() < 0.8)) for k in keys for i, t in enumerate(sorted(rng.choices(range(3 * n), k=n)))]


@pytest.mark.parametrize(("hold", "width"), [(7, 10), (7, 1000), (500, 20), (0, 50), (1, 3)])
def test_holdoff_and_rearm_in_buckets(spark, hold, width):
    rows = dense(400, hold)
    table = spark.createDataFrame(rows, "k int, ts_ns long, seq long, side int")
    found = events.event_control(table.where("side = 1").drop("side"), ["k"], 0, hold, bucket_ns=width)
    want = sorted((str(k), s) for k in (1, None) for s in plain_choice([(t, 1, i) for kk, t, i, e in rows if kk == k and e], hold, False))
    assert sorted((str(r["k"]), r["seq"]) for r in found.collect()) == want
    if hold:
        found = events.event_control(table.where("side = 1").drop("side"), ["k"], 0, hold, table.where("side = 0").drop("side"), bucket_ns=width)
        want = sorted((str(k), s) for k in (1, None) for s in plain_choice([(t, e, i) for kk, t, i, e in rows if kk == k], hold, True))
        assert sorted((str(r["k"]), r["seq"]) for r in found.collect()) == want


@pytest.mark.parametrize("width", [None, 40])
def test_matches_at_ends_by_default_are_native(spark, width):
    rng = random.Random(2)
    rows = [(1, t, i, rng.randrange(1, 60), 5) for i, t in enumerate(sorted(rng.sample(range(2000), 150)))]
    table = spark.createDataFrame(rows, "k int, ts_ns long, seq long, duration_ns long, value long")
    found, allowed = words.match_words(table, ["k"], F.lit(True), bucket_ns=width), None
    want = []
    for _, t, i, n, _ in rows:
        if allowed is None or t + n >= allowed:
            want.append(i)
            allowed = t + n
    assert sorted(r["seq"] for r in found.collect()) == want
    assert "mapInArrow" not in (plan := found._jdf.queryExecution().toString()) and "MapInArrow" not in plan


def test_many_rows_of_one_key_are_chosen_by_many_tasks(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("ts_ns"), F.col("id").alias("seq"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = timeline.greedy(rows, ["k"], 10, bucket_ns=9000).withColumn("task", F.spark_partition_id())
        assert found.select("task").distinct().count() == 4 and found.count() == 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_payload_types_added_later_need_no_rewriting(spark, tmp_path):
    from pyspark.sql import types as T

    from pulseframe.functions import payload

    rows = spark.createDataFrame([(1, 5, 0, "a", (1 << 62) + 1, [1, 2]), (None, 6, 1, None, None, None)], "k int, ts_ns long, seq long, kind string, number long, list array<int>")
    first = payload.PayloadType("first", T.StructType().add("kind", "string").add("number", "long"))
    later = payload.PayloadType("later", T.StructType().add("kind", "string").add("list", T.ArrayType(T.IntegerType())).add("absent", "long"))
    held = str(tmp_path / "p")
    payload.with_payload(rows, ["k"], first).write.parquet(held)
    payload.with_payload(rows, ["k"], later, F.struct("kind", "list")).write.mode("append").parquet(held)
    stored = spark.read.parquet(held)
    assert dict(stored.dtypes)["payload"] == "variant"
    assert sorted(map(tuple, payload.payloads_of(stored, ["k"], first).collect()), key=str) == [(1, 5, 0, "a", (1 << 62) + 1), (None, 6, 1, None, None)]
    assert sorted(map(tuple, payload.payloads_of(stored, ["k"], later).collect()), key=str) == [(1, 5, 0, "a", [1, 2], None), (None, 6, 1, None, None, None)]
    assert sorted(r[0] for r in stored.select(payload.field("$.list[1]", "int").alias("x")).where("x is not null").collect()) == [2]


def test_lanes_of_many_keys_have_few_folders(spark, tmp_path):
    from pulseframe.sources import sinks

    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), F.col("id").alias("ts_ns"), F.col("id").alias("seq"), F.lit(True).alias("value"))
    folder = str(tmp_path / "lanes")
    sinks.write_lanes(rows, folder, ["k"], 1000, groups=4)
    assert len(list((tmp_path / "lanes").glob("ts_bucket=*/key_group=*"))) <= 12
    found = sinks.read_lanes(spark, folder, 900, 2100, 1000)
    assert sorted(r["seq"] for r in found.collect()) == list(range(900, 2100))
    one = sinks.read_lanes(spark, folder, 0, 3000, 1000, {"k": 7}, groups=4)
    assert sorted(r["seq"] for r in one.collect()) == list(range(7, 3000, 500)) and "key_group" in one._jdf.queryExecution().toString()
