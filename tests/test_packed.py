"""Decoders over packed blocks give what those over level rows give, whatever the fragments' size."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import decode
from pulseframe.sources import blocks as blk
from pulseframe.sources import packed

STEP = 3


def samples(channels, n, seed, runs=7):
    rng = random.Random(seed)
    out = np.zeros((channels, n), bool)
    for c in range(channels):
        at, value = 0, rng.random() < 0.5
        while at < n:
            size = rng.randrange(1, runs)
            out[c, at : at + size] = value
            at, value = at + size, not value
    return out


def blocks_of(spark, bits, per_block):
    """Packed blocks of two keys; the second one's samples are the first one's inverted."""
    rows = []
    for k in (1, None):
        for c, own in enumerate(bits if k else ~bits):
            for start in range(0, len(own), per_block):
                part = own[start : start + per_block]
                rows.append((k, c, start, len(part), STEP, bytearray(np.packbits(part, bitorder="little").tobytes())))
    return spark.createDataFrame(rows, "k int, channel int, start_pos long, n int, step_ns long, data binary").repartition(5)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def line_levels(spark):
    def make(bits):
        levels = blk.block_levels(blocks_of(spark, bits, 64), ["k", "channel"]).cache()
        return lambda c: levels.where(F.col("channel") == c).drop("channel")

    return make


def test_block_levels_equal_changes(spark):
    bits = samples(3, 500, 1)
    want = []
    for k in (1, None):
        for c, own in enumerate(bits if k else ~bits):
            want += [(k, c, int(i) * STEP, bool(own[i])) for i in range(500) if i == 0 or own[i] != own[i - 1]]
    for size in (8, 56, 4096):
        assert plain(blk.block_levels(blocks_of(spark, bits, size), ["k", "channel"]), "k", "channel", "ts_ns", "value") == sorted(want, key=str)


def test_blocks_of_one_channel_are_decoded_by_many_tasks(spark):
    bits = samples(1, 64 * 64, 2)
    held = blocks_of(spark, bits, 64).where("k = 1").repartition(8)
    levels = blk.block_levels(held, ["k", "channel"]).withColumn("task", F.spark_partition_id())
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert levels.select("task").distinct().count() >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


@pytest.mark.parametrize(
    ("size", "settings"),
    [
        (64, {"mode": 0, "bits": 5}), (8, {"mode": 1, "bits": 3, "cs_active": "high", "msb_first": False}), (400, {"mode": 2, "bits": 1}),
        (4096, {"mode": 3, "bits": 8}), (64, {"mode": 0, "bits": 7, "cs_active": "disabled"}),
    ],
)
def test_packed_spi(spark, line_levels, size, settings):
    bits = samples(4, 1500, size)
    bits[1] = samples(1, 1500, size + 1, 90)[0]
    line = line_levels(bits)
    want = decode.spi(line(0), line(1), {"mosi": line(2), "miso": line(3)}, ["k"], **settings)
    found = packed.spi(blocks_of(spark, bits, size), ["k"], 0, 1, {"mosi": 2, "miso": 3}, **settings)
    assert plain(found, "k", "line", "ts_ns", "duration_ns", "value") == plain(want, "k", "line", "ts_ns", "duration_ns", "value") != []


@pytest.mark.parametrize(
    ("size", "settings"),
    [
        (64, {"cycles": 3}), (8, {"cycles": 20, "mode": "any"}), (400, {"cycles": 1, "mode": "falling", "enable": True}), (64, {"cycles": 2, "enable": True, "cs": True, "little_endian": False}),
        (4096, {"cycles": 4, "mode": "high", "enable": True, "enable_high": False}), (72, {"cycles": 2, "mode": "low", "cs": True, "cs_active": "high"}),
    ],
)
def test_packed_parallel(spark, line_levels, size, settings):
    bits = samples(6, 1300, size + 7)
    bits[4], bits[5] = samples(1, 1300, size, 120)[0], samples(1, 1300, size + 1, 150)[0]
    line = line_levels(bits)
    own = {k: v for k, v in settings.items() if k not in ("enable", "cs")}
    given = {name: channel for name, channel in (("enable", 4), ("cs", 5)) if name in settings}
    want = decode.parallel_bus(line(0), [line(1), line(2), line(3)], ["k"], step_ns=STEP, end_ns=1300 * STEP, **own, **{k: line(c) for k, c in given.items()})
    found = packed.parallel_bus(blocks_of(spark, bits, size), ["k"], 0, [1, 2, 3], **own, **given)
    assert plain(found, "k", "ts_ns", "duration_ns", "value") == plain(want, "k", "ts_ns", "duration_ns", "value") != []


def test_packed_words_of_64_bits_and_of_nothing(spark):
    bits = np.ones((9, 64), bool)
    bits[8] = np.arange(64) % 2 == 1
    held = blocks_of(spark, bits, 16).where("k = 1")
    found = packed.parallel_bus(held, ["k"], 8, range(8), cycles=8)
    assert plain(found, "ts_ns", "value") == [(1 * STEP, -1), (17 * STEP, -1), (33 * STEP, -1), (49 * STEP, -1)] or plain(found, "value") == [(-1,)] * 4
    assert packed.parallel_bus(held.limit(0), ["k"], 8, range(8)).count() == 0
