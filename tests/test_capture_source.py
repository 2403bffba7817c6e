"""Data sources of captures: what filters leave unread, and growing captures followed across restarts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from pulseframe.schema import StreamError
from pulseframe.sources import blocks as blk
from pulseframe.sources import capture_source as cs
from pulseframe.sources import sinks
from pulseframe.streaming import ordered as o

NAMES = ["a", "b", "c"]


def packed_blocks(spark, n=4000, per_block=512):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(len(NAMES)):
        bits = np.repeat(rng.integers(0, 2, n), rng.integers(1, 9, n))[:n].astype(np.uint8)
        for i, start in enumerate(range(0, n, per_block)):
            part = bits[start : start + per_block]
            rows.append(("x", c, i, start, len(part), 10, bytearray(np.packbits(part, bitorder="little").tobytes())))
    return spark.createDataFrame(rows, "capture_id string, channel int, block long, start_pos long, n int, step_ns long, data binary")


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module", params=["dsl", "sr"])
def archive(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures") / f"x.{request.param}")
    own = packed_blocks(spark).drop("capture_id")
    if request.param == "dsl":
        sinks.export_dsl(own, path, NAMES, "100 MHz")
    else:
        sinks.export_session(own, path, NAMES, 100_000_000)
    cs.register(spark)
    return request.param, path


def test_formats_equal_capture_blocks(spark, archive):
    kind, path = archive
    columns = ("channel", "block", "start_pos", "n", "step_ns", "data")
    want = plain(blk.capture_blocks(spark, path, kind), *columns)
    own = spark.read.format(f"pulse_{kind}").load(path)
    assert plain(own, *columns) == want
    assert plain(own.where("channel = 1 and start_pos >= 1024 and start_pos < 2048 and n > 5"), *columns) == [r for r in want if r[0] == 1 and 1024 <= r[2] < 2048]
    assert plain(own.where("channel in (0, 2) and step_ns = 10"), *columns) == [r for r in want if r[0] != 1]
    assert own.where("channel = 7").count() == 0
    for most in (512, 700, 10**9):
        held = spark.read.format(f"pulse_{kind}").option("max_samples", most).load(path)
        assert plain(blk.block_levels(held, ["channel"]), "channel", "ts_ns", "value") == plain(blk.block_levels(blk.capture_blocks(spark, path, kind), ["channel"], most), "channel", "ts_ns", "value")


def test_entries_outside_filters_are_not_opened(archive, monkeypatch):
    kind, path = archive
    reader = cs.CaptureReader(kind, {"path": path, "max_samples": "2048"})
    rest = list(reader.pushFilters([ds.EqualTo(("channel",), 1), ds.GreaterThanOrEqual(("start_pos",), 512), ds.EqualTo(("n",), 512), ds.IsNotNull(("channel",))]))
    assert [type(f).__name__ for f in rest] == ["EqualTo", "IsNotNull"]
    opened = []
    read = blk.zipfile.ZipFile.read
    parts = reader.partitions()
    monkeypatch.setattr(blk.zipfile.ZipFile, "read", lambda self, name, *a: opened.append(name) or read(self, name, *a))
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    data = [name for name in opened if name not in ("header", "version", "metadata")]
    assert len(data) == 3 and [(r["channel"], r["start_pos"]) for r in rows] == [(1, 512), (1, 1024), (1, 1536)]


def test_options_are_checked():
    with pytest.raises(StreamError):
        cs.CaptureReader("dsl", {})
    with pytest.raises(StreamError):
        cs.FollowReader({"path": "/x"})


def test_committed_prefix(spark, tmp_path):
    """The offset passes a position once all channels have it without a hole; a file counts whenever it comes."""
    own = packed_blocks(spark, 2048, 512)
    reader = cs.FollowReader({"path": str(tmp_path), "channels": "3"})
    add = lambda i, where: own.where(where).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    assert reader.latestOffset() == {"position": 0} == reader.initialOffset()
    add(1, "block = 1")
    assert reader.latestOffset() == {"position": 0}
    add(2, "block = 0 and channel < 2")
    assert reader.latestOffset() == {"position": 0}
    (tmp_path / "half.parquet").write_bytes(b"PAR1 not yet whole")
    add(3, "block = 0 and channel = 2")
    assert reader.latestOffset() == {"position": 1024}
    add(4, "block in (2, 3)")
    end = reader.latestOffset()
    assert cs.raw_position(end) == 2048 == cs.raw_position('{"position": 2048}')
    again = cs.FollowReader({"path": str(tmp_path), "channels": "3"})
    for a, b in ((0, 1024), (1024, 2048), (2048, 2048)):
        rows = [r for p in again.partitions({"position": a}, {"position": b}) for x in again.read(p) for r in x.to_pylist()]
        assert sorted((r["channel"], r["start_pos"]) for r in rows) == [(c, s) for c in range(3) for s in range(a, b, 512)]


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_folder_equals_batch(spark, tmp_path, seed):
    """Three runs with one checkpoint, between them new files: the levels of the whole capture, each once."""
    cs.register(spark)
    own, rng = packed_blocks(spark), random.Random(seed)
    places = [(r["channel"], r["block"]) for r in own.select("channel", "block").collect()]
    rng.shuffle(places)
    name, got = f"follow_{seed}", []
    for i in range(3):
        some = spark.createDataFrame(places[i::3], "channel int, block long")
        own.join(some, ["channel", "block"]).select(*own.columns).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.format("pulse_blocks").option("path", str(tmp_path / "in")).option("channels", 3).load()
        query = o.follow_levels(rows, ["channel"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).queryName(f"{name}_{i}").trigger(availableNow=True).start()
        query.awaitTermination(200)
        got.append(cs.raw_position(query.lastProgress["sources"][0]["endOffset"]) if query.lastProgress else got[-1] if got else 0)
    assert got == sorted(got) and got[-1] == 4000
    found = spark.read.parquet(str(tmp_path / "out"))
    assert plain(found, "channel", "ts_ns", "value") == plain(blk.block_levels(own, ["channel"]), "channel", "ts_ns", "value")
    assert found.where(F.col("seq") * 10 != F.col("ts_ns")).count() == 0
