from __future__ import annotations

import os
import random
from pathlib import Path

import pytest

from pulseframe.operators import levels as lv
from pulseframe.operators import retrieval
from pulseframe.operators.tiers import Tiers, append_tiers, folded, grid_of_tiers, joined, next_edge_of_tiers, snapshot_of_tiers
from pulseframe.schema import StreamError
from pulseframe.shared import shared_path

K = ["k"]
SCHEMA = "k long, ts_ns long, seq long, value boolean"
WINDOWS = [(-300, 7000, 9), (1024, 3072, 4), (200, 260, 100), (60_000, 70_000, 2)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def kept(spark):
    """Levels of five keys (one null, one of a single row), stored in three batches, the second one twice; a fourth without its mark."""
    random.seed(9)
    rows, seq = [], 0
    for k, n in ((1, 900), (None, 500), ((1 << 53) + 1, 250), (4, 1), (5, 40)):
        t = random.randrange(-400, 50)
        for _ in range(n):
            t += random.choice([0, 0, 1, 2, 5, 40])
            seq += 1
            rows.append((k, t, seq, random.random() < 0.5))
    store = Tiers(shared_path(spark, "tiers"), ("k",), 16, 4, 3)
    make = lambda part: spark.createDataFrame(part, SCHEMA)
    cuts = [[r for r in rows if r[1] < 500], [r for r in rows if 500 <= r[1] < 1500], [r for r in rows if r[1] >= 1500]]
    for number, part in ((0, cuts[0]), (1, cuts[1][:5]), (1, cuts[1]), (2, cuts[2])):
        append_tiers(make(part), store, number)
    append_tiers(make([(1, 6000, 1, True), (1, 6001, 2, False)]), store, 3)
    mark = Path(store.folder.removeprefix("file:")) / "marks" / "batch=3"
    os.rename(mark, mark.with_name("_gone"))
    return store, make(rows)


@pytest.mark.parametrize("window", WINDOWS)
def test_grid_and_snapshot_equal_those_of_rows(spark, kept, window):
    store, levels = kept
    start, end, cells = window
    want = retrieval.sampled_grid(levels, K, start, end, cells)
    assert rows_of(grid_of_tiers(spark, store, levels.schema, start, end, cells).select(*want.columns)) == rows_of(want)
    want = retrieval.lane_snapshot(levels, K, start, end, cells)
    assert rows_of(snapshot_of_tiers(spark, store, levels.schema, start, end, cells).select(*want.columns)) == rows_of(want)


def test_only_divided_slots_are_read_from_rows(spark, kept):
    store, levels = kept
    start, end, cells = 40, 1900, 2
    want = rows_of(retrieval.sampled_grid(levels, K, start, end, cells))
    # ends at 41, 970 and 1900 lie in row folders 0, 15 and 29 (of 64 each)
    read, spoilt = spoil_rows(store, (0, 15, 29), lambda: rows_of(grid_of_tiers(spark, store, levels.schema, start, end, cells).select("k", "kind", "start_ns", "end_ns", "first", "last")) == want)
    assert read and spoilt > 5 * read


@pytest.mark.parametrize("most_parts", [1, 1000])
def test_next_edge_equals_that_of_rows(spark, kept, most_parts):
    store, levels = kept
    random.seed(2)
    probes = [(random.choice([1, None, (1 << 53) + 1, 4, 5, 77]), random.randrange(-600, 6000), i % 40, "more") for i in range(300)] + [(1, -(10**9), 1, "more")] * 2
    asked = spark.createDataFrame(probes, "k long, ts_ns long, seq long, value string")
    want = lv.next_edge(levels, asked, K)
    assert rows_of(next_edge_of_tiers(spark, store, levels.schema, asked, most_parts).select(*want.columns)) == rows_of(want)


def test_only_slots_with_edges_are_read(spark):
    """A level that changes twice in 20,000 rows: probes read the folders of these changes and no others."""
    store = Tiers(shared_path(spark, "tiers"), ("k",), 16, 4, 3)
    levels = spark.range(20_000).selectExpr("1L AS k", "id AS ts_ns", "id AS seq", "id >= 5000 AND id < 12345 AS value")
    append_tiers(levels, store, 0)
    asked = spark.createDataFrame([(1, t, 0) for t in (-5, 100, 4999, 5000, 9000, 12344, 12345, 30_000)], "k long, ts_ns long, seq long")
    found = lambda: [r["edge_ns"] for r in next_edge_of_tiers(spark, store, levels.schema, asked).orderBy("ts_ns").collect()]
    read, spoilt = spoil_rows(store, (5000 // 64, 12345 // 64), lambda: found() == [5000, 5000, 5000, 12345, 12345, 12345, None, None])
    assert read == 2 and spoilt > 300


def spoil_rows(store, parts, check):
    """Whether ``check`` holds while all row files outside of some folders are spoilt; how many files were left and spoilt."""
    read, saved = 0, {}
    for path in Path(store.table(None).removeprefix("file:")).rglob("*.parquet"):
        if path.parent.name in {f"part={p}" for p in parts}:
            read += 1
        else:
            saved[path] = path.read_bytes()
            path.write_bytes(b"spoilt")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    try:
        assert check()
    finally:
        for path, data in saved.items():
            path.write_bytes(data)
    return read, len(saved)


def test_records_join_to_those_of_wider_slots(kept):
    _, levels = kept
    fine, wide = folded(levels, K, 16), folded(levels, K, 64)
    from pyspark.sql import functions as F

    assert rows_of(joined(fine, K, F.floor(F.col("slot") / 4).cast("long"))) == rows_of(wide)
    assert wide.agg(F.sum("n")).first()[0] == levels.count()


def test_empty_and_clashing(spark):
    store = Tiers(shared_path(spark, "tiers"), ("k",), 16)
    append_tiers(spark.createDataFrame([], SCHEMA), store, 0)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert grid_of_tiers(spark, store, schema, 0, 100, 4).count() == 0
    assert snapshot_of_tiers(spark, store, schema, 0, 100, 4).count() == 0
    with pytest.raises(StreamError):
        append_tiers(spark.createDataFrame([], "part long, ts_ns long, seq long, value boolean"), Tiers(store.folder, ("part",), 16), 0)
