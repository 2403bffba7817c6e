from __future__ import annotations

import random

import pandas as pd
import pytest

from pulseframe.functions import udf


def folds():
    """The user's functions; those of a test module can't be imported by workers."""

    def gaps(state, rows):
        """Time since the row before and the sum of x so far; a null x is none."""
        out = []
        for t, x in zip(rows["ts_ns"], rows["x"], strict=True):
            out.append((t, None if "t" not in state else t - state["t"], state.get("sum", 0) + (x if pd.notna(x) else 0)))
            state.update(t=t, sum=out[-1][2])
        return pd.DataFrame(out, columns=["ts_ns", "gap", "total"], dtype=object)

    def last(state):
        return pd.DataFrame([(state["t"], -1, state["sum"])], columns=["ts_ns", "gap", "total"])

    return gaps, last


@pytest.mark.parametrize("size", [1, 7, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_a_fold_over_pieces_equals_a_loop(spark, size, keys):
    random.seed(5)
    gaps, last = folds()
    rows = [(random.choice([1, None, (1 << 53) + 1]) if keys else 1, random.randrange(500), i, random.choice([None, (1 << 53) + 1, 3]), "extra") for i in range(200)]
    want, ends = [], {}
    for k in {r[0] for r in rows}:
        before, total = None, 0
        for _, t, _, x, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            total += x or 0
            want.append((*([k] if keys else []), t, None if before is None else t - before, total))
            before = t
        ends[k] = (*([k] if keys else []), before, -1, total)
    table = spark.createDataFrame(rows, "k long, ts_ns long, seq long, x long, state string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = udf.stream_fold(gaps, "ts_ns long, gap long, total long", ["x"], last)(table, keys)
        assert sorted(map(tuple, found.collect()), key=str) == sorted([*want, *ends.values()], key=str)
        assert udf.stream_fold(gaps, "ts_ns long, gap long, total long")(table.limit(0), keys).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
