from __future__ import annotations

import random

import numpy as np
import pytest

from pulseframe.operators import trigger
from pulseframe.operators.stages import START, Counted, advance, apply_map, completions, piece_maps

STAGES = [Counted(3, False), Counted(2, True), Counted(1, False), Counted(5, False), Counted(4, True)]


def by_loop(stages, rows):
    """Time at which ``rows`` (time, mask) complete the stages, row by row; None if they don't."""
    k, count, last = 0, 0, False
    for t, mask in rows:
        hit = bool(mask >> k & 1)
        if stages[k].adjacent:
            count = count + 1 if hit else 0
        else:
            count += hit and not last
        last = hit
        if count >= stages[k].count:
            k, count, last = k + 1, 0, False
            if k == len(stages):
                return t
    return None


@pytest.mark.parametrize("size", [1, 2, 7, 50, 400])
@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_maps_and_passes_equal_a_loop(size, share):
    rng = np.random.default_rng(size)
    for _ in range(25):
        order = rng.permutation(len(STAGES))[: rng.integers(1, 6)]
        stages = [STAGES[i] for i in order]
        n = int(rng.integers(1, 400))
        ts = np.cumsum(rng.integers(1, 9, n))
        masks = sum(((rng.random(n) < share).astype(np.int64) << k) for k in range(len(stages)))
        want = by_loop(stages, list(zip(ts.tolist(), masks.tolist(), strict=True)))
        by_pass = by_maps = START
        for a in range(0, n, size):
            piece = slice(a, a + size)
            maps = piece_maps(stages, ts[piece], masks[piece])
            assert all(len(x["upto"]) <= s.count + 1 for x, s in zip(maps, stages, strict=True))
            if by_maps[0] < len(stages):
                by_maps = apply_map(by_maps, stages[by_maps[0]], maps[by_maps[0]])
            if by_pass[0] < len(stages):
                by_pass = advance(by_pass, stages, ts[piece], masks[piece])
            assert by_maps[:2] == by_pass[:2]
        for state in (by_maps, by_pass):
            assert (state[3] if state[0] == len(stages) else None) == want


@pytest.mark.parametrize("bucket", [None, 1, 13, 400, 10**6])
def test_completions_of_any_width(spark, bucket):
    random.seed(4)
    rows, want = [], []
    for k in (1, 2, None, (1 << 53) + 1, 5):
        t, own = random.randrange(-500, 500), []
        for _ in range(random.choice([3, 300, 900])):
            t += random.randrange(1, 7)
            own.append((t, random.randrange(32)))
        rows += [(k, *x, "more") for x in own]
        found = by_loop(STAGES, own)
        want += [] if found is None else [(k, found)]
    random.shuffle(rows)
    table = spark.createDataFrame(rows, "k long, ts_ns long, _m int, _at string")
    assert sorted(map(tuple, completions(table, ["k"], STAGES, bucket).collect()), key=str) == sorted(want, key=str)
    assert want and completions(table.limit(0), ["k"], STAGES, bucket).count() == 0
    one = completions(table.where("k = 1"), [], STAGES[:1], bucket).collect()
    assert [r["trigger_ns"] for r in one] == [by_loop(STAGES[:1], sorted((r[1], r[2]) for r in rows if r[0] == 1))]


def test_one_sort_for_any_number_of_stages(spark):
    rows = spark.range(10).selectExpr("1 AS k", "id AS ts_ns", "id % 2 = 0 AS v0", "id % 2 = 1 AS b0")
    sorts = []
    for n in (1, 16):
        program = trigger.Program([trigger.Stage({0: "high"}) for _ in range(n)])
        found = trigger.find_trigger(rows, ["k"], program, 1)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sorts.append(plan.count("Sort ") + plan.count("Repartition"))
        assert [r["trigger_ns"] for r in found.collect()] == ([0] if n == 1 else [])
    assert sorts[0] == sorts[1]
