"""Exports of packed blocks by the registered queries."""

from __future__ import annotations

from pulseframe.plans import file_queries as fq


def test_blocks_of_an_export_are_made_once(spark, monkeypatch):
    """An export reads its blocks several times, and each time from files, not from lineitem by the sorts and sums that make them."""
    seen = []
    for name in ("export_dsl", "export_session"):
        monkeypatch.setattr(fq.sinks, name, lambda packed, *more: seen.append(packed))
    for kind in ("dsl", "sr"):
        fq.written(spark, "/root/testdata/sf0.001", kind)
    assert len(seen) == 2
    for packed in seen:
        plan = packed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and packed.count()
