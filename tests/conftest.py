from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(folder / "local"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stream(spark):
    """Build a stream from rows (ts_ns, value...) with seq by position, key k = 1."""

    def build(rows, *names, kinds="boolean"):
        columns = [f"{n} {kinds}" for n in names]
        data = [(1, r[0], i, *r[1:]) if isinstance(r, tuple) else (1, r, i) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, ", ".join(["k int", "ts_ns long", "seq long", *columns]))

    return build
