"""Capture files and growing captures as Python data sources.

``spark.read.format("pulse_dsl")`` and ``"pulse_sr"`` give the blocks of archives below ``path``. Filters on ``channel`` and ``start_pos`` and the option
``max_samples`` decide which entries are read at all: a partition is a run of entries that pass them.
``spark.readStream.format("pulse_blocks")`` follows a folder to which a recorder adds Parquet files of blocks, in any order; its offset is the committed prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from ..functions.formats import step_of
from ..schema import BLOCKS, StreamError
from . import blocks as blk

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ARROW = pa.schema([("capture_id", pa.string()), ("channel", pa.int32()), ("block", pa.int64()), ("start_pos", pa.int64()), ("n", pa.int32()), ("step_ns", pa.int64()), ("data", pa.binary())])
TESTS = {
    "EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "GreaterThan": lambda x, v: x > v, "GreaterThanOrEqual": lambda x, v: x >= v,
    "LessThan": lambda x, v: x < v, "LessThanOrEqual": lambda x, v: x <= v,
}


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let filters be pushed into them."""
    spark.conf.set(PUSHDOWN, "true")
    for source in (DslSource, SessionSource, BlockFollower):
        spark.dataSource.register(source)


def files_below(path: str) -> list[str]:
    """URIs of the files at or below a path of any file system that pyarrow reads."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    host = path.split("://")[1].split("/")[0] if "://" in path and scheme not in ("file://", "s3://", "gs://") else ""
    names = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return [f"{scheme}{host}{name}" for name in names]


@dataclass
class Run(ds.InputPartition):
    """Entries of one archive that a task reads: (name, channel, block, start_pos, n)."""

    uri: str
    step_ns: int
    probes: int
    unit: int
    entries: list[tuple]


class CaptureReader(ds.DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        if "path" not in options:
            raise StreamError("a capture is read from a path")
        self.kind, self.path = kind, options["path"]
        self.most = int(options["max_samples"]) if "max_samples" in options else None
        self.tests: list[tuple[str, Any, Any]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Comparisons of channel and start_pos are met exactly here; others go back to Spark."""
        for f in filters:
            test, column = TESTS.get(type(f).__name__), getattr(f, "attribute", ())
            if test is not None and column in (("channel",), ("start_pos",)):
                self.tests.append((column[0], test, f.value))
            else:
                yield f

    def passes(self, column: str, value: int) -> bool:
        return all(test(value, v) for name, test, v in self.tests if name == column)

    def partitions(self) -> list[Run]:
        out = []
        for uri in files_below(self.path):
            with blk.open_archive(uri) as held:
                head, entries = blk.ENTRIES[self.kind](held)
            kept = [e for e in entries if (self.most is None or e[3] < self.most) and self.passes("start_pos", e[3]) and (e[1] < 0 or self.passes("channel", e[1]))]
            fixed = (step_of(head["samplerate_hz"]), head["total_probes"], head["unit"])
            out += [Run(uri, *fixed, kept[i : i + blk.RUN_ENTRIES]) for i in range(0, len(kept), blk.RUN_ENTRIES)]
        return out or [Run("", 0, 0, 0, [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.entries:
            return
        with blk.open_archive(partition.uri) as held:
            for name, channel, block, start, n in partition.entries:
                entry = {"capture_id": partition.uri, "name": name, "channel": channel, "block": block, "start_pos": start, "n": n, "step_ns": partition.step_ns, "probes": partition.probes, "unit": partition.unit}
                rows = [r for r in blk.entry_blocks(held, entry, lambda c: self.passes("channel", c))]
                if self.most is not None:
                    rows = [(*r[:4], min(r[4], self.most - start), *r[5:]) for r in rows]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class DslSource(ds.DataSource):
    """Blocks of .dsl archives."""

    @classmethod
    def name(cls) -> str:
        return "pulse_dsl"

    def schema(self) -> Any:
        return BLOCKS

    def reader(self, schema: Any) -> CaptureReader:
        return CaptureReader("dsl", dict(self.options))


class SessionSource(DslSource):
    """Blocks of .sr session archives."""

    @classmethod
    def name(cls) -> str:
        return "pulse_sr"

    def reader(self, schema: Any) -> CaptureReader:
        return CaptureReader("sr", dict(self.options))


@dataclass
class Stretch(ds.InputPartition):
    """A block file and the positions [first, end) of it that belong to a batch."""

    uri: str
    first: int
    end: int


class FollowReader(ds.DataSourceStreamReader):
    """Blocks of a growing capture up to its committed prefix: the position that the blocks of every channel reach from 0 without a hole.

    A block belongs to the batch in which the prefix passes its start, whatever file brought it and when, so that batches are stretches of
    positions and a restart repeats them exactly. Only file footers and three number columns are read to find the prefix; files that are still being written are taken up later.
    """

    def __init__(self, options: dict[str, str]):
        if "path" not in options or "channels" not in options:
            raise StreamError("a growing capture needs its path and its number of channels")
        self.path, self.channels = options["path"], int(options["channels"])
        self.seen: dict[str, tuple[int, int]] = {}
        self.waiting: list[dict[int, int]] = [{} for _ in range(self.channels)]
        self.reached = [0] * self.channels

    def look(self) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for uri in files_below(self.path):
            if uri in self.seen:
                continue
            store, at = fs.FileSystem.from_uri(uri)
            try:
                held = pq.read_table(store.open_input_file(at), columns=["channel", "start_pos", "n"])
            except (pa.ArrowInvalid, OSError):
                continue
            starts = held["start_pos"].to_pylist()
            self.seen[uri] = (min(starts, default=0), max(starts, default=-1))
            for channel, start, n in zip(held["channel"].to_pylist(), starts, held["n"].to_pylist(), strict=True):
                self.waiting[channel][start] = n
        for channel, blocks in enumerate(self.waiting):
            while self.reached[channel] in blocks:
                self.reached[channel] += blocks.pop(self.reached[channel])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.look()
        return {"position": min(self.reached)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.look()
        a, b = start["position"], end["position"]
        return [Stretch(uri, a, b) for uri, (low, high) in self.seen.items() if low < b and high >= a]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(partition.uri)
        for batch in pq.ParquetFile(store.open_input_file(at)).iter_batches(batch_size=64, columns=ARROW.names):
            start = batch.column(ARROW.names.index("start_pos"))
            rows = pa.Table.from_batches([batch]).filter(pc.and_(pc.greater_equal(start, partition.first), pc.less(start, partition.end))).cast(ARROW)
            yield from rows.to_batches()

    def commit(self, end: dict) -> None:
        pass


class BlockFollower(DslSource):
    """Committed blocks of a growing capture as a stream."""

    @classmethod
    def name(cls) -> str:
        return "pulse_blocks"

    def streamReader(self, schema: Any) -> FollowReader:  # noqa: N802
        return FollowReader(dict(self.options))


def raw_position(offset: str | dict) -> int:
    """The raw sample position that an offset of ``pulse_blocks``, as a query's progress tells it, stands for: all samples before it are in."""
    return int(offset["position"] if isinstance(offset, dict) else re.search(r"position\D+(\d+)", offset)[1])
