"""Bit-packed sample blocks: reading capture files, bits and buses, and level streams from blocks."""

from __future__ import annotations

import configparser
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import step_of
from ..operators.timeline import same_parts
from ..schema import BLOCKS, CAPTURES, SEQ, TS, StreamError
from .packed import bits_before

UNITS = {"GHz": 1e9, "MHz": 1e6, "KHz": 1e3, "kHz": 1e3, "Hz": 1.0}


def samplerate_hz(text: str) -> float:
    """``50 MHz`` and the like; a bare number is Hz."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2] and m[2] not in UNITS:
        raise StreamError(f"not a sample rate: {text}")
    return float(m[1]) * UNITS.get(m[2], 1.0)


def dsl_header(text: str) -> dict:
    """Fields of a .dsl header: ``name = value`` lines."""
    fields = dict(re.findall(r"^\s*([^=\[\n]+?)\s*=\s*(.*?)\s*$", text, re.M))
    for name in ("total probes", "samplerate", "total samples", "total blocks"):
        if name not in fields:
            raise StreamError(f"the header has no field {name}")
    probes = int(fields["total probes"])
    return {
        "total_probes": probes,
        "samplerate": fields["samplerate"],
        "samplerate_hz": samplerate_hz(fields["samplerate"]),
        "total_samples": int(fields["total samples"]),
        "total_blocks": int(fields["total blocks"]),
        "trigger_sample": int(fields["trigger sample"]) if fields.get("trigger sample") else None,
        "probe_names": [fields.get(f"probe{i}") or f"Probe{i}" for i in range(probes)],
    }


def dsl_entries(held: zipfile.ZipFile) -> tuple[dict, list[tuple]]:
    """Header fields and the entries (name, channel, block, start_pos, n) of a .dsl archive; ``L-{channel}/{block}`` hold packed samples."""
    head = dsl_header(held.read("header").decode())
    per_block = held.getinfo("L-0/0").file_size * 8 if head["total_blocks"] else 0
    entries = []
    for channel in range(head["total_probes"]):
        for block in range(head["total_blocks"]):
            name, start = f"L-{channel}/{block}", block * per_block
            entries.append((name, channel, block, start, min(held.getinfo(name).file_size * 8, head["total_samples"] - start)))
    return head | {"samples_per_block": per_block, "unit": 0}, entries


def sr_entries(held: zipfile.ZipFile) -> tuple[dict, list[tuple]]:
    """The same of a .sr session (version 1 or 2), whose entries hold interleaved samples of all channels (channel -1)."""
    if held.read("version").decode().strip() not in ("1", "2"):
        raise StreamError("unknown session version")
    ini = configparser.ConfigParser()
    ini.read_string(held.read("metadata").decode())
    device = next((ini[s] for s in ini.sections() if s.startswith("device") and "capturefile" in ini[s]), None)
    if device is None:
        raise StreamError("no device with a capture file")
    unit, probes = int(device["unitsize"]), int(device["total probes"])
    if not 1 <= probes <= 8 * unit:
        raise StreamError(f"{probes} probes don't fit samples of {unit} bytes")
    stem = device["capturefile"]
    names = [n for n in held.namelist() if n == stem or re.fullmatch(re.escape(stem) + r"-\d+", n)]
    names.sort(key=lambda n: 0 if n == stem else int(n.rsplit("-", 1)[1]))
    sizes = [held.getinfo(n).file_size for n in names]
    if any(s % unit for s in sizes):
        raise StreamError("a data entry is not a whole number of samples")
    starts = np.cumsum([0, *sizes]) // unit
    head = {
        "total_probes": probes, "samplerate": device["samplerate"], "samplerate_hz": samplerate_hz(device["samplerate"]), "total_samples": sum(sizes) // unit,
        "total_blocks": len(names), "samples_per_block": max(sizes, default=0) // unit, "trigger_sample": int(device["trigger sample"]) if device.get("trigger sample") else None,
        "probe_names": [device.get(f"probe{i + 1}") or f"Probe{i}" for i in range(probes)], "unit": unit,
    }
    return head, [(name, -1, block, int(starts[block]), size // unit) for block, (name, size) in enumerate(zip(names, sizes, strict=True))]


ENTRIES = {"dsl": dsl_entries, "sr": sr_entries}
ENTRY = "capture_id string, run int, name string, channel int, block long, start_pos long, n long, step_ns long, probes int, unit int"
#: Entries of one archive that a task reads, and bytes of a batch of blocks that it hands on.
RUN_ENTRIES = 64
BATCH_BYTES = 8_000_000
#: Level rows of a batch, at least, before it is handed on.
RUN_ROWS = 100_000


def open_archive(uri: str) -> zipfile.ZipFile:
    """An archive by its URI (local, HDFS or an object store); only what is asked for is read from it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(pa.PythonFile(store.open_input_file(path), mode="r"))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """URIs of the files below a path; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))


def archive_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row for each data entry of the capture files below a path, from the archives' directories alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("capture_id", pa.string()), ("run", pa.int32()), ("name", pa.string()), ("channel", pa.int32()), ("block", pa.int64()), ("start_pos", pa.int64()), ("n", pa.int64()), ("step_ns", pa.int64()), ("probes", pa.int32()), ("unit", pa.int32())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_archive(uri) as held:
                    head, entries = ENTRIES[kind](held)
                fixed = (step_of(head["samplerate_hz"]), head["total_probes"], head["unit"])
                rows = [(uri, i // RUN_ENTRIES, *x, *fixed) for i, x in enumerate(entries)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return _archives(spark, path).mapInArrow(read, ENTRY)


def entry_blocks(held: zipfile.ZipFile, entry: dict, wanted: Callable[[int], bool] = lambda channel: True) -> Iterator[tuple]:
    """The blocks of one entry, a row for each wanted channel in it."""
    data = held.read(entry["name"])
    place = (entry["block"], entry["start_pos"], entry["n"], entry["step_ns"])
    if entry["channel"] >= 0:
        yield entry["capture_id"], entry["channel"], *place, data
        return
    samples = np.frombuffer(data, np.uint8).reshape(-1, entry["unit"])
    for c in filter(wanted, range(entry["probes"])):
        yield entry["capture_id"], c, *place, np.packbits(samples[:, c // 8] >> (c % 8) & 1, bitorder="little").tobytes()


def capture_blocks(spark: SparkSession, path: str, kind: str, max_samples: int | None = None) -> DataFrame:
    """The blocks of capture files below a path, ``kind`` dsl or sr.

    Archives are listed first and their entries dealt in runs of RUN_ENTRIES, so that many tasks read one archive of any
    size, each only its own entries; with ``max_samples`` entries that begin later are not read.
    """
    names = BLOCKS.fieldNames()
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows, size = None, None, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for entry in batch.to_pylist():
                if entry["capture_id"] != at:
                    if held is not None:
                        held.close()
                    at, held = entry["capture_id"], open_archive(entry["capture_id"])
                for row in entry_blocks(held, entry):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= BATCH_BYTES:
                        yield pack()
                        rows, size = [], 0
        if held is not None:
            held.close()
        if rows:
            yield pack()

    entries = archive_entries(spark, path, kind)
    if max_samples is not None:
        entries = entries.where(F.col("start_pos") < max_samples)
    return entries.repartition("capture_id", "run").sortWithinPartitions("capture_id", "channel", "block").mapInArrow(read, BLOCKS)


def captures(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One metadata row for each capture file, from its header and directory."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"total_probes": pa.int32(), "samplerate": pa.string(), "capture_id": pa.string(), "samplerate_hz": pa.float64(), "probe_names": pa.list_(pa.string())}
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_archive(uri) as held:
                    head = ENTRIES[kind](held)[0] | {"capture_id": uri}
                yield pa.RecordBatch.from_arrays([pa.array([head[n]], types.get(n, pa.int64())) for n in CAPTURES.fieldNames()], names=CAPTURES.fieldNames())

    return _archives(spark, path).mapInArrow(read, CAPTURES)


def capture_summary(captures: DataFrame) -> DataFrame:
    """Captures with their duration in microseconds."""
    return captures.withColumn("duration_us", F.col("total_samples") * 1e6 / F.col("samplerate_hz"))


def pack_levels(samples: DataFrame, keys: Sequence[str], position: str, bit: str, step_ns: int, per_block: int = 4096) -> DataFrame:
    """Blocks (keys, block, start_pos, n, step_ns, data) of samples numbered from 0 without gaps; bit i of byte i / 8 from the low end."""
    rows = samples.withColumns({"block": F.floor(F.col(position) / per_block), "_byte": F.floor(F.col(position) % per_block / 8), "_bit": F.col(position) % 8})
    value = F.sum(F.when(F.col(bit), F.pow(F.lit(2.0), F.col("_bit")).cast("int")).otherwise(0)).cast("int")
    bytes_ = rows.groupBy(*keys, "block", "_byte").agg(value.alias("_v"), F.count(F.lit(1)).alias("_n"))
    listed = F.sort_array(F.collect_list(F.struct("_byte", "_v")))
    packed = bytes_.groupBy(*keys, "block").agg(listed.alias("_l"), F.sum("_n").cast("int").alias("n"))
    text = F.concat_ws("", F.transform("_l", lambda x: F.lpad(F.hex(x["_v"]), 2, "0")))
    return packed.select(*keys, "block", (F.col("block") * per_block).alias("start_pos"), "n", F.lit(step_ns).cast("long").alias("step_ns"), F.unhex(text).alias("data"))


def block_levels(blocks: DataFrame, keys: Sequence[str], max_samples: int | None = None) -> DataFrame:
    """Level stream of packed blocks: a row at the start of each run, at position times step.

    Runs are found in each block by array operations, where the block lies; a block's first row is dropped if the block before ends
    with that value. That bit comes from a window over a few bytes of each block, joined back by start position: packed samples
    are not brought together by channel.
    """
    rows = blocks if max_samples is None else blocks.where(F.col("start_pos") < max_samples).withColumn("n", F.least("n", (F.lit(max_samples) - F.col("start_pos")).cast("int")))
    rows = rows.where("n > 0")
    known = same_parts(rows, bits_before(rows, keys, {"_before": "data"}), [*keys, "start_pos"], "left")
    held = known.select(*keys, "start_pos", "n", "step_ns", "data", "_before")
    schema = held.select(*keys).schema.add(TS, "long").add(SEQ, "long").add("value", "boolean")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            begin, found = 0, []
            starts, sizes, steps, lasts = (batch.column(k + j).to_pylist() for j in (0, 1, 2, 4))
            for i in range(batch.num_rows):
                bits = np.unpackbits(np.frombuffer(batch.column(k + 3)[i].as_buffer(), np.uint8), bitorder="little")[: sizes[i]]
                at = np.flatnonzero(np.diff(bits, prepend=bits[:1] ^ 1 if lasts[i] is None else lasts[i]))
                found.append(((starts[i] + at) * steps[i], starts[i] + at, bits[at].astype(bool)))
                if i == batch.num_rows - 1 or sum(len(x[0]) for x in found) >= RUN_ROWS:
                    own = np.repeat(np.arange(begin, i + 1), [len(x[0]) for x in found])
                    keyed = [batch.column(j).take(pa.array(own)) for j in range(k)]
                    yield pa.RecordBatch.from_arrays([*keyed, *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=[*keys, TS, SEQ, "value"])
                    begin, found = i + 1, []

    return held.mapInArrow(runs, schema)


def bit_at(data: Column, index: Column) -> Column:
    """Bit of a packed block; false beyond its end."""
    byte = F.conv(F.hex(F.substring(data, F.floor(index / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), index % 8)).cast("int") % 2
    return F.coalesce(F.when((index >= 0) & (index < F.length(data) * 8), bit == 1), F.lit(False))


def bus_at(blocks: DataFrame, keys: Sequence[str], position: int) -> DataFrame:
    """Integer of all channels' bits at one position; only the blocks that hold it are read."""
    own = blocks.where((F.col("start_pos") <= position) & (F.col("start_pos") + F.col("n") > position))
    bit = bit_at(F.col("data"), F.lit(position) - F.col("start_pos")).cast("int")
    return own.groupBy(*keys).agg(F.sum(bit * F.pow(F.lit(2.0), F.col("channel"))).cast("long").alias("value"))


def bus_at_probes(blocks: DataFrame, probes: DataFrame, keys: Sequence[str], per_block: int) -> DataFrame:
    """``probes(keys..., position)`` with the integer of all channels' bits there; blocks begin at multiples of ``per_block``."""
    at = probes.select(*keys, "position", F.call_function("div", F.col("position"), F.lit(per_block)).alias("block"))
    found = same_parts(blocks.select(*keys, "block", "channel", "start_pos", "data"), at, [*keys, "block"])
    bit = bit_at(F.col("data"), F.col("position") - F.col("start_pos")).cast("int")
    return found.groupBy(*keys, "position").agg(F.sum(bit * F.pow(F.lit(2.0), F.col("channel"))).cast("long").alias("value"))


def sub_blocks(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Byte-aligned views of [first, last) of each block's positions."""
    if first % 8:
        raise StreamError("a view starts at a whole byte")
    inside = blocks.where((F.col("start_pos") < last) & (F.col("start_pos") + F.col("n") > first))
    skip = F.greatest(F.lit(first) - F.col("start_pos"), F.lit(0).cast("long"))
    n = F.least(F.col("start_pos") + F.col("n"), F.lit(last)) - (F.col("start_pos") + skip)
    data = F.substring(F.col("data"), (F.floor(skip / 8) + 1).cast("int"), F.ceil(n / 8).cast("int"))
    return inside.withColumns({"data": data, "n": n.cast("int"), "start_pos": F.col("start_pos") + skip})
