"""File sinks: words and texts routed to the files that a text level names."""

from __future__ import annotations

import shutil
import struct
import tempfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import hex_text, little_endian
from ..functions.unsigned import decimal_text, floor_div
from ..operators.timeline import along, as_of, before, count, number_within, total
from ..schema import SEQ, TS, StreamError
from ..shared import shared_path

WIDTHS = {"u8": 1, "u16le": 2, "u32le": 4}
CHUNK = 4_000_000
#: Entries of an archive that a task holds compressed.
ENTRIES_HELD = 64


def routed(words: DataFrame, names: DataFrame | None, keys: Sequence[str], static: str | None = None, bucket_ns: int | None = None) -> DataFrame:
    """Words with ``filename`` and ``window``, the number of the name change they follow; a change at a word's time comes first."""
    if names is None:
        if static is None:
            raise StreamError("a file name or a stream of names is needed")
        return words.withColumns({"filename": F.lit(static), "window": F.lit(0).cast("long")})
    numbered = along(names, keys, {"_w": count()}, bucket_ns=bucket_ns)
    found = as_of(words, numbered, keys, {"value": "filename", "_w": "window"}, bucket_ns=bucket_ns)
    return found.withColumns({"filename": F.coalesce("filename", F.lit(static)), "window": F.coalesce("window", F.lit(0).cast("long"))}).where("filename is not null")


def in_window(rows: DataFrame, keys: Sequence[str], out: str, counted: Column | None = None, bucket_ns: int | None = None) -> DataFrame:
    """``rows`` with their number in their file window from 0, or with the sum of ``counted`` over the rows before."""
    rows = along(rows, keys, {"_before": before("window")}, bucket_ns=bucket_ns)
    return number_within(rows, keys, ~F.col("window").eqNullSafe(F.col("_before")), out, (), bucket_ns, counted).drop("_before")


def word_bytes(words: DataFrame, width: str = "u8") -> Column:
    """A word's bytes: the payload in full if it has one, else the value in the given width."""
    out = little_endian(F.col("value"), WIDTHS[width])
    if "payload_text" in words.columns:
        out = F.coalesce(F.encode("payload_text", "utf-8"), out)
    return F.coalesce("payload_bytes", out) if "payload_bytes" in words.columns else out


def capture_index(routed_words: DataFrame, keys: Sequence[str], width: str = "u8", bucket_ns: int | None = None) -> DataFrame:
    """One row per file: file_num, filename, bytes, start, end and duration in µs with 6 decimals, first and last word position."""
    rows = routed_words.withColumn("_bytes", F.length(word_bytes(routed_words, width)))
    rows = along(rows, keys, {"_n": count()}, bucket_ns=bucket_ns).withColumn("_pos", F.col("_n") - 1)
    files = rows.groupBy(*keys, "window", "filename").agg(
        F.sum("_bytes").alias("bytes"), F.min(TS).alias("_start"), F.max(TS).alias("_end"), F.min("_pos").cast("long").alias("start_pos"), F.max("_pos").cast("long").alias("end_pos")
    )
    us = lambda x: F.format_string("%d.%03d000", floor_div(x, 1000), F.pmod(x, F.lit(1000)))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("window")).cast("long")
    return files.select(
        *keys, number.alias("file_num"), "filename", "bytes", us(F.col("_start")).alias("start_time_us"), us(F.col("_end")).alias("end_time_us"),
        us(F.col("_end") - F.col("_start")).alias("duration_us"), "start_pos", "end_pos",
    )


def csv_lines(
    routed_words: DataFrame, keys: Sequence[str], hexadecimal: bool = False, digits: int = 2, header: str | None = None, bucket_ns: int | None = None
) -> DataFrame:
    """Lines ``row_id,timestamp_ns,value`` of each file: decimal or hex numbers, hex bytes, quoted text.

    ``header`` is given as it is before the first line of each file, with row_id -1.
    """
    rows = in_window(routed_words, keys, "row_id", bucket_ns=bucket_ns)
    value = hex_text(F.col("value"), digits) if hexadecimal else decimal_text(F.col("value"))
    if "payload_text" in routed_words.columns:
        value = F.coalesce(F.concat(F.lit('"'), F.replace(F.col("payload_text"), F.lit('"'), F.lit('""')), F.lit('"')), value)
    if "payload_bytes" in routed_words.columns:
        value = F.coalesce(F.hex("payload_bytes"), value)
    line = F.concat_ws(",", F.col("row_id").cast("string"), F.col(TS).cast("string"), value)
    lines = rows.select(*keys, "window", "filename", TS, SEQ, F.col("row_id").cast("long").alias("row_id"), line.alias("line"))
    if header is None:
        return lines
    first = lines.where("row_id = 0").withColumns({SEQ: F.col(SEQ) - 1, "row_id": F.lit(-1).cast("long"), "line": F.lit(header)})
    return first.unionByName(lines)


def line_clock_records(words: DataFrame, names: DataFrame, clock: DataFrame, keys: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """One row for each clock cycle of a file window, from one rising edge to the next.

    Word indexes count from 0 in the window, which opens at its first word; an edge belongs to the window of the
    first word at or after it and counts unless that word is the window's first. Columns: window, filename, cycle,
    rise_word and rise_ns (index at the edge, time of the edge), fall_word and fall_ns, then index and time of the
    first word after each, given only if that index is below the next rising edge's. What is missing is 0.
    """
    own = in_window(routed(words, names, keys, bucket_ns=bucket_ns), keys, "_i", bucket_ns=bucket_ns).withColumn("_at", F.col(TS))
    edges = along(clock, keys, {"_before": before("value")}, bucket_ns=bucket_ns).where(F.coalesce(F.col("value") != F.col("_before"), F.lit(False)))
    found = as_of(edges, own, keys, {"window": "window", "filename": "filename", "_i": "_word", "_at": "_word_ns"}, forward=True, inclusive=True, bucket_ns=bucket_ns)
    rows = found.where(F.col("_word") > 0)
    rows = in_window(rows, keys, "_rises", F.col("value"), bucket_ns).withColumn("cycle", F.col("_rises") + F.col("value").cast("long"))
    pick = lambda side, c: F.min(F.when(side, F.col(c)))
    up, down = F.col("value"), ~F.col("value")
    cycles = rows.where("cycle > 0").groupBy(*keys, "window", "filename", "cycle").agg(
        pick(up, "_word").alias("rise_word"), pick(up, TS).alias("rise_ns"), pick(down, "_word").alias("fall_word"), pick(down, TS).alias("fall_ns"),
        pick(up, "_word_ns").alias("_rise_at"), pick(down, "_word_ns").alias("_fall_at"),
    )
    cycles = cycles.withColumn("_next", F.lead("rise_word").over(Window.partitionBy(*keys, "window").orderBy("cycle")))
    kept = lambda word, c: F.coalesce(F.when(F.col("_next").isNull() | (F.col(word) < F.col("_next")), F.col(c)), F.lit(0).cast("long"))
    plain = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return cycles.select(
        *keys, "window", "filename", "cycle", plain("rise_word"), plain("rise_ns"), plain("fall_word"), plain("fall_ns"),
        kept("rise_word", "rise_word").alias("rise_after_word"), kept("rise_word", "_rise_at").alias("rise_after_ns"),
        kept("fall_word", "fall_word").alias("fall_after_word"), kept("fall_word", "_fall_at").alias("fall_after_ns"),
    )


def file_chunks(rows: DataFrame, keys: Sequence[str], content: Column, chunk_bytes: int = CHUNK, bucket_ns: int | None = None) -> DataFrame:
    """Contents in order as (keys, window, filename, chunk, data), cut into pieces of bounded size."""
    sized = in_window(rows.withColumn("_content", content), keys, "_before_it", F.length("_content"), bucket_ns)
    dealt = sized.withColumn("chunk", F.floor(F.col("_before_it") / chunk_bytes))
    parts = dealt.groupBy(*keys, "window", "filename", "chunk").agg(F.sort_array(F.collect_list(F.struct(TS, SEQ, "_content"))).alias("_l"))
    text = F.concat_ws("", F.transform("_l", lambda x: F.hex(x["_content"])))
    return parts.select(*keys, "window", "filename", "chunk", F.unhex(text).alias("data"))


def write_files(chunks: DataFrame, folder: str, keys: Sequence[str] = ()) -> None:
    """Write chunks to files below a folder that all executors share (a local, NFS, HDFS or object-store URI).

    A file is written by one task to a name of its attempt and then renamed, so that a task that runs again replaces
    it and two attempts at once don't write into each other's.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        suffix = f".partial-{TaskContext.get().taskAttemptId()}"
        out, name = None, None
        k = len(keys)
        for batch in batches:
            for i in range(batch.num_rows):
                own = "/".join([base, *(str(batch.column(j)[i].as_py()) for j in range(k)), batch.column(k + 1)[i].as_py()])
                if own != name:
                    if out is not None:
                        out.close()
                        store.move(f"{name}{suffix}", name)
                    store.create_dir(own.rsplit("/", 1)[0], recursive=True)
                    out, name = store.open_output_stream(f"{own}{suffix}"), own
                out.write(batch.column(k + 3)[i].as_py())
        if out is not None:
            out.close()
            store.move(f"{name}{suffix}", name)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["files"])

    ordered_rows = chunks.repartition(*keys, "filename").sortWithinPartitions(*keys, "filename", "window", "chunk")
    ordered_rows.select(*keys, "window", "filename", "chunk", "data").mapInArrow(write, "files long").count()


def lane_group(keys: Sequence[str], groups: int) -> Column:
    """The folder, of so many, of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int") if keys else F.lit(0)


def write_lanes(rows: DataFrame, folder: str, keys: Sequence[str], bucket_ns: int, groups: int = 64) -> None:
    """Retained lanes as Parquet below ``folder`` by time bucket and group of keys, sorted by key and time within a file.

    There are at most ``groups`` folders for each bucket, however many keys; a read of a span prunes folders, one of a key files' row groups as well.
    """
    dealt = rows.withColumns({"ts_bucket": floor_div(F.col(TS), bucket_ns), "key_group": lane_group(keys, groups)})
    dealt.repartition("ts_bucket", "key_group").sortWithinPartitions("ts_bucket", "key_group", *keys, TS, SEQ).write.partitionBy("ts_bucket", "key_group").parquet(folder)


def read_lanes(spark: SparkSession, folder: str, start_ns: int, end_ns: int, bucket_ns: int, key: dict | None = None, groups: int = 64) -> DataFrame:
    """The rows of [start, end) of lanes that :func:`write_lanes` wrote, of one ``key`` (name: value) if given; other buckets and groups are not read."""
    rows = spark.read.parquet(folder).where(F.col("ts_bucket").between(start_ns // bucket_ns, (end_ns - 1) // bucket_ns))
    if key is not None:
        held = spark.range(1).select(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in key.items())).select(lane_group(list(key), groups)).first()[0]
        rows = rows.where(F.col("key_group") == held)
        for k, v in key.items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
    return rows.where((F.col(TS) >= start_ns) & (F.col(TS) < end_ns)).drop("ts_bucket", "key_group")


def session_metadata(names: Sequence[str], samplerate_hz: int, trigger_sample: int | None = None) -> str:
    """The metadata entry of a version 2 session."""
    for name in names:
        if "\r" in name or "\n" in name:
            raise StreamError(f"channel name {name!r} contains a line break")
    lines = ["[global]", "sigrok version=dsl", "[device 1]", "capturefile=logic-1", f"total probes={len(names)}", "total analog=0", f"samplerate={samplerate_hz} Hz", f"unitsize={-(-len(names) // 8)}"]
    lines += [] if trigger_sample is None else [f"trigger sample={trigger_sample}"]
    return "\n".join(lines + [f"probe{i + 1}={name}" for i, name in enumerate(names)]) + "\n"


def check_capture(blocks: DataFrame, channels: int, trigger_sample: int | None = None) -> int:
    """Total samples of a capture's ``blocks(channel, start_pos, n)``; raises unless they are whole: every range in all channels, without gaps."""
    ranges = blocks.groupBy("start_pos").agg(F.count_distinct("channel").alias("c"), F.min("channel").alias("low"), F.max("channel").alias("high"), F.min("n").alias("n"), F.max("n").alias("m"))
    bad = (F.col("c") != channels) | (F.col("low") != 0) | (F.col("high") != channels - 1) | (F.col("n") != F.col("m"))
    samples, end, uneven = ranges.agg(F.sum("n"), F.max(F.col("start_pos") + F.col("n")), F.count_if(bad)).first()
    if not samples:
        raise StreamError("the capture is empty")
    if uneven:
        raise StreamError(f"{uneven} ranges don't hold the same samples of {channels} channels")
    if samples != end:
        raise StreamError(f"the blocks hold {samples} of {end} samples")
    if trigger_sample is not None and trigger_sample >= samples:
        raise StreamError(f"trigger sample {trigger_sample} is outside of the {samples} samples")
    return samples


def zip_entries(entries: DataFrame) -> DataFrame:
    """``entries(entry, name, data)`` compressed where they lie: entry, data (with the local header), size, and ``central``, the directory's record but for the offset."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ENTRIES_HELD) for whole in batches for i in range(0, max(whole.num_rows, 1), ENTRIES_HELD)):
            rows = [zip_entry(name, data) for name, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            own, central = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(central, pa.binary()), pa.array(map(len, own), pa.int64())], names=["entry", "data", "central", "size"])

    return entries.select("entry", "name", "data").mapInArrow(pack, "entry long, data binary, central binary, size long")


def zip_entry(name: str, data: bytes) -> tuple[bytes, bytes]:
    """Local header and data of a deflated entry, and its central record up to the offset."""
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeezer.compress(data) + squeezer.flush()
    same = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 0x21, zlib.crc32(data), len(body), len(data), len(name), 0)
    return b"PK\x03\x04" + same + name.encode() + body, b"PK\x01\x02\x14\x00" + same + struct.pack("<HHHI", 0, 0, 0, 0) + name.encode()


def export_session(blocks: DataFrame, path: str, names: Sequence[str], samplerate_hz: int, trigger_sample: int | None = None) -> int:
    """Write a version 2 session archive of one capture's ``blocks(channel, start_pos, n, data)``; gives its bytes."""
    metadata = session_metadata(names, samplerate_hz, trigger_sample)
    check_capture(blocks, len(names), trigger_sample)
    order = blocks.select(F.col("start_pos").alias(TS), F.lit(0).cast("long").alias(SEQ)).distinct()
    number = along(order, [], {"entry": count()}, bucket_ns=1 << 32).select(F.col(TS).alias("start_pos"), "entry")
    mixed = interleave(blocks, [], len(names)).join(number, "start_pos")
    return write_archive(mixed.select("entry", F.concat(F.lit("logic-1-"), F.col("entry").cast("string")).alias("name"), "data"), path, {"version": b"2", "metadata": metadata.encode()})


def export_dsl(blocks: DataFrame, path: str, names: Sequence[str], samplerate: str) -> int:
    """Write a .dsl archive of one capture's ``blocks(channel, block, start_pos, n, data)``; gives its bytes."""
    samples = check_capture(blocks, len(names))
    total_blocks = blocks.agg(F.max("block") + 1).first()[0]
    lines = ["[version]", "version = 2", "[header]", f"total probes = {len(names)}", f"samplerate = {samplerate}", f"total samples = {samples}", f"total blocks = {total_blocks}"]
    header = "\n".join(lines + [f"probe{i} = {name}" for i, name in enumerate(names)]) + "\n"
    entries = blocks.select((F.col("channel") * F.lit(total_blocks) + F.col("block")).cast("long").alias("entry"), F.format_string("L-%d/%d", "channel", "block").alias("name"), "data")
    return write_archive(entries, path, {"header": header.encode()})


def write_archive(entries: DataFrame, path: str, first: dict[str, bytes]) -> int:
    """Write ``entries(entry, name, data)`` as an archive in the order of ``entry`` (from 0 on), after the ``first`` ones; gives its bytes.

    Entries are compressed by many tasks and written to the shared folder; the last step copies them in order into the
    file, one at a time, and adds their directory. ``path`` is a local, NFS, HDFS or object-store URI.
    """
    spark = entries.sparkSession
    head = spark.createDataFrame([(i - len(first), name, data) for i, (name, data) in enumerate(first.items())], "entry long, name string, data binary")
    staged = shared_path(spark, "archive")
    zip_entries(head.unionByName(entries)).write.parquet(staged)
    rows = spark.read.parquet(staged)
    sized = rows.select(F.col("entry").alias(TS), F.lit(0).cast("long").alias(SEQ), "size")
    ends = along(sized, [], {"_end": total("size")}, bucket_ns=4096).select(F.col(TS).alias("entry"), (F.col("_end") - F.col("size")).alias("offset"))
    placed = rows.join(ends, "entry")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        partial = f"{base}.partial-{TaskContext.get().taskAttemptId()}"
        central, size = tempfile.TemporaryFile(), 0
        n = wide = 0
        with store.open_output_stream(partial) as out:
            for batch in batches:
                for data, record, offset in zip(*(batch.column(c) for c in ("data", "central", "offset")), strict=True):
                    out.write(data.as_buffer())
                    size, n = size + len(data.as_buffer()), n + 1
                    wide += central.write(central_record(record.as_py(), offset.as_py()))
            central.seek(0)
            shutil.copyfileobj(central, out, 1 << 20)
            tail = directory_end(n, wide, size)
            out.write(tail)
        store.move(partial, base)
        yield pa.RecordBatch.from_arrays([pa.array([size + wide + len(tail)])], names=["bytes"])

    return placed.select("entry", "data", "central", "offset").repartition(1).sortWithinPartitions("entry").mapInArrow(write, "bytes long").first()[0]


def central_record(record: bytes, offset: int) -> bytes:
    """The record with its offset, in the long form where that needs more than 32 bits."""
    head, name = record[:42], record[42:]
    if offset < 0xFFFFFFFF:
        return head + struct.pack("<I", offset) + name
    return head[:30] + struct.pack("<H", 12) + head[32:42] + struct.pack("<I", 0xFFFFFFFF) + name + struct.pack("<HHQ", 1, 8, offset)


def directory_end(n: int, size: int, offset: int) -> bytes:
    """What closes an archive of ``n`` entries whose directory of ``size`` bytes begins at ``offset``."""
    long = b""
    if n >= 0xFFFF or offset >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
        long = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, offset) + b"PK\x06\x07" + struct.pack("<IQI", 0, offset + size, 1)
    return long + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def interleave(blocks: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """Blocks of all channels of one position range as interleaved samples: keys, start_pos, n, data."""
    unit = -(-channels // 8)
    schema = blocks.select(*keys, "start_pos", "n", "data").schema

    def mix(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        out = np.zeros((n, unit), np.uint8)
        for c, data in zip(group.column("channel").to_pylist(), group.column("data").to_pylist(), strict=True):
            out[:, c // 8] |= np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n] << (c % 8)
        first = group.slice(0, 1)
        return pa.table({**{k: first.column(k) for k in (*keys, "start_pos", "n")}, "data": pa.array([out.tobytes()], pa.binary())})

    return blocks.select(*keys, "start_pos", "n", "channel", "data").groupBy(*keys, "start_pos").applyInArrow(mix, schema)
