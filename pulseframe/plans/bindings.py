"""The given tables as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import along, count
from ..sources.blocks import pack_levels
from ..streaming.ordered import stretch_bytes

KEYS = ["user_id"]
#: Start of the timelines: nothing in the event table is earlier.
T0 = 1_704_067_200_000_000_000
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
HOUR = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_micros(name: str) -> Column:
    """Microseconds from 1970 of a timestamp's wall-clock time, whatever the session's time zone."""
    second = f"CAST(extract(SECOND FROM {name}) * 1000000 AS BIGINT)"
    return F.expr(f"unix_date(CAST({name} AS DATE)) * 86400000000L + hour({name}) * 3600000000L + minute({name}) * 60000000L + {second}")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts_ns, seq, kind, number (hundredths of value) and duration_ns."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        (wall_micros("ts") * 1000).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
        F.floor(F.col("value") * 100).cast("long").alias("number"),
        (F.get_json_object("props", "$.k").cast("long") * 1_000_000).alias("duration_ns"),
    )


def level(spark: SparkSession, sf_dir: str, above: float = 35.0) -> DataFrame:
    """True while the user's latest value is above a bound."""
    return base(spark, sf_dir).select("user_id", "ts_ns", "seq", (F.col("amount") > above).alias("value"))


def kind_level(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return base(spark, sf_dir).select("user_id", "ts_ns", "seq", (F.col("kind") == kind).alias("value"))


def occurrences(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("kind") == kind).select("user_id", "ts_ns", "seq")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("user_id", "ts_ns", "seq", "duration_ns", F.col("number").alias("value"))


def row_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, out: str) -> DataFrame:
    """``rows`` numbered from 1 within ``keys`` in the order of some columns, the first of which, a LONG, divides the work among tasks."""
    first, *between, last = order if len(order) > 1 else [order[0], order[0]]
    placed = rows.withColumns({"ts_ns": F.col(first).cast("long"), "seq": F.col(last)})
    return along(placed, keys, {out: count()}, between, width).drop("ts_ns", "seq")


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in order, numbered by position within one channel for each line number, with one bit of the quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("channel"), *LINE_ORDER, (F.col("l_quantity").cast("long") % 2 == 1).alias("bit"))
    rows = row_numbers(rows, ["channel"], LINE_ORDER, 1 << 14, "n")
    return rows.select("channel", (F.col("n") - 1).alias("position"), "bit")


def bus_bits(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """lineitem in order as the samples of one bus: the low bits of the quantity, a channel each."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    rows = row_numbers(rows, [], [*LINE_ORDER, "l_linenumber"], 1 << 14, "n").select((F.col("n") - 1).alias("position"), "q")
    rows = rows.select("position", "q", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    return rows.select("channel", "position", (F.call_function("div", F.col("q"), F.pow(F.lit(2), F.col("channel")).cast("long")) % 2 == 1).alias("bit"))


def spi_lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """customer keys as 24-bit words on a serial bus, a transaction each, one bus for each nation."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    rows = row_numbers(rows, ["c_nationkey"], ["c_custkey"], 1 << 14, "n").withColumn("t", F.col("n") * 1000)
    bit = F.explode(F.sequence(F.lit(0), F.lit(23)))
    cells = rows.select("c_nationkey", "t", "c_custkey", bit.alias("k")).withColumn("at", F.col("t") + 20 + F.col("k") * 20)
    rise = F.array(F.struct((F.col("at") + 10).alias("ts_ns"), F.lit(True).alias("value")), F.struct((F.col("at") + 20).alias("ts_ns"), F.lit(False).alias("value")))
    select = F.array(F.struct(F.col("t").alias("ts_ns"), F.lit(False).alias("value")), F.struct((F.col("t") + 600).alias("ts_ns"), F.lit(True).alias("value")))
    high = F.expr("shiftright(c_custkey, 23 - k) & 1") == 1
    seq = F.col("ts_ns").alias("seq")
    idle = lambda df, v: df.select("c_nationkey").distinct().select("c_nationkey", F.lit(0).cast("long").alias("ts_ns"), F.lit(0).cast("long").alias("seq"), F.lit(v).alias("value"))
    return {
        "clock": idle(rows, False).unionByName(cells.select("c_nationkey", F.inline(rise)).select("c_nationkey", "ts_ns", seq, "value")),
        "cs": idle(rows, True).unionByName(rows.select("c_nationkey", F.inline(select)).select("c_nationkey", "ts_ns", seq, "value")),
        "mosi": cells.select("c_nationkey", F.col("at").alias("ts_ns"), F.col("at").alias("seq"), high.alias("value")),
        "miso": cells.select("c_nationkey", F.col("at").alias("ts_ns"), F.col("at").alias("seq"), (~high).alias("value")),
    }


def parallel_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """customer keys as three cycles on an 8-bit bus, low byte first: strobe, data lines, enable (off for every fifth customer)."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    rows = row_numbers(rows, ["c_nationkey"], ["c_custkey"], 1 << 14, "n").withColumn("t", F.col("n") * 100)
    cells = rows.select("c_nationkey", "c_custkey", "t", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("at", F.col("t") + F.col("k") * 20)
    pulse = F.array(F.struct((F.col("at") + 10).alias("ts_ns"), F.lit(True).alias("value")), F.struct((F.col("at") + 15).alias("ts_ns"), F.lit(False).alias("value")))
    strobe = cells.select("c_nationkey", F.inline(pulse)).select("c_nationkey", "ts_ns", F.col("ts_ns").alias("seq"), "value")
    byte = cells.withColumn("v", F.expr("shiftright(c_custkey, 8 * k) & 255"))
    data = [byte.select("c_nationkey", F.col("at").alias("ts_ns"), F.col("at").alias("seq"), (F.shiftright("v", i).bitwiseAND(F.lit(1)) == 1).alias("value")) for i in range(8)]
    enable = rows.select("c_nationkey", F.col("t").alias("ts_ns"), F.col("t").alias("seq"), (F.col("c_custkey") % 5 != 0).alias("value"))
    return strobe, data, enable


def packed_lines(rows: DataFrame, samples: int, bits: Sequence[Column], step_ns: int, per_block: int) -> DataFrame:
    """Packed blocks of the channels ``bits``, for each of ``rows(c_nationkey, n, ...)`` so many samples j in order of n."""
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("position", (F.col("n") - 1) * samples + F.col("j"))
    channel = F.posexplode(F.array(*bits)).alias("channel", "bit")
    return pack_levels(cells.select("c_nationkey", "position", channel), ["c_nationkey", "channel"], "position", "bit", step_ns, per_block)


def spi_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer keys on the serial bus of :func:`spi_lines` as packed samples of 10 ns; channels clock, cs, mosi, miso."""
    rows = row_numbers(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 1 << 14, "n")
    high = F.expr("shiftright(c_custkey, 23 - int(greatest(least((j - 2) div 2, 23), 0))) & 1") == 1
    clock = F.expr("j >= 3 and j < 51 and j % 2 = 1")
    return packed_lines(rows, 100, [clock, F.col("j") >= 60, high, ~high], 10, 4096)


def parallel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer keys on the bus of :func:`parallel_lines` as packed samples of 5 ns; channels 0 to 7 data, 8 strobe, 9 enable."""
    rows = row_numbers(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 1 << 14, "n")
    data = [F.expr(f"shiftright(c_custkey, 8 * int(least(j div 4, 2)) + {i}) & 1") == 1 for i in range(8)]
    return packed_lines(rows, 20, [*data, F.expr("j < 12 and j % 4 = 2"), F.expr("c_custkey % 5 <> 0")], 5, 1024)


#: Bytes of text that one task sends over a serial line.
LINE_BYTES = 1 << 18
#: Bytes of text whose level changes are one stretch.
STRETCH_BYTES = 1 << 14


def uart_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of each conversation turn as the level changes of an 8N1 line of 1 Mbaud, key (conv_id, turn).

    Texts are dealt out by key before they become lines, so that what reads a line by its key finds it in one place and no line travels.
    """
    rows = table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", F.encode(F.col("text"), "utf-8").alias("h"))
    size = rows.agg(F.sum(F.length("h"))).first()[0] or 0
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // LINE_BYTES)), "conv_id", "turn")
    byte = rows.select("conv_id", "turn", "h", F.explode(F.sequence(F.lit(0), F.expr("length(h) - 1"))).alias("i"))
    # start bit, data bits from the low end, stop bit
    frame = F.expr("int(conv(hex(substring(h, i + 1, 1)), 16, 10)) * 2 + 512")
    byte = byte.select("conv_id", "turn", F.col("i").cast("long").alias("i"), frame.alias("v"))
    cell = byte.select("conv_id", "turn", "i", "v", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    cell = cell.where("k = 0 or (shiftright(v, k) ^ shiftright(v, k - 1)) & 1 = 1")
    at = F.col("i") * 10_000 + F.col("k") * 1000 + 1000
    return cell.select("conv_id", "turn", at.alias("ts_ns"), at.alias("seq"), (F.expr("shiftright(v, k) & 1") == 1).alias("value"))


def uart_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`uart_line` as stretches (:func:`~pulseframe.streaming.ordered.stretch_bytes`) with their ends."""
    rows = table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", F.encode(F.col("text"), "utf-8").alias("h"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "conv_id", "turn")
    return rows.mapInArrow(_line_stretches(STRETCH_BYTES), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, is_end boolean, end_rows long, latest long, stretch binary")


def _line_stretches(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # of each byte the ten cells from start to stop bit, and those that differ from the one before (of a start bit: from a stop bit)
    cells = (np.arange(256)[:, None] * 2 + 512 >> np.arange(10) & 1).astype(bool)
    moves = np.append(np.ones((256, 1), bool), cells[:, 1:] != cells[:, :-1], 1)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            found: list[tuple] = []
            for i, text in enumerate(batch.column(2)):
                data, n = np.frombuffer(text.as_buffer(), np.uint8), 0
                for low in range(0, len(data), most):
                    own = data[low : low + most]
                    byte, k = np.nonzero(moves[own])
                    ts, n, ends = (low + byte) * 10_000 + k * 1000 + 1000, n + len(byte), low + most >= len(data)
                    of.append(i)
                    found.append((ends, n if ends else 0, int(ts[-1]), stretch_bytes({"ts_ns": ts, "seq": ts, "value": cells[own[byte], k]})))
                    if len(of) == 1024:
                        yield rows(batch, of, found)
                        of, found = [], []
            if of:
                yield rows(batch, of, found)

    def rows(batch: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(of)) for k in batch.columns[:2]), *own], names=["conv_id", "turn", "is_end", "end_rows", "latest", "stretch"])

    return stretches


def i2c_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """supplier rows as writes on a two-wire bus by nation: address from the key, then three data bytes of the key."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    rows = row_numbers(rows, ["s_nationkey"], ["s_suppkey"], 1 << 14, "n").withColumn("t", F.col("n") * 10_000)
    data = F.array(F.expr("(s_suppkey % 128) * 2"), F.expr("s_suppkey & 255"), F.expr("shiftright(s_suppkey, 8) & 255"), F.expr("shiftright(s_suppkey, 16) & 255"))
    cells = rows.select("s_nationkey", "t", F.posexplode(data).alias("b", "v")).select("s_nationkey", "t", "b", "v", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    at = F.col("t") + 200 + (F.col("b") * 9 + F.col("k")) * 100
    cells = cells.withColumn("at", at)
    bit = F.when(F.col("k") == 8, False).otherwise(F.expr("shiftright(v, int(7 - k)) & 1") == 1)
    clock = F.array(F.struct((F.col("at") + 40).alias("ts_ns"), F.lit(True).alias("value")), F.struct((F.col("at") + 80).alias("ts_ns"), F.lit(False).alias("value")))
    scl = cells.select("s_nationkey", F.inline(clock)).unionByName(
        rows.select("s_nationkey", F.inline(F.array(F.struct((F.col("t") + 150).alias("ts_ns"), F.lit(False).alias("value")), F.struct((F.col("t") + 4000).alias("ts_ns"), F.lit(True).alias("value")))))
    )
    ends = F.array(F.struct((F.col("t") + 100).alias("ts_ns"), F.lit(False).alias("value")), F.struct((F.col("t") + 3900).alias("ts_ns"), F.lit(False).alias("value")), F.struct((F.col("t") + 4100).alias("ts_ns"), F.lit(True).alias("value")))
    sda = cells.select("s_nationkey", F.col("at").alias("ts_ns"), bit.alias("value")).unionByName(rows.select("s_nationkey", F.inline(ends)))
    seq = F.col("ts_ns").alias("seq")
    return scl.select("s_nationkey", "ts_ns", seq, "value"), sda.select("s_nationkey", "ts_ns", seq, "value")
