"""Registered queries that write the given tables as capture files, lanes or streams and read them back, and those of user operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats, payload, udf
from ..operators import decode, levels, retrieval, tiers, trigger, words
from ..operators.timeline import settled
from ..sources import blocks, capture_source, file_commits, sinks
from ..shared import shared_path
from ..streaming import decoders as d
from ..streaming import ordered as o
from . import bindings as b
from .bindings import HOUR, KEYS, T0
from .queries import SPI_ROWS, SQL, THREE, W0, W1, WEEK, file_names, query, three_channels

BUS = """+ s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_linenumber) - 1 AS position, l_quantity::BIGINT AS q FROM lineitem),
x AS (SELECT position, q, c AS channel, (q >> c) & 1 = 1 AS bit FROM s CROSS JOIN (VALUES (0), (1), (2), (3)) v(c)),
y AS (SELECT *, lag(bit) OVER (PARTITION BY channel ORDER BY position) AS p FROM x)"""
RUNS = " SELECT channel, position * 10 AS ts_ns, position AS seq, bit AS value FROM y WHERE p IS NULL OR bit <> p"
DAY = 24 * HOUR
#: Milliseconds of a slot in which rows of a stream wait: a day holds a few rows of a user.
DAY_MS = 86_400_000
NAMES = ["low", "next", "third", "top"]


def bus_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bus of lineitem as packed blocks, made once and stored: an export reads them several times."""
    return settled(blocks.pack_levels(b.bus_bits(spark, sf_dir), ["channel"], "position", "bit", 10, 8192))


def written(spark: SparkSession, sf_dir: str, kind: str, packed: DataFrame | None = None) -> str:
    """Path of a capture file of the bus of lineitem, or of its blocks if they are there."""
    packed = bus_blocks(spark, sf_dir) if packed is None else packed
    path = f"{shared_path(spark, 'capture')}.{kind}"
    if kind == "dsl":
        sinks.export_dsl(packed, path, NAMES, "100 MHz")
    else:
        sinks.export_session(packed, path, NAMES, 100_000_000, 5)
    return path


@query(BUS + RUNS)
def s1_dsl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bus as a .dsl archive and back, as levels."""
    return blocks.block_levels(blocks.capture_blocks(spark, written(spark, sf_dir, "dsl"), "dsl"), ["channel"])


@query(BUS + RUNS)
def s2_sr_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bus as a session archive and back, as levels."""
    return blocks.block_levels(blocks.capture_blocks(spark, written(spark, sf_dir, "sr"), "sr"), ["channel"])


@query(BUS + " SELECT channel, position * 10 AS ts_ns, position AS seq, bit AS value FROM y WHERE channel = 2 AND position >= 8192 AND (bit <> p OR position = 8192)")
def s1_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel from its second block on, through the data source: other entries of the archive aren't read."""
    capture_source.register(spark)
    own = spark.read.format("pulse_dsl").load(written(spark, sf_dir, "dsl"))
    return blocks.block_levels(own.where("channel = 2 AND start_pos >= 8192"), ["channel"])


@query(BUS + RUNS)
def s5_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing capture of the bus, followed by three runs of one streaming query: block files come in another order than their positions."""
    capture_source.register(spark)
    packed = blocks.pack_levels(b.bus_bits(spark, sf_dir), ["channel"], "position", "bit", 10, 4096).withColumn("capture_id", F.lit("bus"))
    packed = packed.withColumn("step", F.pmod(F.xxhash64("channel", "block"), F.lit(3)))
    folder = shared_path(spark, "growing")
    packed.write.partitionBy("step").parquet(f"{folder}/all")
    for i in range(3):
        spark.read.schema(packed.schema).parquet(f"{folder}/all").where(F.col("step") == i).drop("step").write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.format("pulse_blocks").option("path", f"{folder}/in").option("channels", "4").load()
        found = run_stream(spark, o.follow_levels(rows, ["channel"]), f"{folder}/stream")
    return found


@query(
    """+ n AS (SELECT count(*) AS n FROM lineitem)
SELECT kind, 4 AS total_probes, 100000000::BIGINT AS samplerate_hz, n AS total_samples, (n + 8191) // 8192 AS total_blocks, least(n, 8192) AS samples_per_block, 'low,next,third,top' AS names,
  CASE kind WHEN 'sr' THEN 5 END::BIGINT AS trigger_sample, n * 10 AS duration_ns FROM n CROSS JOIN (VALUES ('dsl'), ('sr')) k(kind)"""
)
def s8_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of both archives tell."""
    found, packed = None, bus_blocks(spark, sf_dir)
    for kind in ("dsl", "sr"):
        own = blocks.capture_summary(blocks.captures(spark, written(spark, sf_dir, kind, packed), kind))
        own = own.select(
            F.lit(kind).alias("kind"), "total_probes", F.col("samplerate_hz").cast("long").alias("samplerate_hz"), "total_samples", "total_blocks", "samples_per_block",
            F.array_join("probe_names", ",").alias("names"), "trigger_sample", F.round(F.col("duration_us") * 1000).cast("long").alias("duration_ns"),
        )
        found = own if found is None else found.unionByName(own)
    return found


@query(BUS + " SELECT position // 8192 AS entry, count(*)::INT AS n, sha256(string_agg(printf('%02X', q & 15), '' ORDER BY position)) AS digest FROM s GROUP BY position // 8192")
def k5_session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved samples of each entry of the session archive."""
    rows = blocks.capture_blocks(spark, written(spark, sf_dir, "sr"), "sr")
    mixed = sinks.interleave(rows, ["capture_id"], len(NAMES))
    return mixed.select(F.call_function("div", F.col("start_pos"), F.lit(8192)).alias("entry"), "n", F.sha2(F.encode(F.hex("data"), "utf-8"), 256).alias("digest"))


@query(f"SELECT user_id, ts_ns, seq, v AS value FROM ch WHERE ts_ns >= {W0} AND ts_ns < {W1}")
def k6_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes written as lanes by user and week, and one window read back."""
    folder = shared_path(spark, "lanes")
    sinks.write_lanes(levels.changes(b.level(spark, sf_dir), KEYS, bucket_ns=WEEK), folder, KEYS, WEEK)
    rows = sinks.read_lanes(spark, folder, W0, W1, WEEK)
    return rows.select(F.col("user_id").cast("long").alias("user_id"), "ts_ns", "seq", "value")


@query("SELECT user_id, ts_ns, seq, w AS width_ns FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - ts_ns AS w FROM ch) WHERE v AND w IS NOT NULL")
def u1_user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse widths by an operator that a user wrote over pieces of a key's rows."""

    def pulses(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        rows = pd.concat([state["last"], rows]) if state else rows
        moved = rows[rows["value"] != rows["value"].shift()]
        state["last"] = moved.iloc[-1:]
        ended = moved.iloc[:-1].assign(width_ns=np.diff(moved["ts_ns"].to_numpy()))
        return ended[ended["value"].astype(bool)][["ts_ns", "seq", "width_ns"]]

    operator = udf.stream_fold(pulses, "ts_ns long, seq long, width_ns long", ["value"])
    return operator(b.level(spark, sf_dir), KEYS)


READING = payload.PayloadType("reading", T.StructType().add("kind", "string").add("number", "long"))
SPAN = payload.PayloadType("span", T.StructType().add("duration_ns", "long"))


@query("SELECT user_id, ts_ns, seq, kind, number FROM ev WHERE kind <> 'error'")
def u2_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payload types on one stream, stored, and one of them read back."""
    own = b.base(spark, sf_dir)
    stored = payload.with_payload(own.where("kind <> 'error'"), KEYS, READING).unionByName(payload.with_payload(own.where("kind = 'error'"), KEYS, SPAN))
    folder = shared_path(spark, "payloads")
    stored.write.parquet(folder)
    return payload.payloads_of(spark.read.parquet(folder), KEYS, READING)


P6_SQL = """+ c AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE length(text) > 0),
p AS (SELECT conv_id, turn, k, substr(h, 32 * k + 1, 32) AS h FROM c CROSS JOIN LATERAL (SELECT unnest(range(0, (length(h) + 31) // 32)) AS k) r)
SELECT conv_id, turn, 1000 + k * 160000 AS start_ns, length(h) // 2 AS n_words, h AS payload FROM p"""


@query(P6_SQL)
def p6_stacked_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framer over the words of a serial decoder: packets of 16 bytes of each turn."""
    keys = ["conv_id", "turn"]
    found = decode.uart(b.uart_line(spark, sf_dir), keys, 1e6)
    packets = words.frame_packets(found, keys, fixed=16)
    text = F.concat_ws("", F.transform("words", lambda x: formats.hex_text(x["value"])))
    return packets.select(*keys, "start_ns", "n_words", text.alias("payload"))


@query(
    """+ s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - 1 AS stage, number, kind FROM ev),
q AS (SELECT user_id, stage, number % 20 AS channel, CASE kind WHEN 'click' THEN 'rising' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'either' WHEN 'error' THEN 'sideways' ELSE 'high' END AS condition,
  CASE WHEN number % 11 = 0 THEN 'MAYBE' ELSE 'AND' END AS joined, number % 7 AS n FROM s)
SELECT user_id, stage, 'unknown_channel' AS code FROM q WHERE channel >= 16 UNION ALL SELECT user_id, stage, 'unknown_condition' FROM q WHERE condition = 'sideways'
UNION ALL SELECT user_id, stage, 'unknown_join' FROM q WHERE joined = 'MAYBE' UNION ALL SELECT user_id, stage, 'count_range' FROM q WHERE n < 1
UNION ALL SELECT user_id, stage, 'count_step' FROM q WHERE (n - 1) % 2 <> 0
UNION ALL SELECT user_id, NULL, 'stage_count' FROM q GROUP BY user_id HAVING count(*) > 16 UNION ALL SELECT user_id, NULL, 'resources' FROM q GROUP BY user_id HAVING count(*) > 60"""
)
def g4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs read from the events, a stage for each, and what is wrong with them."""
    own = b.base(spark, sf_dir)
    condition = F.when(F.col("kind") == "click", "rising").when(F.col("kind") == "view", "low").when(F.col("kind") == "signup", "either").when(F.col("kind") == "error", "sideways").otherwise("high")
    stages = b.row_numbers(own.withColumnRenamed("ts_ns", "at"), KEYS, ["at", "seq"], WEEK, "n").select(
        "user_id", (F.col("n") - 1).alias("stage"), (F.col("number") % 20).alias("channel"), condition.alias("condition"),
        F.when(F.col("number") % 11 == 0, "MAYBE").otherwise("AND").alias("join"), F.lit("occurrences").alias("counting"), (F.col("number") % 7).alias("count"),
    )
    return trigger.validate_programs(stages, KEYS, 16, trigger.Limits(all_predicates=60, count_step=2))


@query(THREE + " SELECT user_id, min(ts_ns) AS trigger_ns FROM v WHERE (NOT pa AND a) IS TRUE AND NOT c GROUP BY user_id")
def g5_simple_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rise of channel 0 while channel 2 is low; channel 1 is ignored."""
    return trigger.find_trigger(three_channels(spark, sf_dir), KEYS, trigger.Program.simple({0: "rising", 1: "ignore", 2: "low"}), 3)


@query(
    f"""+ f AS (SELECT user_id, min(ts_ns) AS f, min(ts_ns) FILTER (kind = 'error') AS t FROM ev GROUP BY user_id),
og AS (SELECT user_id, CASE WHEN t <= f + {48 * HOUR} THEN t ELSE f + {48 * HOUR} END AS og FROM f)
SELECT ev.user_id, ev.ts_ns, ev.seq FROM ev JOIN og USING (user_id) WHERE ts_ns >= og - {12 * HOUR} AND ts_ns < og + {72 * HOUR}"""
)
def g6_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording from half a day before the first error to three days after it; two days without one force the trigger."""
    own = b.base(spark, sf_dir).select("user_id", "ts_ns", "seq")
    first = b.occurrences(spark, sf_dir, "error").groupBy("user_id").agg(F.min("ts_ns").alias("trigger_ns"))
    return trigger.record(own, first, KEYS, trigger.Policy(before_ns=12 * HOUR, after_ns=72 * HOUR, timeout_ns=48 * HOUR, timeout="force"))


@query(
    f"""+ r AS (SELECT *, (row_number() OVER w - 1) // 64 AS record, coalesce(lead(ts_ns) OVER w, ts_ns) AS e FROM lv WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq)),
t AS (SELECT user_id, record, min(ts_ns) AS start_ns, max(e) AS end_ns, count(*) AS n, arg_min(v, seq) AS first, arg_max(v, seq) AS last FROM r GROUP BY user_id, record),
m AS (SELECT user_id, min(record) - 1 AS low, max(record) + 1 AS high FROM t WHERE start_ns < {W0 + 24 * HOUR} AND end_ns > {W0} GROUP BY user_id),
big AS (SELECT user_id, (row_number() OVER w - 1) // 4096 AS record, ts_ns, coalesce(lead(ts_ns) OVER w, ts_ns) AS e, v, seq FROM lv WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))
SELECT 1 AS tier, t.* FROM t JOIN m ON m.user_id = t.user_id AND t.record BETWEEN low AND high
UNION ALL SELECT 2, user_id, record, min(ts_ns), max(e), count(*), arg_min(v, seq), arg_max(v, seq) FROM big GROUP BY user_id, record"""
)
def q2b_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tier of one day with a record on either side, and the second tier, made from the first."""
    first = retrieval.rollup(b.level(spark, sf_dir), KEYS, 1, bucket_ns=WEEK)
    day = retrieval.records_between(first, KEYS, W0, W0 + 24 * HOUR)
    return day.withColumn("tier", F.lit(1)).unionByName(retrieval.next_tier(first, KEYS).withColumn("tier", F.lit(2)))


@query(
    SPI_ROWS
    + """, i AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) * 10000 AS t FROM supplier)
SELECT 'spi' AS bus, c_nationkey AS nation, t AS ts_ns, 'MOSI [' || printf('%04X', c_custkey >> 8) || '] · Incomplete (8 bits)' AS label FROM c
UNION ALL SELECT 'i2c', n, t + 100, 'Start' FROM i UNION ALL SELECT 'i2c', n, t + 4100, 'Stop' FROM i
UNION ALL SELECT 'i2c', n, t + 240, 'Address 0x' || printf('%02X', k % 128) || ' · Write' FROM i
UNION ALL SELECT 'i2c', n, t + 240 + j * 900, 'Write 0x' || printf('%02X', (k >> (8 * (j - 1))::INT) & 255) FROM i CROSS JOIN (SELECT unnest(range(1, 4)) AS j)"""
)
def x4_bus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of serial transactions and of two-wire packets."""
    x = b.spi_lines(spark, sf_dir)
    spi = decode.spi_transactions(x["clock"], x["cs"], {"mosi": x["mosi"]}, ["c_nationkey"], bits=16)
    label = formats.spi_label({"mosi": F.col("mosi")}, 16, F.col("complete"), F.col("incomplete_bits"))
    spi = spi.select(F.lit("spi").alias("bus"), F.col("c_nationkey").alias("nation"), F.col("start_ns").alias("ts_ns"), label.alias("label"))
    scl, sda = b.i2c_lines(spark, sf_dir)
    i2c = decode.i2c(scl, sda, ["s_nationkey"])
    return spi.unionByName(i2c.select(F.lit("i2c").alias("bus"), F.col("s_nationkey").alias("nation"), "ts_ns", formats.i2c_label(F.col("kind"), F.col("value")).alias("label")))


@query("SELECT user_id, max(ts_ns) AS ts_ns, 0::BIGINT AS seq FROM ev WHERE kind = 'purchase' GROUP BY user_id")
def l10_cursor_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event at a named time of each user: the last purchase."""
    named = b.base(spark, sf_dir).where("kind IN ('purchase', 'error')").groupBy("user_id", F.col("kind").alias("name")).agg(F.max("ts_ns").alias("marker_ns"))
    return levels.cursor_event(b.base(spark, sf_dir), named, KEYS, "purchase")


def stream_of(spark: SparkSession, rows: DataFrame, keys: list[str], parts: int = 2) -> DataFrame:
    """A table (keys, ts_ns, seq, ...) as a stream of files, a batch for each stretch of its time; keys end at different times.

    Ends tell how many rows there are of their key and lie in the file of the stretch after their key's last row, or before some of its rows for every other key.
    """
    folder, files = shared_path(spark, "input"), spark.sparkContext.defaultParallelism
    last = rows.groupBy(*keys).agg(F.max("ts_ns").alias("ts_ns"), F.count(F.lit(1)).alias("end_rows"))
    early = F.when(F.pmod(F.xxhash64(*keys), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(0))
    ends = last.withColumns({"seq": F.lit(-1).cast("long"), "is_end": F.lit(True), "_early": early})
    both = rows.withColumns({"is_end": F.lit(False), "_early": F.lit(0)}).unionByName(ends, allowMissingColumns=True)
    first, end = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    part = F.least(F.call_function("div", F.col("ts_ns") - (first or 0), F.lit(((end or 0) - (first or 0)) // parts + 1)), F.lit(parts - 1))
    both = both.withColumn("_part", F.greatest(part - F.col("_early"), F.lit(0)).cast("int")).drop("_early")
    schema = both.drop("_part").schema
    both.write.partitionBy("_part").parquet(folder)
    for i in range(parts):
        spark.read.schema(schema).parquet(f"{folder}/_part={i}").coalesce(files).sortWithinPartitions(*keys, "ts_ns").write.mode("append").parquet(f"{folder}-in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}-in")


def stream_of_stretches(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Stretches of rows that have their ends with them as a stream of files, one batch."""
    folder = shared_path(spark, "input")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def run_stream(spark: SparkSession, rows: DataFrame, folder: str | None = None) -> DataFrame:
    """The whole result of a stream over what there is of its input, written to the shared folder (or on to ``folder``) and read back."""
    folder = folder or shared_path(spark, "stream")
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


LATCHED = f"""+ s AS (SELECT user_id, ts_ns, seq, kind = 'signup' AS v, lag(kind = 'signup', 1, false) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS p FROM ev WHERE kind IN ('signup', 'error'))
SELECT user_id, ts_ns, seq, v AS value FROM s WHERE v <> p"""


@query(LATCHED)
def r5_stream_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latch of signups and errors, as a stream."""
    rows = stream_of(spark, b.base(spark, sf_dir).where("kind IN ('signup', 'error')"), KEYS)
    held = o.stream_rows(rows, KEYS, F.when(F.col("kind") == "signup", 0).otherwise(1), "1 hour")
    return run_stream(spark, o.apply_ordered(held, KEYS, o.latch_step, "ts_ns long, seq long, value boolean", slot_ms=DAY_MS))


@query(
    """+ n AS (SELECT user_id, ts_ns, 'file_' || row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS name FROM ev WHERE kind = 'signup')
SELECT e.user_id, e.ts_ns, e.seq, e.number AS value, n.name AS filename FROM (SELECT * FROM ev WHERE kind <> 'signup') e ASOF JOIN n ON n.user_id = e.user_id AND e.ts_ns >= n.ts_ns"""
)
def r3_stream_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to the files that signups name, as a stream: two inputs with a watermark each."""
    own = b.base(spark, sf_dir)
    users = own.groupBy(*KEYS).agg(F.min("ts_ns").alias("ts_ns")).withColumns({"seq": F.lit(0).cast("long"), "number": F.lit(0).cast("long"), "kind": F.lit("start")})
    # every user has a row in both inputs, and so an end in both; those of kind start are no name and no word
    inputs = [stream_of(spark, x.select(*KEYS, "ts_ns", "seq", "number", "kind").unionByName(users), KEYS) for x in (own.where("kind = 'signup'"), own.where("kind <> 'signup'"))]
    sides = [o.stream_rows(x, KEYS, F.when(F.col("kind") == "start", -1).otherwise(i), delay, value="number") for i, (x, delay) in enumerate(zip(inputs, ("1 hour", "2 hours"), strict=True))]
    route = o.numbered_route_step("file_")
    step = lambda state, row: [] if row["side"] < 0 else route(state, row)
    found = o.apply_ordered(o.together(sides), KEYS, step, "ts_ns long, seq long, value long, filename string, window long", inputs=2, slot_ms=DAY_MS)
    return run_stream(spark, found).drop("window")


@query("SELECT conv_id, turn, octet_length(encode(any_value(text))) AS n_words, hex(encode(any_value(text))) AS payload FROM conversations WHERE length(text) > 0 GROUP BY conv_id, turn")
def r5_stream_uart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent over a serial line and decoded as a stream of level files."""
    keys = ["conv_id", "turn"]
    line = stream_of_stretches(spark, b.uart_stretches(spark, sf_dir))
    payload = "ts_ns long, seq long, duration_ns long, value long, framing_error boolean, parity_error boolean"
    rows = run_stream(spark, o.apply_ordered(o.stream_rows(line, keys, level="value"), keys, d.uart_columns(1e6), payload))
    listed = F.sort_array(F.collect_list(F.struct("ts_ns", "value")))
    lists = rows.where("not framing_error").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"), listed.alias("l"))
    return lists.select(*keys, "n_words", F.concat_ws("", F.transform("l", lambda x: formats.hex_text(x["value"]))).alias("payload"))


@query(P6_SQL)
def p6_stream_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serial decoder and a framer over its words as two stateful operators of one streaming query."""
    keys = ["conv_id", "turn"]
    line = stream_of_stretches(spark, b.uart_stretches(spark, sf_dir))
    found = o.apply_ordered(o.stream_rows(line, keys, level="value"), keys, d.uart_columns(1e6), "ts_ns long, seq long, duration_ns long, value long", chained=True)
    chained = o.chained_rows(found, keys, 1, duration_ns="duration_ns", value="value")
    packets = o.apply_ordered(chained, keys, o.framer_columns(fixed=16), "start_ns long, end_ns long, n_words long, values array<long>")
    text = F.concat_ws("", F.transform("values", lambda x: formats.hex_text(x)))
    return run_stream(spark, packets).select(*keys, "start_ns", "n_words", text.alias("payload"))


@query(
    f"""+ s AS (SELECT user_id, ts_ns, seq, number, max(ts_ns) OVER (PARTITION BY user_id ORDER BY seq) AS moment FROM (SELECT * FROM ev WHERE kind <> 'purchase'
  UNION ALL SELECT user_id, ts_ns - {100 * DAY}, seq + 1000000000000, kind, number, amount, duration_ns FROM ev WHERE kind = 'purchase'))
SELECT user_id, moment AS ts_ns, seq, row_number() OVER (PARTITION BY user_id ORDER BY moment, seq) AS value FROM s"""
)
def r2_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter over a stream whose purchases arrive after everything else with times long past: they count at the last applied time."""
    own = b.base(spark, sf_dir).select(*KEYS, "ts_ns", "seq", "kind")
    users = own.select(*KEYS).distinct()
    folder = shared_path(spark, "input")
    late = own.where("kind = 'purchase'").withColumns({"ts_ns": F.col("ts_ns") - 100 * DAY, "seq": F.col("seq") + 1_000_000_000_000})
    mark = users.limit(1).withColumns({"ts_ns": F.lit(T0 + 400 * DAY), "seq": F.lit(0).cast("long"), "kind": F.lit("mark")})
    ends = users.withColumns({"ts_ns": F.lit(T0), "seq": F.lit(0).cast("long"), "kind": F.lit("end")})
    for part in (own.where("kind <> 'purchase'"), mark, late, ends):
        part.repartition(1).sortWithinPartitions(*KEYS, "ts_ns").write.mode("append").parquet(folder)
    rows = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    flags = {"is_mark": F.col("kind") == "mark", "is_end": F.col("kind") == "end"}
    held = o.stream_rows(rows.withColumns(flags), KEYS)
    return run_stream(spark, o.apply_ordered(held, KEYS, o.counter_step(), "ts_ns long, seq long, value long", late="clamp", slot_ms=DAY_MS))


@query(
    f"""+ g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) <= {6 * HOUR} THEN 0 ELSE 1 END AS cut FROM ev),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS p FROM g)
SELECT user_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n_words FROM s GROUP BY user_id, p"""
)
def r6_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets by pauses of more than six hours, as a stream; each user's last packet comes with the user's end."""
    rows = stream_of(spark, b.base(spark, sf_dir).select(*KEYS, "ts_ns", "seq"), KEYS, 3)
    frame, rest = o.framer_step(max_gap_ns=6 * HOUR, max_words=1 << 40)
    step = lambda state, row: frame(state, row | {"duration_ns": 0, "value": row["seq"]})
    found = o.apply_ordered(o.stream_rows(rows, KEYS, 1), KEYS, step, "start_ns long, end_ns long, n_words long, values array<long>", finish=rest, slot_ms=DAY_MS)
    return run_stream(spark, found).select(*KEYS, "start_ns", "end_ns", "n_words")


@query("SELECT user_id, ts_ns, seq, w AS width_ns FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - ts_ns AS w FROM ch) WHERE v AND w IS NOT NULL")
def u1_user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse widths by a step that a user wrote, as a stream."""

    def pulses(state: dict, row: dict) -> list[dict]:
        if state.get("value") == row["level"]:
            return []
        ended = [{"ts_ns": state["ts_ns"], "seq": state["seq"], "width_ns": row["ts_ns"] - state["ts_ns"]}] if state.get("value") else []
        state.update(value=row["level"], ts_ns=row["ts_ns"], seq=row["seq"])
        return ended

    rows = stream_of(spark, b.level(spark, sf_dir), KEYS, 3)
    operator = udf.stream_step(pulses, "ts_ns long, seq long, width_ns long")
    return run_stream(spark, operator(o.stream_rows(rows, KEYS, level="value"), KEYS))


def stored_level(spark: SparkSession, sf_dir: str) -> tuple[tiers.Tiers, T.StructType]:
    """The level of each user in tiers of two hours and up, appended in two batches, and its columns' types."""
    level = b.level(spark, sf_dir)
    store = tiers.Tiers(shared_path(spark, "tiers"), tuple(KEYS), 2 * HOUR, 8, 2)
    tiers.append_tiers(level.where(F.col("ts_ns") < W0), store, 0)
    tiers.append_tiers(level.where(F.col("ts_ns") >= W0), store, 1)
    return store, level.schema


@query(None)
def q2_grid_of_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid put together from stored tiers."""
    store, kinds = stored_level(spark, sf_dir)
    return tiers.grid_of_tiers(spark, store, kinds, W0, W1, 28)


@query(None)
def q5_snapshot_of_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot whose keys and grids are chosen and put together from stored tiers."""
    store, kinds = stored_level(spark, sf_dir)
    return tiers.snapshot_of_tiers(spark, store, kinds, W0, W1, 24)


@query(None)
def l3_edge_of_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next edge behind each purchase, by the stored map of slots that hold edges."""
    store, kinds = stored_level(spark, sf_dir)
    return tiers.next_edge_of_tiers(spark, store, kinds, b.occurrences(spark, sf_dir, "purchase"))


@query(None)
def k1_committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all users written as one transaction, and read back."""
    rows = sinks.routed(b.words(spark, sf_dir), file_names(spark, sf_dir), KEYS)
    folder = shared_path(spark, "files")
    file_commits.write_committed(sinks.file_chunks(rows, KEYS, sinks.word_bytes(rows, "u16le")), folder, KEYS, job="first")
    found = file_commits.committed_contents(spark, folder)
    levels = F.split("path", "/")
    return found.select(F.element_at(levels, -2).cast("long").alias("user_id"), F.element_at(levels, -1).alias("filename"), F.hex("content").alias("data"))


SQL["k1_committed_files"], SQL["l3_edge_of_tiers"] = SQL["k1_file_bytes"], SQL["l3_next_edge"]
SQL["q2_grid_of_tiers"], SQL["q5_snapshot_of_tiers"] = SQL["q2_sampled_grid"], SQL["q5_snapshot"]
