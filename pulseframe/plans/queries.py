"""The registered queries of the stream operators, each with its result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import decode, events, imaging, levels, retrieval, text, trigger, words
from ..operators.timeline import as_of, carried, changes, greedy, numbered
from ..sources import blocks, packed, sinks
from . import bindings as b
from .bindings import HOUR, KEYS, T0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions: events as ev, its level as lv, the level's changes as ch (with the value before as p).
EV = r"""ev AS (
  SELECT user_id, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, event_type AS kind, value AS amount, floor(value * 100)::BIGINT AS number,
         regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT * 1000000 AS duration_ns
  FROM events
), lv AS (
  SELECT user_id, ts_ns, seq, amount > 35 AS v FROM ev
), ch AS (
  SELECT * FROM (SELECT user_id, ts_ns, seq, v, lag(v) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS p FROM lv) WHERE p IS NULL OR v <> p
)"""
#: Midnight of 2024-01-08 and 2024-01-22, the ends of the windows that queries look at.
W0, W1 = T0 + 168 * HOUR, T0 + 504 * HOUR
#: Width of the time buckets that timelines are divided into.
WEEK = 168 * HOUR


def query(sql: str | None, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{EV}" + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")) if "{EV}" not in sql else sql.replace("{EV}", EV)
        return f

    return add


def greedy_sql(source: str, hold: str) -> str:
    """Recursive acceptance over ``source`` (user_id, ts_ns, seq) as table acc."""
    return f"""+ r AS (SELECT user_id, ts_ns, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS n FROM ({source})),
acc AS (
  SELECT user_id, ts_ns, seq, n, true AS ok, ts_ns AS last FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.ts_ns, r.seq, r.n, r.ts_ns - acc.last >= {hold}, CASE WHEN r.ts_ns - acc.last >= {hold} THEN r.ts_ns ELSE acc.last END
  FROM acc JOIN r ON r.user_id = acc.user_id AND r.n = acc.n + 1
)"""


@query("SELECT user_id, ts_ns, seq, v AS value FROM ch")
def l1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(b.level(spark, sf_dir), KEYS, bucket_ns=WEEK)


@query("SELECT e.user_id, e.ts_ns, e.seq, lv.v AS value FROM (SELECT * FROM ev WHERE kind = 'purchase') e ASOF LEFT JOIN lv ON e.user_id = lv.user_id AND e.ts_ns >= lv.ts_ns")
def l2_value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.value_at(b.level(spark, sf_dir), b.occurrences(spark, sf_dir, "purchase"), KEYS, bucket_ns=WEEK)


@query(
    """+ t AS (SELECT * FROM ch WHERE p IS NOT NULL)
SELECT e.user_id, e.ts_ns, e.seq, t.ts_ns AS edge_ns, t.v AS edge_value
FROM (SELECT * FROM ev WHERE kind = 'purchase') e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.ts_ns < t.ts_ns"""
)
def l3_next_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.next_edge(b.level(spark, sf_dir), b.occurrences(spark, sf_dir, "purchase"), KEYS, bucket_ns=WEEK)


@query(
    greedy_sql(
        f"SELECT user_id, ts_ns, seq FROM (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS w FROM ch) WHERE p IS NOT NULL AND v AND w >= {HOUR}",
        str(24 * HOUR),
    )
    + " SELECT user_id, ts_ns, seq FROM acc WHERE ok",
    recursive=True,
)
def l4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.edges(b.level(spark, sf_dir), KEYS, "rising", debounce_ns=24 * HOUR, min_pulse_ns=HOUR)


@query(
    f"""+ x AS (
  SELECT user_id, ts_ns, seq, i, CASE i WHEN 0 THEN amount > 20 WHEN 1 THEN amount > 35 ELSE kind = 'view' END AS x FROM ev CROSS JOIN (VALUES (0), (1), (2)) x(i)
), g AS (
  SELECT user_id, ts_ns, seq, i, CASE WHEN i = 0 THEN x END AS a, CASE WHEN i = 1 THEN x END AS b, CASE WHEN i = 2 THEN x END AS c
  FROM (SELECT *, lag(x) OVER (PARTITION BY user_id, i ORDER BY ts_ns, seq) AS px FROM x) WHERE px IS NULL OR x <> px
), m AS (
  SELECT user_id, ts_ns, seq, i, coalesce(last_value(a IGNORE NULLS) OVER w, false) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, false) AS b, coalesce(last_value(c IGNORE NULLS) OVER w, false) AS c
  FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, i, seq ROWS UNBOUNDED PRECEDING)
), o AS (
  SELECT user_id, ts_ns, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, i, seq) AS seq, o, lag(o, 1, false) OVER (PARTITION BY user_id ORDER BY ts_ns, i, seq) AS p FROM (SELECT *, (a::INT + b::INT + c::INT) % 2 = 1 AS o FROM m)
)
SELECT user_id, ts_ns, seq, o AS value FROM o WHERE o <> p
UNION ALL SELECT DISTINCT user_id, {T0}, -1, false FROM ev"""
)
def l5_logic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [b.level(spark, sf_dir, 20.0), b.level(spark, sf_dir), b.kind_level(spark, sf_dir, "view")]
    return levels.logic_gate(inputs, KEYS, "XOR", t0=T0)


@query(
    f"""+ q AS (
  SELECT e.user_id, e.ts_ns, e.seq, lv.v AS value FROM (SELECT * FROM ev WHERE kind = 'error') e
  ASOF LEFT JOIN (SELECT user_id, ts_ns, (amount > 20) AND (amount > 35) AS v FROM ev) lv ON e.user_id = lv.user_id AND e.ts_ns >= lv.ts_ns
) SELECT * FROM q"""
)
def l6_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = levels.logic_gate([b.level(spark, sf_dir, 20.0), b.level(spark, sf_dir)], KEYS, "AND", t0=T0)
    return levels.value_at(gate, b.occurrences(spark, sf_dir, "error"), KEYS)


#: Positions of 20 minutes from the start of the table.
STEP = HOUR // 3


@query(
    f"""+ n AS (SELECT max((ts_ns - {T0}) // {STEP}) + 1 AS total FROM ev),
s AS (
  SELECT u.user_id, g.k, ch.v FROM (SELECT DISTINCT user_id FROM ev) u
  CROSS JOIN (SELECT k, least(k * 64 + 63, total - 1) AS last FROM (SELECT total, unnest(range(0, (total + 63) // 64)) AS k FROM n)) g
  ASOF LEFT JOIN (SELECT user_id, (ts_ns - {T0}) // {STEP} AS pos, arg_max(v, seq) AS v FROM ch GROUP BY ALL) ch ON ch.user_id = u.user_id AND g.last >= ch.pos
), h AS (SELECT user_id, count(*) FILTER (v) AS high_groups, count(*) AS groups FROM s GROUP BY user_id),
a AS (SELECT user_id, count(DISTINCT (ts_ns - {T0}) // {STEP} // 64) AS active_groups FROM ch WHERE p IS NOT NULL GROUP BY user_id)
SELECT h.user_id, coalesce(active_groups, 0) AS active_groups, high_groups, groups, (coalesce(active_groups, 0) * 1000000 // groups)::BIGINT AS activity_ppm, (high_groups * 1000000 // groups)::BIGINT AS high_ppm FROM h LEFT JOIN a USING (user_id)"""
)
def l7_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity to the last position of the table, with both shares in millionths, rounded down."""
    own = b.level(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns") - T0)
    found = levels.activity(own, KEYS, STEP, bucket_ns=WEEK)
    ppm = lambda c: F.floor(F.col(c) * 1_000_000 + 1e-6)
    return found.select("user_id", "active_groups", "high_groups", "groups", ppm("activity_ratio").alias("activity_ppm"), ppm("high_ratio").alias("high_ppm"))


@query(
    f"""+ n AS (SELECT max((ts_ns - {T0}) // {STEP}) + 1 AS total FROM ev),
s AS (
  SELECT u.user_id, g.k, ch.v FROM (SELECT DISTINCT user_id FROM ev) u
  CROSS JOIN (SELECT k, least(k * 64 + 63, total - 1) AS last FROM (SELECT total, unnest(range(0, (total + 63) // 64)) AS k FROM n)) g
  ASOF LEFT JOIN (SELECT user_id, (ts_ns - {T0}) // {STEP} AS pos, arg_max(v, seq) AS v FROM ch GROUP BY ALL) ch ON ch.user_id = u.user_id AND g.last >= ch.pos
), h AS (SELECT user_id, count(*) FILTER (v) AS high_groups, count(*) AS groups FROM s GROUP BY user_id),
a AS (SELECT user_id, count(DISTINCT (ts_ns - {T0}) // {STEP} // 64) AS active_groups FROM ch WHERE p IS NOT NULL GROUP BY user_id)
SELECT h.user_id, coalesce(active_groups, 0) AS active_groups, high_groups, groups FROM h LEFT JOIN a USING (user_id)"""
)
def l7_activity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of l7_activity, without time buckets."""
    own = b.level(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns") - T0)
    return levels.activity(own, KEYS, STEP).select("user_id", "active_groups", "high_groups", "groups")


@query(
    f"""SELECT user_id, t AS ts_ns, s::BIGINT AS seq, v AS value, m AS marker FROM (SELECT DISTINCT user_id FROM ev) CROSS JOIN (VALUES
 ({T0}, 0, true, 'before'), ({W0}, 1, false, 'before'), ({T0}, 0, false, 'at_or_after'), ({W0}, 1, true, 'at_or_after'),
 ({T0}, 0, false, 'window'), ({W0}, 1, true, 'window'), ({W1}, 2, false, 'window'), ({W0}, 0, NULL, 'event')) x(t, s, v, m)"""
)
def l8_l9_l10_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = b.base(spark, sf_dir)
    parts = [levels.marker_relation(users, KEYS, W0, r, T0).withColumn("marker", F.lit(r)) for r in ("before", "at_or_after")]
    parts.append(levels.marker_window(users, KEYS, W0, W1, T0).withColumn("marker", F.lit("window")))
    parts.append(levels.marker_event(users, KEYS, W0).withColumns({"value": F.lit(None).cast("boolean"), "marker": F.lit("event")}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT user_id, ts_ns, seq, w AS width_ns FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - ts_ns AS w FROM ch) WHERE v AND w IS NOT NULL")
def l11_pulse_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.pulse_widths(b.level(spark, sf_dir), KEYS, bucket_ns=WEEK)


@query(
    """+ r AS (SELECT *, lead(ts_ns) OVER w AS e, lead(ts_ns, 2) OVER w AS e2 FROM ch WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))
SELECT e.user_id, e.ts_ns, e.seq, r.v AS value, r.ts_ns AS start_ns, r.e AS end_ns, r.e - r.ts_ns AS width_ns, r.e2 - r.ts_ns AS period_ns,
  ((r.e - r.ts_ns)::HUGEINT * 1000000 // (r.e2 - r.ts_ns))::BIGINT AS duty_ppm
FROM (SELECT * FROM ev WHERE kind = 'purchase') e ASOF LEFT JOIN r ON r.user_id = e.user_id AND e.ts_ns >= r.ts_ns"""
)
def l12_pulse_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.pulses_at(b.level(spark, sf_dir), b.occurrences(spark, sf_dir, "purchase"), KEYS, bucket_ns=WEEK)


@query(
    f"""+ t AS (SELECT user_id, ts_ns FROM ch WHERE p IS NOT NULL), u AS (SELECT DISTINCT user_id, {W0} AS a, {W1} AS b FROM ev),
s AS (SELECT u.user_id, arg_min(t.ts_ns, abs(t.ts_ns - a) * 2 + (t.ts_ns > a)::INT) AS sa, arg_min(t.ts_ns, abs(t.ts_ns - b) * 2 + (t.ts_ns > b)::INT) AS sb FROM u LEFT JOIN t USING (user_id) GROUP BY ALL)
SELECT user_id, {W0} AS a_ns, {W1} AS b_ns, sa AS snapped_a_ns, sb AS snapped_b_ns, abs(sb - sa) AS delta_ns, CASE WHEN abs(sb - sa) > 0 THEN round(1e9 / abs(sb - sa) * 1e12)::BIGINT END AS frequency_phz FROM s"""
)
def l13_edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = b.base(spark, sf_dir).select("user_id").distinct().select("user_id", F.lit(W0).alias("a_ns"), F.lit(W1).alias("b_ns"))
    found = levels.edge_delta(b.level(spark, sf_dir), pairs, KEYS)
    return found.withColumn("frequency_phz", F.round(F.col("frequency_hz") * 1e12).cast("long")).drop("frequency_hz")


@query("SELECT e.user_id, e.ts_ns, e.seq FROM (SELECT * FROM ev WHERE kind = 'purchase') e ASOF JOIN lv ON e.user_id = lv.user_id AND e.ts_ns >= lv.ts_ns WHERE lv.v")
def e1_event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_gate(b.occurrences(spark, sf_dir, "purchase"), b.level(spark, sf_dir), KEYS, bucket_ns=WEEK)


@query(greedy_sql("SELECT * FROM ev WHERE kind = 'click'", str(36 * HOUR)) + f" SELECT user_id, ts_ns + {HOUR} AS ts_ns, seq FROM acc WHERE ok", recursive=True)
def e2_holdoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_control(b.occurrences(spark, sf_dir, "click"), KEYS, delay_ns=HOUR, holdoff_ns=36 * HOUR)


@query(
    """+ m AS (SELECT *, sum((kind = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS epoch FROM ev WHERE kind IN ('click', 'signup'))
SELECT user_id, ts_ns, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts_ns, seq) AS n FROM m WHERE kind = 'click') WHERE n = 1"""
)
def e2_rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_control(b.occurrences(spark, sf_dir, "click"), KEYS, rearms=b.occurrences(spark, sf_dir, "signup"), bucket_ns=WEEK)


@query(
    f"""+ r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS n FROM ev WHERE kind IN ('click', 'signup')),
s AS (
  SELECT user_id, ts_ns, seq, n, kind = 'click' AS ok, kind <> 'click' AS armed, CASE WHEN kind = 'click' THEN ts_ns + {36 * HOUR} ELSE 0 END AS allowed FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.ts_ns, r.seq, r.n, r.kind = 'click' AND s.armed AND r.ts_ns >= s.allowed,
         r.kind = 'signup' OR (s.armed AND NOT (r.kind = 'click' AND r.ts_ns >= s.allowed)),
         CASE WHEN r.kind = 'click' AND s.armed AND r.ts_ns >= s.allowed THEN r.ts_ns + {36 * HOUR} ELSE s.allowed END
  FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1
) SELECT user_id, ts_ns, seq FROM s WHERE ok""",
    recursive=True,
)
def e2_holdoff_rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_control(b.occurrences(spark, sf_dir, "click"), KEYS, holdoff_ns=36 * HOUR, rearms=b.occurrences(spark, sf_dir, "signup"), bucket_ns=WEEK)


@query(
    f"""SELECT user_id, ts_ns, seq, 100 + 5 * row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS value FROM ev WHERE kind = 'signup'
UNION ALL SELECT DISTINCT user_id, {T0}, -1, 100 FROM ev WHERE kind = 'signup'"""
)
def e3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_counter(b.occurrences(spark, sf_dir, "signup"), KEYS, 100, 5, T0, WEEK)


LATCH = f"""+ s AS (SELECT user_id, ts_ns, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS seq, kind = 'signup' AS v, lag(kind = 'signup', 1, false) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS p FROM ev WHERE kind IN ('signup', 'error')),
latch AS (SELECT user_id, ts_ns, seq, v AS value FROM s WHERE v <> p UNION ALL SELECT DISTINCT user_id, {T0}, -1, false FROM s)"""


@query(LATCH + " SELECT * FROM latch")
def e4_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sr_latch(b.occurrences(spark, sf_dir, "signup"), b.occurrences(spark, sf_dir, "error"), KEYS, t0=T0)


@query(
    greedy_sql("SELECT * FROM ev WHERE kind = 'view'", str(48 * HOUR))
    + f""" SELECT user_id, ts_ns, seq, true AS value FROM acc WHERE ok UNION ALL SELECT user_id, ts_ns + {48 * HOUR}, seq, false FROM acc WHERE ok
UNION ALL SELECT DISTINCT user_id, {T0}, -1, false FROM ev WHERE kind = 'view'""",
    recursive=True,
)
def e5_pulse_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pulse_lane(b.occurrences(spark, sf_dir, "view"), KEYS, 48 * HOUR, T0, WEEK)


@query(greedy_sql("SELECT * FROM ev", str(12 * HOUR)) + " SELECT user_id, ts_ns, seq FROM acc WHERE ok", recursive=True)
def f3_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy(b.base(spark, sf_dir).select("user_id", "ts_ns", "seq"), KEYS, 12 * HOUR, bucket_ns=WEEK)


@query(
    """SELECT seq, ts_ns, last_value(CASE WHEN kind = 'purchase' THEN number END IGNORE NULLS) OVER w AS carried, row_number() OVER w AS number
FROM ev WINDOW w AS (ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)"""
)
def f2_bucket_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline over all users, carried in buckets of six hours."""
    rows = b.base(spark, sf_dir).select("ts_ns", "seq", F.when(F.col("kind") == "purchase", F.col("number")).alias("x"))
    return numbered(carried(rows, [], "x", 6 * HOUR), [], 6 * HOUR).select("seq", "ts_ns", "carried", F.col("number").cast("long").alias("number"))


@query("SELECT user_id, ts_ns, seq, duration_ns, number AS value FROM ev WHERE (number & 255) >= (100 & 255)")
def w1_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.words(spark, sf_dir).where(words.matches("ge", 100, 255))


@query("SELECT user_id, ts_ns, seq, duration_ns, number AS value FROM ev WHERE (number & 1023) BETWEEN 100 AND 500")
def w2_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.words(spark, sf_dir).where(words.in_range(100, 500, 1023))


@query("SELECT user_id, ts_ns, seq, duration_ns, number AS value FROM ev WHERE (number & 63) IN (1, 16, 33)")
def w3_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.words(spark, sf_dir).where(words.in_set("1, 0x10, 97", 63))


@query("SELECT user_id, ts_ns, seq, duration_ns, value FROM (SELECT *, number AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS n FROM ev WHERE number % 2 = 0) WHERE n % 3 = 0")
def w4_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.match_words(b.words(spark, sf_dir), KEYS, words.matches("eq", 0, 1), at="start", every=3, bucket_ns=WEEK).drop("match_ns")


@query(
    f"""+ r AS (SELECT *, ts_ns + duration_ns AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS n FROM ev WHERE number % 2 = 0 OR kind = 'signup'),
q AS (SELECT *, kind = 'signup' AS re, number % 2 = 0 AS hit FROM r),
s AS (
  SELECT user_id, n, ts_ns, seq, duration_ns, number, 0 AS c, true AS armed, 0::BIGINT AS allowed, false AS ok FROM q WHERE false
  UNION ALL SELECT DISTINCT user_id, 0, 0, 0, 0, 0, 0, true, 0::BIGINT, false FROM q
  UNION ALL
  SELECT q.user_id, q.n, q.ts_ns, q.seq, q.duration_ns, q.number,
         CASE WHEN q.hit AND (s.armed OR q.re) AND q.t >= s.allowed THEN (CASE WHEN (CASE WHEN q.re THEN 0 ELSE s.c END) + 1 = 2 THEN 0 ELSE (CASE WHEN q.re THEN 0 ELSE s.c END) + 1 END) ELSE (CASE WHEN q.re THEN 0 ELSE s.c END) END,
         CASE WHEN q.hit AND (s.armed OR q.re) AND q.t >= s.allowed AND (CASE WHEN q.re THEN 0 ELSE s.c END) + 1 = 2 THEN false ELSE s.armed OR q.re END,
         CASE WHEN q.hit AND (s.armed OR q.re) AND q.t >= s.allowed AND (CASE WHEN q.re THEN 0 ELSE s.c END) + 1 = 2 THEN q.t + {12 * HOUR} ELSE s.allowed END,
         q.hit AND (s.armed OR q.re) AND q.t >= s.allowed AND (CASE WHEN q.re THEN 0 ELSE s.c END) + 1 = 2
  FROM s JOIN q ON q.user_id = s.user_id AND q.n = s.n + 1
) SELECT user_id, ts_ns, seq, duration_ns, number AS value, ts_ns + duration_ns AS match_ns FROM s WHERE ok""",
    recursive=True,
)
def w4_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second even word, held off half a day after each, re-armed by signups."""
    return words.match_words(b.words(spark, sf_dir), KEYS, words.matches("eq", 0, 1), every=2, holdoff_ns=12 * HOUR, rearms=b.occurrences(spark, sf_dir, "signup"), bucket_ns=WEEK)


@query(
    """+ s AS (SELECT user_id, ts_ns, number & 255 AS pattern, 255 AS mask FROM ev WHERE kind = 'signup')
SELECT e.user_id, e.ts_ns, e.seq, e.duration_ns, e.number AS value FROM ev e ASOF JOIN s ON s.user_id = e.user_id AND e.ts_ns >= s.ts_ns WHERE (e.number & 255) > s.pattern"""
)
def w4b_timed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = b.base(spark, sf_dir).where("kind = 'signup'").select("user_id", "ts_ns", "seq", F.col("number").bitwiseAND(F.lit(255)).alias("pattern"), F.lit(255).cast("long").alias("mask"))
    return words.timed_matches(b.words(spark, sf_dir), settings, KEYS, "gt", WEEK)


@query("SELECT user_id, ts_ns, seq, duration_ns, (number >> 3) & 31 AS value FROM ev")
def w5_bit_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.extract_field(b.words(spark, sf_dir), 3, 5)


@query(
    """SELECT user_id, ts_ns, seq, ts_ns + CASE WHEN d > 0 THEN d WHEN gap IS NULL THEN 0 ELSE least(gap, coalesce(prev, gap), 100000000) END AS end_ns
FROM (SELECT *, CASE WHEN kind = 'view' THEN 0 ELSE duration_ns END AS d, lead(ts_ns) OVER w - ts_ns AS gap, ts_ns - lag(ts_ns) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))"""
)
def w6_word_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.base(spark, sf_dir).select("user_id", "ts_ns", "seq", F.when(F.col("kind") == "view", 0).otherwise(F.col("duration_ns")).alias("duration_ns"))
    return words.word_ends(rows, KEYS, bucket_ns=WEEK).drop("duration_ns")


FRAMES = f"""+ w AS (
  SELECT e.*, e.number % 16 = 0 AS delim, lag(e.number % 16 = 0) OVER o AS after_delim, e.ts_ns - lag(e.ts_ns + e.duration_ns) OVER o AS gap
  FROM (SELECT ev.* FROM ev JOIN lv USING (user_id, ts_ns, seq) WHERE lv.v) e WINDOW o AS (PARTITION BY e.user_id ORDER BY e.ts_ns, e.seq)
), marks AS (
  SELECT user_id, ts_ns, count(*) AS n FROM (SELECT user_id, ts_ns FROM ev WHERE kind = 'error' UNION ALL SELECT user_id, ts_ns FROM lv WHERE NOT v) GROUP BY ALL
), mc AS (
  SELECT user_id, ts_ns, sum(n) OVER (PARTITION BY user_id ORDER BY ts_ns) AS total FROM marks
), x AS (
  SELECT w.*, coalesce(mc.total, 0) AS total FROM w ASOF LEFT JOIN mc ON mc.user_id = w.user_id AND w.ts_ns >= mc.ts_ns
), c AS (
  SELECT *, (coalesce(after_delim, false) OR coalesce(gap > {6 * HOUR}, false) OR coalesce(total <> lag(total) OVER o, false))::INT AS cut FROM x WINDOW o AS (PARTITION BY user_id ORDER BY ts_ns, seq)
), s AS (
  SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS seg FROM c
), k AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id, seg ORDER BY ts_ns, seq) - 1) // 4 AS chunk FROM s
)
SELECT user_id, min(ts_ns) AS start_ns, arg_max(ts_ns + duration_ns, seq) AS end_ns, count(*) AS n_words, string_agg(number, ',' ORDER BY ts_ns, seq) AS word_values
FROM k GROUP BY user_id, seg, chunk"""


@query(FRAMES)
def w7_packet_framer(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = words.frame_packets(
        b.words(spark, sf_dir), KEYS, fixed=4, delimiter=F.col("value") % 16 == 0, max_gap_ns=6 * HOUR, boundaries=b.occurrences(spark, sf_dir, "error"), gate=b.level(spark, sf_dir)
    )
    return packets.select("user_id", "start_ns", "end_ns", "n_words", F.array_join(F.transform("words", lambda x: x["value"].cast("string")), ",").alias("word_values"))


@query("SELECT user_id, count(*) AS n_words, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(ts_ns + duration_ns) AS extent_ns FROM ev GROUP BY user_id")
def w8_word_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_statistics(b.words(spark, sf_dir), KEYS)


COUNTER = f"""+ cnt AS (
  SELECT user_id, ts_ns, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS value FROM ev WHERE kind = 'signup' UNION ALL SELECT DISTINCT user_id, {T0}, -1, 0 FROM ev WHERE kind = 'signup'
), names AS (SELECT user_id, ts_ns, seq, 'file_' || printf('%04d', value) || '.bin' AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS w FROM cnt)"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new file name for each user at each signup."""
    return text.text_formatter([events.event_counter(b.occurrences(spark, sf_dir, "signup"), KEYS, t0=T0)], KEYS, "file_{0:04}.bin")


@query(COUNTER + " SELECT user_id, ts_ns, seq, name AS value FROM names")
def t1_text_formatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir)


@query(
    """+ x AS (SELECT *, CASE seq % 4 WHEN 0 THEN duration_ns // 1000000 WHEN 1 THEN duration_ns // 1000 WHEN 2 THEN duration_ns ELSE duration_ns * 1000 END AS d,
  CASE WHEN (number & 255) BETWEEN 32 AND 126 THEN chr((number & 255)::INT) ELSE '.' END AS ascii FROM ev)
SELECT user_id, ts_ns, seq, printf('0x%02X', number) AS hex, '0b' || bin(number) AS binary, number::VARCHAR AS decimal, printf('0o%o', number) AS octal, ascii,
  printf('0x%02X', number) || ' ' || chr(39) || ascii || chr(39) AS hex_ascii,
  CASE WHEN d >= 1000000000 THEN printf('%d.%09d s', d // 1000000000, d % 1000000000) WHEN d >= 1000000 THEN printf('%d.%06d ms', d // 1000000, d % 1000000)
       WHEN d >= 1000 THEN printf('%d.%03d µs', d // 1000, d % 1000) ELSE d || ' ns' END AS duration FROM x"""
)
def x1_x2_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in all forms, and durations scaled so that every unit occurs."""
    x = F.col("value")
    d = F.expr("CASE seq % 4 WHEN 0 THEN div(duration_ns, 1000000L) WHEN 1 THEN div(duration_ns, 1000L) WHEN 2 THEN duration_ns ELSE duration_ns * 1000 END")
    forms = {"hex": "Hex", "binary": "Binary", "decimal": "Decimal", "octal": "Octal", "ascii": "ASCII", "hex_ascii": "Hex + ASCII"}
    shown = [formats.value_text(x, form).alias(name) for name, form in forms.items()]
    return b.words(spark, sf_dir).select("user_id", "ts_ns", "seq", *shown, formats.time_text(d).alias("duration"))


@query("SELECT user_id, ts_ns, seq, printf('%02X %02X', number & 255, (number >> 8) & 255) AS label, chr((32 + number % 95)::INT) AS shown FROM ev")
def x3_x5_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.words(spark, sf_dir).select(
        "user_id", "ts_ns", "seq", formats.byte_label(formats.little_endian(F.col("value"), 2)).alias("label"), formats.ascii_text(32 + F.col("value") % 95).alias("shown")
    )


@query(
    FRAMES.rsplit("SELECT user_id, min", 1)[0]
    + """SELECT user_id, min(ts_ns) AS start_ns, '[' || string_agg(printf('0x%02X', number), ' ' ORDER BY ts_ns, seq) FILTER (n <= 2) || CASE WHEN count(*) > 2 THEN ' … +' || (count(*) - 2) ELSE '' END || ']' AS label
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seg, chunk ORDER BY ts_ns, seq) AS n FROM k) GROUP BY user_id, seg, chunk"""
)
def x4_packet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = words.frame_packets(
        b.words(spark, sf_dir), KEYS, fixed=4, delimiter=F.col("value") % 16 == 0, max_gap_ns=6 * HOUR, boundaries=b.occurrences(spark, sf_dir, "error"), gate=b.level(spark, sf_dir)
    )
    return packets.select("user_id", "start_ns", formats.word_list_label(F.transform("words", lambda x: x["value"]), 2).alias("label"))


@query(f"SELECT user_id, seq, (ts_ns - {T0}) // 7 AS truncated, (ts_ns - {T0} + 3) // 7 AS rounded FROM ev")
def x6_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts_ns") - T0
    return b.base(spark, sf_dir).select("user_id", "seq", formats.position_of(at, 7).alias("truncated"), formats.position_of(at, 7, True).alias("rounded"))


@query("SELECT conv_id, turn, hex(encode(text)) AS payload, 0::BIGINT AS errors FROM conversations WHERE length(text) > 0")
def p1_uart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent over a serial line and read back."""
    keys = ["conv_id", "turn"]
    found = decode.uart(b.uart_line(spark, sf_dir), keys, 1e6)
    bad = F.sum((F.col("framing_error") | F.col("parity_error")).cast("long")).alias("errors")
    lists = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts_ns", "value"))).alias("l"), bad)
    return lists.select(*keys, F.concat_ws("", F.transform("l", lambda x: formats.hex_text(x["value"]))).alias("payload"), "errors")


SPI_ROWS = """+ c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 1000 AS t FROM customer)"""


@query(
    SPI_ROWS
    + """ SELECT c_nationkey, 'mosi' AS line, t + 30 AS ts_ns, 460::BIGINT AS duration_ns, c_custkey AS value FROM c
UNION ALL SELECT c_nationkey, 'miso', t + 30, 460::BIGINT, 16777215 - c_custkey FROM c"""
)
def p2_spi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.spi_lines(spark, sf_dir)
    return decode.spi(x["clock"], x["cs"], {"mosi": x["mosi"], "miso": x["miso"]}, ["c_nationkey"], bits=24).drop("seq", "window_ns")


@query(SPI_ROWS + " SELECT c_nationkey, t AS start_ns, t + 600 AS end_ns, (c_custkey >> 8)::VARCHAR AS mosi, 8::BIGINT AS incomplete_bits, false AS complete FROM c")
def p2_spi_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.spi_lines(spark, sf_dir)
    found = decode.spi_transactions(x["clock"], x["cs"], {"mosi": x["mosi"]}, ["c_nationkey"], bits=16)
    return found.select("c_nationkey", "start_ns", "end_ns", F.array_join("mosi", ",").alias("mosi"), "incomplete_bits", "complete")


@query("+ c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 100 AS t FROM customer) SELECT c_nationkey, t + 10 AS ts_ns, 40::BIGINT AS duration_ns, c_custkey AS value FROM c WHERE c_custkey % 5 <> 0")
def p3_parallel_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    strobe, data, enable = b.parallel_lines(spark, sf_dir)
    return decode.parallel_bus(strobe, data, ["c_nationkey"], cycles=3, enable=enable).drop("seq")


@query(
    "+ c AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 1000 AS t FROM customer) "
    "SELECT c_nationkey, line, t + 30 AS ts_ns, 460::BIGINT AS duration_ns, CASE line WHEN 'mosi' THEN c_custkey ELSE 16777215 - c_custkey END AS value FROM c CROSS JOIN (VALUES ('mosi'), ('miso')) l(line)"
)
def p2_packed_spi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serial bus as packed samples of 10 ns, decoded without exploding them."""
    return packed.spi(b.spi_blocks(spark, sf_dir), ["c_nationkey"], 0, 1, {"mosi": 2, "miso": 3}, bits=24).drop("seq")


@query("+ c AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 100 AS t FROM customer) SELECT c_nationkey, t + 10 AS ts_ns, 40::BIGINT AS duration_ns, c_custkey AS value FROM c WHERE c_custkey % 5 <> 0")
def p3_packed_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parallel bus as packed samples of 5 ns, decoded without exploding them."""
    return packed.parallel_bus(b.parallel_blocks(spark, sf_dir), ["c_nationkey"], 8, range(8), cycles=3, enable=9).drop("seq")


@query(
    """+ s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) * 10000 AS t FROM supplier)
SELECT s_nationkey, t + 100 AS ts_ns, 'START' AS kind, NULL::BIGINT AS value FROM s UNION ALL SELECT s_nationkey, t + 4100, 'STOP', NULL FROM s
UNION ALL SELECT s_nationkey, t + 240, 'ADDRESS WRITE', s_suppkey % 128 FROM s
UNION ALL SELECT s_nationkey, t + 240 + i * 900, 'DATA WRITE', (s_suppkey >> (8 * (i - 1))::INT) & 255 FROM s CROSS JOIN (SELECT unnest(range(1, 4)) AS i)"""
)
def p4_i2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    scl, sda = b.i2c_lines(spark, sf_dir)
    return decode.i2c(scl, sda, ["s_nationkey"]).select("s_nationkey", "ts_ns", "kind", "value")


@query(SPI_ROWS + " SELECT c_nationkey, t + 30 + k * 20 AS ts_ns, (c_custkey >> (23 - k)::INT) & 1 = 1 AS bit_mosi FROM c CROSS JOIN (SELECT unnest(range(0, 24)) AS k) WHERE t + 30 + k * 20 BETWEEN 1000 AND 5999")
def p5_sampling_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.spi_lines(spark, sf_dir)
    points = decode.spi_samples(x["clock"], x["cs"], {"mosi": x["mosi"]}, ["c_nationkey"]).select("c_nationkey", "ts_ns", "seq", "bit_mosi")
    return decode.sampling_points(points, ["c_nationkey"], 1000, 6000, 20).drop("seq")


PACKED = """+ s AS (SELECT l_linenumber AS channel, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position, l_quantity::BIGINT % 2 = 1 AS bit FROM lineitem)"""


@query(PACKED + ", x AS (SELECT *, lag(bit) OVER (PARTITION BY channel ORDER BY position) AS p FROM s) SELECT channel, position * 10 AS ts_ns, position AS seq, bit AS value FROM x WHERE p IS NULL OR bit <> p")
def s3_block_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = blocks.pack_levels(b.bits(spark, sf_dir), ["channel"], "position", "bit", 10, 1024)
    return blocks.block_levels(packed, ["channel"])


@query(PACKED + ", x AS (SELECT *, lag(bit) OVER (PARTITION BY channel ORDER BY position) AS p FROM s) SELECT channel, position * 10 AS ts_ns, position AS seq, bit AS value FROM x WHERE (p IS NULL OR bit <> p) AND position < 500")
def s4_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = blocks.pack_levels(b.bits(spark, sf_dir), ["channel"], "position", "bit", 10, 1024)
    return blocks.block_levels(packed, ["channel"], max_samples=500)


@query(PACKED + " SELECT position, sum(CASE WHEN bit THEN 1::BIGINT << channel ELSE 0 END)::BIGINT AS value FROM s WHERE position % 1000 = 777 GROUP BY position")
def s6_bus_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bus at every thousandth position of the table."""
    own = b.bits(spark, sf_dir)
    packed = blocks.pack_levels(own, ["channel"], "position", "bit", 10, 1024)
    return blocks.bus_at_probes(packed, own.where("position % 1000 = 777").select("position").distinct(), [], 1024)


@query(PACKED + " SELECT channel, min(position) AS start_pos, count(*)::INT AS n, count(*) FILTER (bit) AS high FROM s WHERE position BETWEEN 512 AND 1535 GROUP BY channel, position // 1024")
def s7_sub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of positions 512 to 1535 of all channels; they are the feature, and blocks outside of them are pruned."""
    packed = blocks.pack_levels(b.bits(spark, sf_dir), ["channel"], "position", "bit", 10, 1024)
    view = blocks.sub_blocks(packed, 512, 1536)
    high = F.length(F.replace(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 2))), F.lit("0"), F.lit("")))
    return view.select("channel", "start_pos", "n", high.cast("long").alias("high"))


@query(
    f"""+ g AS (SELECT u.user_id, {W0} + i * 3 * {HOUR} AS ts_ns FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT unnest(range(0, 112)) AS i)),
s AS (SELECT g.user_id, g.ts_ns, lv.v FROM g ASOF LEFT JOIN lv ON lv.user_id = g.user_id AND g.ts_ns >= lv.ts_ns),
d AS (SELECT *, row_number() OVER w AS n, lag(v) OVER w AS p FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns))
SELECT user_id, ts_ns, v AS value FROM d WHERE n = 1 OR v IS DISTINCT FROM p"""
)
def q1_sampled_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sampled_naive(b.level(spark, sf_dir), KEYS, W0, W1, 112)


def grid_sql(cells: int) -> str:
    """The pieces of [W0, W1) in so many cells as table grid."""
    return f"""+ c AS (SELECT *, (ts_ns - {W0}) * {cells} // {W1 - W0} AS cell FROM ch WHERE p IS NOT NULL AND ts_ns > {W0} AND ts_ns < {W1}),
n AS (SELECT user_id, cell, count(*) AS n, arg_min(p, seq) AS first, arg_max(v, seq) AS last FROM c GROUP BY ALL),
i AS (SELECT u.user_id, lv.v AS initial FROM (SELECT DISTINCT user_id, {W0} AS t FROM ev) u ASOF LEFT JOIN lv ON lv.user_id = u.user_id AND u.t >= lv.ts_ns),
g AS (SELECT i.user_id, i.initial, cell, n.n, n.first, n.last FROM i CROSS JOIN (SELECT unnest(range(0, {cells})) AS cell) LEFT JOIN n USING (user_id, cell)),
h AS (SELECT *, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial) AS before FROM g),
f AS (SELECT user_id, cell, CASE WHEN n IS NULL THEN 'Level' WHEN n = 1 THEN 'Edge' ELSE 'Activity' END AS kind, coalesce(first, before) AS first, coalesce(last, first, before) AS last FROM h),
j AS (SELECT *, (kind = 'Level' AND lag(kind) OVER w = 'Level' AND lag(last) OVER w IS NOT DISTINCT FROM first)::INT AS joins FROM f WINDOW w AS (PARTITION BY user_id ORDER BY cell)),
k AS (SELECT *, sum(1 - coalesce(joins, 0)) OVER (PARTITION BY user_id ORDER BY cell) AS piece FROM j),
grid AS (SELECT user_id, any_value(kind) AS kind, {W0} + min(cell) * {W1 - W0} // {cells} AS start_ns, {W0} + (max(cell) + 1) * {W1 - W0} // {cells} AS end_ns, bool_or(first) AS first, bool_or(last) AS last FROM k GROUP BY user_id, piece)"""


@query(grid_sql(28) + " SELECT * FROM grid")
def q2_sampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of cells of half a day."""
    return retrieval.sampled_grid(b.level(spark, sf_dir), KEYS, W0, W1, 28)


@query(
    """+ r AS (SELECT *, (row_number() OVER w - 1) // 64 AS record, coalesce(lead(ts_ns) OVER w, ts_ns) AS e FROM lv WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))
SELECT user_id, record, min(ts_ns) AS start_ns, max(e) AS end_ns, count(*) AS n, arg_min(v, seq) AS first, arg_max(v, seq) AS last FROM r GROUP BY user_id, record"""
)
def q2b_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rollup(b.level(spark, sf_dir), KEYS, 1, bucket_ns=WEEK)


@query(
    f"""+ e AS (SELECT *, ts_ns + CASE WHEN duration_ns > 0 THEN duration_ns WHEN gap IS NULL THEN 0 ELSE least(gap, coalesce(prev, gap), 100000000) END AS end_ns
  FROM (SELECT *, lead(ts_ns) OVER w - ts_ns AS gap, ts_ns - lag(ts_ns) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq)))
SELECT user_id, ts_ns, seq, duration_ns, value, end_ns, c <= 20 AS complete
FROM (SELECT *, number AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM e WHERE ts_ns <= {W1} AND end_ns >= {W0}) WHERE n <= 20"""
)
def q3_exact_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 words of each user that meet the window; instantaneous ones with the ends that they are lent."""
    return retrieval.exact_window(b.words(spark, sf_dir), KEYS, W0, W1, 20, WEEK)


@query(
    f"""+ p AS (SELECT * FROM ev WHERE kind = 'purchase'), w AS (SELECT user_id, ts_ns AS t FROM ev WHERE kind = 'view' UNION SELECT user_id, ts_ns + duration_ns FROM ev WHERE kind = 'view'),
n AS (SELECT p.user_id, p.ts_ns, p.seq, a.t AS before FROM p ASOF LEFT JOIN w a ON a.user_id = p.user_id AND p.ts_ns >= a.t),
m AS (SELECT n.*, z.t AS after FROM n ASOF LEFT JOIN w z ON z.user_id = n.user_id AND n.ts_ns <= z.t),
k AS (SELECT *, CASE WHEN after IS NULL OR ts_ns - before <= after - ts_ns THEN before ELSE after END AS nearest FROM m)
SELECT user_id, ts_ns, seq, CASE WHEN abs(nearest - ts_ns) <= {48 * HOUR} THEN nearest END AS nearest_ns FROM k"""
)
def q4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = b.base(spark, sf_dir).where("kind = 'view'").select("user_id", "ts_ns", "seq", "duration_ns")
    return retrieval.nearest_boundary(b.occurrences(spark, sf_dir, "purchase"), retrieval.word_boundaries(views, KEYS), KEYS, 48 * HOUR)


@query(
    grid_sql(24)
    + f""", few AS (SELECT user_id, count(*) FILTER (p IS NOT NULL AND ts_ns > {W0} AND ts_ns <= {W1}) <= 24 AS few FROM ch GROUP BY user_id)
SELECT user_id, 'Exact' AS kind, {W0} AS start_ns, NULL::BIGINT AS end_ns, NULL::BOOLEAN AS first, initial AS last FROM few JOIN i USING (user_id) WHERE few AND initial IS NOT NULL
UNION ALL SELECT user_id, 'Exact', {W0}, NULL, NULL, NULL FROM few JOIN i USING (user_id) WHERE few AND initial IS NULL
UNION ALL SELECT user_id, 'Exact', ts_ns, NULL, NULL, v FROM few JOIN ch USING (user_id) WHERE few AND ts_ns > {W0} AND ts_ns <= {W1}
UNION ALL SELECT grid.* FROM grid JOIN few USING (user_id) WHERE NOT few"""
)
def q5_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes where a user has at most 24, else pieces of 24 cells."""
    return retrieval.lane_snapshot(b.level(spark, sf_dir), KEYS, W0, W1, 24)


@query(
    f"""+ g AS (SELECT user_id, k AS bucket, {W0} + k * {W1 - W0} // 100 AS s, {W0} + (k + 1) * {W1 - W0} // 100 AS e FROM (SELECT DISTINCT user_id FROM ev) CROSS JOIN (SELECT unnest(range(0, 100)) AS k))
SELECT g.user_id, g.bucket, g.s AS start_ns, g.e AS end_ns, count(ev.seq) AS n_words FROM g LEFT JOIN ev ON ev.user_id = g.user_id AND ev.ts_ns < g.e AND ev.ts_ns + ev.duration_ns >= g.s GROUP BY ALL"""
)
def q6_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.presence_histogram(b.words(spark, sf_dir), KEYS, W0, W1, 100)


@query(
    f"""+ a AS (SELECT user_id, ts_ns, seq, lead(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - ts_ns AS d, number FROM ev WHERE kind = 'signup'),
c AS (SELECT a.user_id, a.ts_ns, a.seq, e.number AS x, e.ts_ns AS t FROM a JOIN ev e ON e.user_id = a.user_id AND e.kind = 'click' AND e.ts_ns >= a.ts_ns AND e.ts_ns < a.ts_ns + coalesce(a.d, 0))
SELECT a.user_id, a.ts_ns, a.seq, coalesce(string_agg(c.x, ',' ORDER BY c.t), '') AS children FROM a LEFT JOIN c USING (user_id, ts_ns, seq) GROUP BY ALL"""
)
def q7_decoder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = b.base(spark, sf_dir)
    gap = F.lead("ts_ns").over(Window.partitionBy("user_id").orderBy("ts_ns", "seq")) - F.col("ts_ns")
    anchors = own.where("kind = 'signup'").withColumn("duration_ns", F.coalesce(gap, F.lit(0))).select("user_id", "ts_ns", "seq", "duration_ns")
    found = retrieval.decoder_table(anchors, own.where("kind = 'click'").withColumn("value", F.col("number")), KEYS, bucket_ns=WEEK)
    return found.select("user_id", "ts_ns", "seq", F.array_join("children", ",").alias("children"))


@query("SELECT user_id, max(ts_ns + duration_ns) AS extent_ns FROM ev GROUP BY user_id")
def q8_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.extent(b.words(spark, sf_dir), KEYS)


THREE = """+ v AS (SELECT user_id, ts_ns, amount > 20 AS a, amount > 35 AS b, kind = 'view' AS c, lag(amount > 20) OVER w AS pa, lag(amount > 35) OVER w AS pb, lag(kind = 'view') OVER w AS pc FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))"""


def three_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.channel_rows([b.level(spark, sf_dir, 20.0), b.level(spark, sf_dir), b.kind_level(spark, sf_dir, "view")], KEYS)


@query(THREE + " SELECT user_id, ts_ns, coalesce(NOT pa AND a, false) OR (pb AND NOT b) IS TRUE AS either, NOT c AND a AS plain FROM v")
def g1_g2_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = three_channels(spark, sf_dir)
    either = trigger.stage_match(trigger.Stage({0: "rising", 1: "falling"}, "OR"))
    return rows.select("user_id", "ts_ns", either.alias("either"), trigger.stage_match(trigger.Stage({2: "low", 0: "high"})).alias("plain"))


@query(
    THREE
    + """, m AS (SELECT *, (NOT pa AND a) IS TRUE AS up, b AS high, c AS view FROM v),
o AS (SELECT *, sum(up::INT) OVER (PARTITION BY user_id ORDER BY ts_ns) AS n FROM m), t1 AS (SELECT user_id, min(ts_ns) AS t FROM o WHERE up AND n >= 3 GROUP BY user_id),
x AS (SELECT m.*, t1.t, sum((NOT m.high)::INT) OVER (PARTITION BY m.user_id ORDER BY m.ts_ns) AS r FROM m JOIN t1 ON m.user_id = t1.user_id AND m.ts_ns > t1.t),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id, r ORDER BY ts_ns) AS n FROM x WHERE high), t2 AS (SELECT user_id, min(ts_ns) AS t FROM y WHERE n >= 2 GROUP BY user_id)
SELECT m.user_id, min(m.ts_ns) AS trigger_ns FROM m JOIN t2 ON m.user_id = t2.user_id AND m.ts_ns > t2.t WHERE m.view GROUP BY m.user_id"""
)
def g3_multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third rise of channel 0, then channel 1 high twice running, then channel 2 high."""
    stages = [trigger.Stage({0: "rising"}, count=3), trigger.Stage({1: "high"}, count=2, counting="consecutive"), trigger.Stage({2: "high"})]
    return trigger.find_trigger(three_channels(spark, sf_dir), KEYS, trigger.Program(stages), 3)


@query(f"+ t AS (SELECT user_id, min(ts_ns) AS t FROM ev WHERE kind = 'error' GROUP BY user_id) SELECT ev.user_id, ev.ts_ns, ev.seq FROM ev JOIN t USING (user_id) WHERE ts_ns >= t - {24 * HOUR} AND ts_ns < t + {72 * HOUR}")
def g6_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.base(spark, sf_dir).select("user_id", "ts_ns", "seq")
    first = b.occurrences(spark, sf_dir, "error").groupBy("user_id").agg(F.min("ts_ns").alias("trigger_ns"))
    return trigger.slice_capture(own, first, KEYS, placement=0.25, total_ns=96 * HOUR)


@query(f"SELECT user_id, ts_ns, seq FROM (SELECT *, max(ts_ns) OVER (PARTITION BY user_id) AS m FROM ev) WHERE ts_ns >= m - {48 * HOUR}")
def g7_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.retain_recent(b.base(spark, sf_dir).select("user_id", "ts_ns", "seq"), KEYS, 48 * HOUR)


@query("SELECT user_id, ts_ns, seq FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns DESC, seq DESC) AS n FROM ev) WHERE c <= 40 OR n <= 30")
def g8_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigger.retain_rolling(b.base(spark, sf_dir).select("user_id", "ts_ns", "seq"), KEYS, 40)


@query("SELECT user_id, quantile_disc(g, 0.5) AS line_width FROM (SELECT user_id, lead(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns) - ts_ns AS g FROM ev WHERE kind = 'click') WHERE g IS NOT NULL GROUP BY user_id")
def i1_line_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.line_width(b.occurrences(spark, sf_dir, "click"), KEYS, "ts_ns")


DAYS = """+ d AS (SELECT l_linenumber AS channel, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day, sum(l_quantity::BIGINT) AS a, sum(floor(l_extendedprice)::BIGINT) AS b FROM lineitem GROUP BY ALL)"""


@query(
    DAYS
    + """, s AS (SELECT channel, day, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM d WINDOW w AS (PARTITION BY channel ORDER BY day)), q AS (SELECT * FROM s WHERE da IS NOT NULL),
c AS (SELECT x.channel, lag, count(*) AS overlap, corr(x.da, y.db) AS r FROM q x CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN q y ON y.channel = x.channel AND y.day = x.day + lag GROUP BY ALL HAVING count(*) >= 10)
SELECT channel, arg_max(lag, r)::INT AS lag, arg_max(overlap, r) AS overlap, round(max(r), 6) AS correlation FROM c GROUP BY channel"""
)
def i2_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag between daily quantity and price of each line number."""
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("channel"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day"), F.col("l_quantity").cast("long").alias("x"), F.floor("l_extendedprice").cast("long").alias("y")
    )
    series = rows.groupBy("channel", "day").agg(F.sum("x").alias("a"), F.sum("y").alias("b"))
    return imaging.best_lag(series, ["channel"], "day", "a", "b", 5).withColumn("correlation", F.round("correlation", 6))


@query(
    """+ s AS (SELECT row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position, l_linenumber AS channel, (l_partkey * 13) % 65536 AS r, (l_suppkey * 101) % 65536 AS g, (l_orderkey * 7) % 65536 AS b FROM lineitem),
p AS (SELECT channel, position // 100 AS line, position % 100 AS "column", floor(sqrt(r / 65535.0::DOUBLE) * 255 + 0.5)::BIGINT AS r, floor(sqrt(g / 65535.0::DOUBLE) * 255 + 0.5)::BIGINT AS g, floor(sqrt(b / 65535.0::DOUBLE) * 255 + 0.5)::BIGINT AS b FROM s)
SELECT channel, line, "column", r, g, b, (r * 299 + g * 587 + b * 114) // 1000 AS luminance
FROM (SELECT channel, line, "column", r, lead(g, 100) OVER w AS g, lead(b, 200) OVER w AS b FROM (SELECT *, line * 100 + "column" AS place FROM p) WINDOW w AS (PARTITION BY channel ORDER BY place)) WHERE b IS NOT NULL"""
)
def i3_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.row_numbers(b.table(spark, sf_dir, "lineitem"), ["l_linenumber"], b.LINE_ORDER, 1 << 14, "n")
    rows = rows.select((F.col("n") - 1).alias("position"), F.col("l_linenumber").alias("channel"), (F.col("l_partkey") * 13 % 65536).alias("r"), (F.col("l_suppkey") * 101 % 65536).alias("g"), (F.col("l_orderkey") * 7 % 65536).alias("b"))
    return imaging.pixels(rows, ["channel"], 100, shifts=(0, 1, 2))


ROUTED = COUNTER + ", rt AS (SELECT e.*, n.name, n.w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) - 1 AS pos FROM ev) e ASOF JOIN names n ON n.user_id = e.user_id AND e.ts_ns >= n.ts_ns)"
INDEX = """ SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w) AS file_num, name AS filename, 2 * count(*) AS bytes,
  printf('%d.%03d000', min(ts_ns) // 1000, min(ts_ns) % 1000) AS start_time_us, printf('%d.%03d000', max(ts_ns) // 1000, max(ts_ns) % 1000) AS end_time_us,
  printf('%d.%03d000', (max(ts_ns) - min(ts_ns)) // 1000, (max(ts_ns) - min(ts_ns)) % 1000) AS duration_us, min(pos) AS start_pos, max(pos) AS end_pos FROM rt GROUP BY user_id, w, name"""


@query(ROUTED + INDEX)
def k1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.capture_index(sinks.routed(b.words(spark, sf_dir), file_names(spark, sf_dir), KEYS), KEYS, "u16le")


@query(ROUTED + " SELECT user_id, name AS filename, string_agg(printf('%02X%02X', number & 255, (number >> 8) & 255), '' ORDER BY ts_ns, seq) AS data FROM rt GROUP BY user_id, w, name")
def k1_file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.routed(b.words(spark, sf_dir), file_names(spark, sf_dir), KEYS)
    return sinks.file_chunks(rows, KEYS, sinks.word_bytes(rows, "u16le")).select("user_id", "filename", F.hex("data").alias("data"))


@query(ROUTED + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY ts_ns, seq) - 1 AS row_id FROM rt) SELECT user_id, name AS filename, row_id, row_id || ',' || ts_ns || ',' || printf('%04X', number) AS line FROM n UNION ALL SELECT user_id, name, -1, 'row,time,value' FROM n WHERE row_id = 0")
def k2_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.routed(b.words(spark, sf_dir), file_names(spark, sf_dir), KEYS)
    return sinks.csv_lines(rows, KEYS, hexadecimal=True, digits=4, header="row,time,value").select("user_id", "filename", "row_id", "line")


@query(ROUTED + " SELECT user_id, name AS filename, string_agg(kind, chr(10) ORDER BY ts_ns, seq) || chr(10) AS content FROM rt GROUP BY user_id, w, name")
def k3_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.routed(b.base(spark, sf_dir), file_names(spark, sf_dir), KEYS)
    found = sinks.file_chunks(rows, KEYS, F.encode(F.concat("kind", F.lit("\n")), "utf-8"))
    return found.select("user_id", "filename", F.decode("data", "utf-8").alias("content"))


@query(
    ROUTED
    + """, wi AS (SELECT user_id, ts_ns, name, w, row_number() OVER (PARTITION BY user_id, w ORDER BY ts_ns, seq) - 1 AS i FROM rt),
e AS (SELECT ch.user_id, ch.ts_ns, ch.seq, ch.v, wi.i, wi.ts_ns AS hit, wi.w, wi.name FROM (SELECT * FROM ch WHERE p IS NOT NULL) ch ASOF JOIN wi ON wi.user_id = ch.user_id AND ch.ts_ns <= wi.ts_ns),
c AS (SELECT *, sum(v::INT) OVER (PARTITION BY user_id, w ORDER BY ts_ns, seq) AS cycle FROM e WHERE i > 0),
g AS (SELECT user_id, w, name, cycle, min(i) FILTER (v) AS ri, min(ts_ns) FILTER (v) AS rt, min(i) FILTER (NOT v) AS fi, min(ts_ns) FILTER (NOT v) AS ft, min(hit) FILTER (v) AS ra, min(hit) FILTER (NOT v) AS fa FROM c WHERE cycle > 0 GROUP BY ALL),
n AS (SELECT *, lead(ri) OVER (PARTITION BY user_id, w ORDER BY cycle) AS nx FROM g)
SELECT user_id, name AS filename, cycle::BIGINT AS cycle, coalesce(ri, 0) AS rise_word, coalesce(rt, 0) AS rise_ns, coalesce(fi, 0) AS fall_word, coalesce(ft, 0) AS fall_ns,
  CASE WHEN nx IS NULL OR ri < nx THEN coalesce(ri, 0) ELSE 0 END AS rise_after_word, CASE WHEN nx IS NULL OR ri < nx THEN coalesce(ra, 0) ELSE 0 END AS rise_after_ns,
  CASE WHEN nx IS NULL OR fi < nx THEN coalesce(fi, 0) ELSE 0 END AS fall_after_word, CASE WHEN nx IS NULL OR fi < nx THEN coalesce(fa, 0) ELSE 0 END AS fall_after_ns FROM n"""
)
def k4_line_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.line_clock_records(b.words(spark, sf_dir), file_names(spark, sf_dir), b.level(spark, sf_dir), KEYS).drop("window")


@query(
    LATCH
    + f""", t AS (SELECT * FROM ev WHERE number % 2 = 0), g AS (SELECT t.* FROM t ASOF JOIN latch ON latch.user_id = t.user_id AND t.ts_ns >= latch.ts_ns WHERE latch.value),
n AS (SELECT user_id, ts_ns, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, seq) AS k FROM ev WHERE kind = 'signup' UNION ALL SELECT DISTINCT user_id, {T0}, 0 FROM ev WHERE kind = 'signup'),
f AS (SELECT g.user_id, g.ts_ns, g.number, n.k FROM g ASOF JOIN n ON n.user_id = g.user_id AND g.ts_ns >= n.ts_ns)
SELECT user_id, 'capture_' || printf('%03d', k) || '.bin' AS filename, count(*) AS n_words, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, sum(number)::BIGINT AS total FROM f GROUP BY user_id, k"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between a start and a stop match, gated by the latch they set, in files named by a counter."""
    own = b.words(spark, sf_dir)
    starts = b.occurrences(spark, sf_dir, "signup")
    latch = events.sr_latch(starts, b.occurrences(spark, sf_dir, "error"), KEYS, t0=T0)
    inside = events.event_gate(own.where(words.matches("eq", 0, 1)), latch, KEYS)
    names = text.text_formatter([events.event_counter(starts, KEYS, t0=T0)], KEYS, "capture_{0:03}.bin")
    files = as_of(inside, names, KEYS, {"value": "filename"}).where("filename is not null")
    return files.groupBy("user_id", "filename").agg(
        F.count(F.lit(1)).alias("n_words"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.sum("value").alias("total")
    )
