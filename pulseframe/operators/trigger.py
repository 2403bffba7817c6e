"""Trigger search, capture slices and retention."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ, TS, StreamError
from .levels import gate_of
from .stages import Counted, completions
from .timeline import after, along, before, merged, same_parts

CONDITIONS = ("ignore", "low", "high", "rising", "falling", "either")
MOST_STAGES = 16
MOST_PREDICATES = 64


def condition(name: str, now: Column, before: Column) -> Column:
    """A channel condition on its value and the one before (null: none); edges need one before."""
    rose = F.coalesce(~before & now, F.lit(False))
    fell = F.coalesce(before & ~now, F.lit(False))
    return {"ignore": F.lit(True), "low": ~now, "high": now, "rising": rose, "falling": fell, "either": rose | fell}[name]


@dataclass
class Stage:
    """Conditions by channel number, joined by AND, OR, XOR, NAND or NOR, perhaps inverted, perhaps counted."""

    conditions: dict[int, str]
    join: str = "AND"
    inverted: bool = False
    count: int = 1
    counting: str = "occurrences"


@dataclass
class Program:
    stages: list[Stage] = field(default_factory=list)

    @classmethod
    def simple(cls, conditions: dict[int, str]) -> Program:
        """One AND stage of the channels that aren't ignored."""
        return cls([Stage({k: v for k, v in conditions.items() if v != "ignore"})])

    def problems(self, channels: int, limits: Limits | None = None) -> list[str]:
        """What is wrong with the program, as codes with their place.

        ``limits`` tells what a device can take: stages, predicates of a stage, and the range and step of counts.
        """
        limits = limits or Limits()
        out = [] if 1 <= len(self.stages) <= limits.stages else ["stage_count"]
        for k, s in enumerate(self.stages):
            out += [f"unknown_channel:{k}:{c}" for c in s.conditions if not 0 <= c < channels]
            out += [f"unknown_condition:{k}:{v}" for v in s.conditions.values() if v not in CONDITIONS]
            out += [f"no_predicate:{k}"] if not s.conditions else []
            out += [f"too_many_predicates:{k}"] if len(s.conditions) > limits.predicates else []
            out += [f"unknown_join:{k}:{s.join}"] if s.join not in ("AND", "OR", "XOR", "NAND", "NOR") else []
            out += [f"count_range:{k}"] if not limits.least_count <= s.count <= limits.most_count else []
            out += [f"count_step:{k}"] if (s.count - limits.least_count) % limits.count_step else []
            out += [f"unknown_counting:{k}:{s.counting}"] if s.counting not in ("occurrences", "consecutive") else []
        every = sum(len(s.conditions) for s in self.stages)
        return out + ([f"resources:{every}"] if limits.all_predicates is not None and every > limits.all_predicates else [])


@dataclass
class Limits:
    """What a program may use: by default any count, and MOST_STAGES and MOST_PREDICATES."""

    stages: int = MOST_STAGES
    predicates: int = MOST_PREDICATES
    all_predicates: int | None = None
    least_count: int = 1
    most_count: int = 1 << 32
    count_step: int = 1


def validate_programs(predicates: DataFrame, keys: Sequence[str], channels: int, limits: Limits | None = None) -> DataFrame:
    """keys, stage, code: what :meth:`Program.problems` finds in a table of programs, without the channel or word that is wrong.

    ``predicates`` has a row for each condition of a stage: keys, stage (from 0), channel, condition, join, counting, count.
    """
    limits = limits or Limits()
    bad = F.array_compact(
        F.array(
            F.when(~F.col("channel").between(0, channels - 1), "unknown_channel"),
            F.when(~F.col("condition").isin(*CONDITIONS), "unknown_condition"),
        )
    )
    each = predicates.select(*keys, "stage", F.explode(bad).alias("code")).distinct()
    stages = predicates.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("join", "counting", "count")))
    of_stage = F.array_compact(
        F.array(
            F.when(F.col("n") > limits.predicates, "too_many_predicates"),
            F.when(~F.col("join").isin("AND", "OR", "XOR", "NAND", "NOR"), "unknown_join"),
            F.when(~F.col("count").between(limits.least_count, limits.most_count), "count_range"),
            F.when(F.pmod(F.col("count") - limits.least_count, F.lit(limits.count_step)) != 0, "count_step"),
            F.when(~F.col("counting").isin("occurrences", "consecutive"), "unknown_counting"),
        )
    )
    programs = stages.groupBy(*keys).agg(F.count(F.lit(1)).alias("stages"), F.sum("n").alias("all"))
    most = limits.all_predicates if limits.all_predicates is not None else 1 << 62
    of_program = F.array_compact(F.array(F.when(F.col("stages") > limits.stages, "stage_count"), F.when(F.col("all") > most, "resources")))
    out = each.unionByName(stages.select(*keys, "stage", F.explode(of_stage).alias("code")))
    return out.unionByName(programs.select(*keys, F.lit(None).cast(predicates.schema["stage"].dataType).alias("stage"), F.explode(of_program).alias("code")))


@dataclass
class Policy:
    """When a recording starts, what stays before its origin, when it is complete, and what happens if no trigger comes.

    ``start`` is immediate or trigger. Before the origin stay ``before_ns``, or the share ``placement`` of ``total_ns``; with
    neither, everything. The recording is complete ``after_ns`` after the origin, or at the last row. Of a key without a
    trigger until ``timeout_ns`` after its first row the recording goes on waiting (``wait``), is dropped (``stop``) or
    has its origin at that time (``force``).
    """

    start: str = "trigger"
    before_ns: int | None = None
    placement: float | None = None
    total_ns: int | None = None
    after_ns: int | None = None
    timeout_ns: int | None = None
    timeout: str = "wait"

    def check(self) -> None:
        if self.start not in ("immediate", "trigger") or self.timeout not in ("wait", "stop", "force"):
            raise StreamError(f"unknown start {self.start} or timeout {self.timeout}")
        if self.placement is not None and (self.total_ns is None or not 0 <= self.placement <= 1):
            raise StreamError("a placement from 0 to 1 needs the total")
        if self.timeout != "wait" and self.timeout_ns is None:
            raise StreamError("a timeout needs its time")


def origins(rows: DataFrame, triggers: DataFrame, keys: Sequence[str], policy: Policy) -> DataFrame:
    """keys, trigger_ns: where the recording of each key of ``rows`` begins by ``policy``; keys that never begin are left out."""
    policy.check()
    first = rows.groupBy(*keys).agg(F.min(TS).alias("_first"))
    if policy.start == "immediate":
        return first.select(*keys, F.col("_first").alias("trigger_ns"))
    found = same_parts(first, triggers.groupBy(*keys).agg(F.min("trigger_ns").alias("_at")), keys, "left")
    at = F.col("_at")
    if policy.timeout != "wait":
        limit = F.col("_first") + policy.timeout_ns
        in_time = F.when(F.col("_at") <= limit, F.col("_at"))
        at = F.coalesce(in_time, limit) if policy.timeout == "force" else in_time
    return found.select(*keys, at.alias("trigger_ns")).where("trigger_ns is not null")


def record(rows: DataFrame, triggers: DataFrame, keys: Sequence[str], policy: Policy) -> DataFrame:
    """The rows that ``policy`` records."""
    began = origins(rows, triggers, keys, policy)
    before = 0 if policy.start == "immediate" else policy.before_ns
    return slice_capture(rows, began, keys, before, policy.after_ns, policy.placement if policy.start == "trigger" else None, policy.total_ns)


def channel_rows(channels: Sequence[DataFrame], keys: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """One row for each instant at which a channel changes, with all channels as v0, v1, ... and before as b0, b1, ..."""
    rows = along(merged(channels, keys, bucket_ns=bucket_ns), keys, {"_next": after(TS)}, ["_input"], bucket_ns)
    rows = rows.where(F.col("_next").isNull() | (F.col("_next") != F.col(TS))).drop("_next", "_input")
    return along(rows, keys, {f"b{i}": before(f"v{i}") for i in range(len(channels))}, bucket_ns=bucket_ns)


def stage_match(stage: Stage) -> Column:
    """Whether a row of :func:`channel_rows` meets the stage's conditions."""
    met = [condition(v, F.col(f"v{c}"), F.col(f"b{c}")) for c, v in stage.conditions.items()]
    return gate_of(met, stage.join) != F.lit(stage.inverted)


def find_trigger(rows: DataFrame, keys: Sequence[str], program: Program, channels: int, bucket_ns: int | None = None) -> DataFrame:
    """keys, trigger_ns: the first instant of each key at which all stages have been met one after the other.

    A stage looks only at instants after the one that completed the stage before it. Counting occurrences counts
    where its match begins, counting consecutive ones counts adjacent matching rows. ``rows`` has one row for each instant
    of a key, as :func:`channel_rows` gives them. All stages are one pass over rows sorted once (:func:`.stages.completions`).
    """
    if problems := program.problems(channels):
        raise StreamError("; ".join(problems))
    met = [F.when(F.coalesce(stage_match(s), F.lit(False)), 1 << k).otherwise(0) for k, s in enumerate(program.stages)]
    counted = [Counted(s.count, s.counting == "consecutive" and s.count > 1) for s in program.stages]
    return completions(rows.withColumn("_m", reduce(lambda x, y: x + y, met)), keys, counted, bucket_ns)


def slice_capture(
    rows: DataFrame, triggers: DataFrame, keys: Sequence[str], before_ns: int | None = None, after_ns: int | None = None, placement: float | None = None, total_ns: int | None = None
) -> DataFrame:
    """Rows from ``before_ns`` before the trigger to below ``after_ns`` after it; or ``total_ns`` with the trigger at a share of them."""
    if placement is not None:
        if total_ns is None or not 0 <= placement <= 1:
            raise StreamError("a placement from 0 to 1 needs the total")
        before_ns = int(total_ns * placement)
        after_ns = total_ns - before_ns
    found = same_parts(rows, triggers.select(*keys, "trigger_ns"), keys)
    kept = F.lit(True)
    if before_ns is not None:
        kept = kept & (F.col(TS) >= F.col("trigger_ns") - before_ns)
    if after_ns is not None:
        kept = kept & (F.col(TS) < F.col("trigger_ns") + after_ns)
    return found.where(kept).drop("trigger_ns")


def samples_of(duration_ns: int, samplerate_hz: int) -> int:
    """Samples that cover a duration, rounded up."""
    return -(-duration_ns * samplerate_hz // 1_000_000_000)


def retain_recent(rows: DataFrame, keys: Sequence[str], recent_ns: int, pins: DataFrame | None = None) -> DataFrame:
    """Rows of each key no older than ``recent_ns`` before its last, or than its pin (``pin_ns``) if that is earlier."""
    last = rows.groupBy(*keys).agg((F.max(TS) - recent_ns).alias("_from"))
    if pins is not None:
        last = same_parts(last, pins.groupBy(*keys).agg(F.min("pin_ns").alias("pin_ns")), keys, "left").select(*keys, F.least("_from", "pin_ns").alias("_from"))
    return same_parts(rows, last, keys).where(F.col(TS) >= F.col("_from")).drop("_from")


def retain_bytes(blocks: DataFrame, keys: Sequence[str], most_bytes: int, order: str = "block") -> DataFrame:
    """The latest blocks of each key of at most ``most_bytes`` in all."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_held", F.sum(F.length("data")).over(w)).where(F.col("_held") <= most_bytes).drop("_held")


def retain_rolling(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """A key of more than ``most`` rows is cut to its last ``most - most / 4``."""
    counts = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(TS), F.desc(SEQ)))
    return rows.withColumns({"_all": counts, "_n": newest}).where((F.col("_all") <= most) | (F.col("_n") <= most - most // 4)).drop("_all", "_n")
