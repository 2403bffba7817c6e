"""Operators on word streams: decoded numbers or payloads with a start and a duration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unsigned import bit_field, compare, flipped, signed
from ..schema import SEQ, TS, StreamError, require
from .events import pulse_lane, restarts
from .timeline import after, along, as_of, before, count, greedy, held_off, highest, last_part, number_within, part_codes, scan_sorted, total

ALL = (1 << 64) - 1
#: Longest end that an instantaneous word is given.
MAX_ANNOTATION_NS = 100_000_000


def matches(operator: str, pattern: int | Column, mask: int | Column = ALL, value: Column | None = None) -> Column:
    """(value & mask) OP (pattern & mask), unsigned."""
    value = F.col("value") if value is None else value
    mask = F.lit(signed(mask)) if isinstance(mask, int) else mask
    pattern = F.lit(signed(pattern)) if isinstance(pattern, int) else pattern
    return compare(value.bitwiseAND(mask), operator, pattern.bitwiseAND(mask))


def in_range(low: int, high: int, mask: int = ALL) -> Column:
    """Masked value within the masked bounds, both included; none if they are the wrong way round."""
    value = flipped(F.col("value").bitwiseAND(F.lit(signed(mask))))
    return value.between(*(flipped(F.lit(signed(x & mask))) for x in (low, high)))


def parse_set(text: str) -> list[int]:
    """Comma-separated decimal or 0x numbers."""
    try:
        return [int(x.strip(), 0) for x in text.split(",") if x.strip()]
    except ValueError as e:
        raise StreamError(f"not a list of numbers: {text}") from e


def in_set(candidates: Sequence[int] | str, mask: int = ALL) -> Column:
    """Masked value equal to a masked candidate."""
    numbers = parse_set(candidates) if isinstance(candidates, str) else candidates
    return F.col("value").bitwiseAND(F.lit(signed(mask))).isin([signed(x & mask) for x in numbers])


def semi_in_set(words: DataFrame, candidates: DataFrame, mask: int = ALL) -> DataFrame:
    """As :func:`in_set` for a table ``candidates(value)`` of any size."""
    masked = lambda c: F.col(c).bitwiseAND(F.lit(signed(mask)))
    own = candidates.select(masked("value").alias("_masked")).distinct()
    return words.withColumn("_masked", masked("value")).join(own, "_masked", "left_semi").drop("_masked")


def match_words(
    words: DataFrame, keys: Sequence[str], predicate: Column, at: str = "end", every: int = 1, holdoff_ns: int = 0, rearms: DataFrame | None = None, bucket_ns: int | None = None
) -> DataFrame:
    """Matching words with ``match_ns``, the word's start or end.

    Of eligible matches every n-th counts. After a counted match others are passed over until ``holdoff_ns`` have
    gone by, without counting; a match earlier than the one before is passed over too. With ``rearms`` a counted
    match disarms until a rearm at or before a later word's start, which also restarts the count to n.

    Timelines restart at rearms that come later than the hold-off after every match before, so that pieces of one key go
    to different tasks. With ``bucket_ns`` hold-offs at starts share also a timeline that never pauses. Without rearms only n-th matches with a hold-off or at ends are told by
    one scan of each key, and single ones with a hold-off at ends.
    """
    if at not in ("start", "end") or every < 1:
        raise StreamError("at is start or end, every is 1 or more")
    require(words, keys, "value", "duration_ns")
    when = F.col(TS) + (F.col("duration_ns") if at == "end" else 0)
    found = words.where(predicate).withColumn("match_ns", when)
    if rearms is None and not holdoff_ns and at == "start":
        counted = along(found, keys, {"_n": count()}, bucket_ns=bucket_ns) if every > 1 else None
        return found if counted is None else counted.where(F.col("_n") % every == 0).drop("_n")
    if rearms is None and every == 1 and not holdoff_ns:
        # a match counts if none before it, counted or not, is later
        return along(found, keys, {"_highest": highest("match_ns")}, bucket_ns=bucket_ns).where(F.col("match_ns") == F.col("_highest")).drop("_highest")
    if every == 1 and holdoff_ns and at == "start":
        if rearms is None:
            return greedy(found, keys, holdoff_ns, bucket_ns=bucket_ns)
        if bucket_ns is not None:
            both = found.withColumn("_side", F.lit(1)).unionByName(rearms.select(*keys, TS, SEQ).withColumn("_side", F.lit(0)), allowMissingColumns=True)
            return held_off(both, keys, F.lit(holdoff_ns), bucket_ns, rearmed=True).drop("_side")
    rows, manual = found.withColumn("_side", F.lit(1)), rearms is not None
    if manual:
        rows = rows.unionByName(rearms.select(*keys, TS, SEQ).withColumn("_side", F.lit(0)), allowMissingColumns=True)
        rows = restarts(rows, keys, "match_ns", holdoff_ns, bucket_ns)
    else:
        rows = rows.withColumn("_piece", F.lit(0).cast("long"))
    names, parts = list(rows.columns), [*keys, "_piece"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, armed, counted, allowed = None, True, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, take = part_codes(batch, parts), []
            new[0] = last_part(batch, parts, 0) != part
            for first, t, side in zip(new.tolist(), batch.column(names.index("match_ns")).to_pylist(), batch.column(names.index("_side")).to_pylist(), strict=True):
                if first:
                    armed, counted, allowed = True, 0, None
                ok = False
                if side == 0:
                    armed, counted = True, 0
                elif armed and (allowed is None or t >= allowed):
                    counted += 1
                    ok = counted == every
                if ok:
                    counted, allowed, armed = 0, t + holdoff_ns, not manual
                take.append(ok)
            part = last_part(batch, parts, batch.num_rows - 1)
            yield batch.filter(pa.array(take, pa.bool_()))

    return scan_sorted(rows, parts, [TS, "_side", SEQ], choose, rows.schema).drop("_side", "_piece")


def match_lane(found: DataFrame, keys: Sequence[str] = (), pulse_ns: int = 1000) -> DataFrame:
    """The pulse lane of matches from :func:`match_words`."""
    return pulse_lane(found.select(*keys, F.col("match_ns").alias(TS), SEQ), keys, pulse_ns)


def timed_matches(words: DataFrame, settings: DataFrame, keys: Sequence[str], operator: str, bucket_ns: int | None = None) -> DataFrame:
    """Words that match the settings (pattern, mask) in force at their start; a setting at the start counts."""
    found = as_of(words, settings, keys, {"pattern": "_pattern", "mask": "_mask"}, bucket_ns=bucket_ns)
    return found.where(matches(operator, F.col("_pattern"), F.col("_mask"))).drop("_pattern", "_mask")


def extract_field(words: DataFrame, first_bit: int, bit_count: int) -> DataFrame:
    """Words cut to some bits of their value, or of their byte payload read as one big-endian bit string.

    Up to 64 bits give a number; more give bytes, with their low 64 bits as the value. Spans stay.
    """
    if bit_count < 1 or first_bit < 0:
        raise StreamError("a field has one bit or more")
    plain = bit_field(F.col("value"), first_bit, bit_count) if bit_count <= 64 else F.col("value")
    columns = {"value": plain, "payload_text": F.lit(None).cast("string"), "payload_bytes": F.lit(None).cast("binary")}
    if "payload_bytes" in words.columns:
        has = F.col("payload_bytes").isNotNull()
        digits = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.greatest(F.length("payload_bytes"), F.lit(1))), lambda i: F.lpad(F.conv(F.hex(F.substring(F.col("payload_bytes"), i, F.lit(1))), 16, 2), 8, "0")))
        bits = F.substring(digits, first_bit + 1, bit_count)
        low = F.conv(F.substring(bits, max(bit_count - 63, 1), 64), 2, -10).cast("long")
        columns["value"] = F.when(has, low).otherwise(plain)
        if bit_count > 64:
            wide = -(-bit_count // 8)
            padded = F.lpad(bits, wide * 8, "0")
            columns["payload_bytes"] = F.when(has, F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")))))
    return words.withColumns({k: v for k, v in columns.items() if k in words.columns})


def word_ends(words: DataFrame, keys: Sequence[str] = (), most_ns: int = MAX_ANNOTATION_NS, bucket_ns: int | None = None) -> DataFrame:
    """Words with ``end_ns``: the explicit end, or for instantaneous ones the next start, at most the interval before and ``most_ns`` away."""
    rows = along(words, keys, {"_next": after(TS), "_last": before(TS)}, bucket_ns=bucket_ns)
    gap, last = F.col("_next") - F.col(TS), F.col(TS) - F.col("_last")
    lent = F.when(gap.isNull(), 0).otherwise(F.coalesce(F.least(gap, F.coalesce(last, gap), F.lit(most_ns)), F.lit(0)))
    return rows.withColumn("end_ns", F.col(TS) + F.when(F.col("duration_ns") > 0, F.col("duration_ns")).otherwise(lent)).drop("_next", "_last")


def frame_packets(
    words: DataFrame,
    keys: Sequence[str] = (),
    fixed: int | None = None,
    delimiter: Column | None = None,
    include_delimiter: bool = True,
    max_gap_ns: int | None = None,
    max_words: int = 4096,
    boundaries: DataFrame | None = None,
    gate: DataFrame | None = None,
    active_high: bool = True,
    bucket_ns: int | None = None,
) -> DataFrame:
    """Words framed into packets: start_ns, end_ns, n_words, words (value, start_ns, end_ns in order).

    A packet ends after ``fixed`` or ``max_words`` words, at a delimiter (kept or left out), before a pause of
    more than ``max_gap_ns``, before a word at or after a boundary event, and when the gate becomes inactive;
    words while it is inactive are dropped. What is left at the end is a packet too. No packet is longer than
    ``max_words``, so that no list grows without bound.
    """
    require(words, keys, "value", "duration_ns")
    rows, marks = words, []
    if gate is not None:
        active = F.coalesce("value", F.lit(False)) == F.lit(active_high)
        offs = gate.where(~active).select(*keys, TS, SEQ)
        rows = as_of(rows, gate.withColumnRenamed("value", "_g"), keys, {"_g": "_gate"}, bucket_ns=bucket_ns)
        rows = rows.where(F.coalesce("_gate", F.lit(False)) == F.lit(active_high)).drop("_gate")
        marks.append(offs)
    if boundaries is not None:
        marks.append(boundaries.select(*keys, TS, SEQ))
    own = rows.withColumns({"_side": F.lit(2), "_delimits": F.lit(False) if delimiter is None else F.coalesce(delimiter, F.lit(False))})
    if marks:
        for k, mark in enumerate(marks):
            own = own.unionByName(mark.withColumn("_side", F.lit(k)), allowMissingColumns=True)
        own = along(own, keys, {"_marks": total(F.col("_side") < 2)}, ["_side"], bucket_ns).where("_side = 2")
    else:
        own = own.withColumn("_marks", F.lit(0).cast("long"))
    last = F.struct("_marks", "_delimits", (F.col(TS) + F.col("duration_ns")).alias("end"))
    own = along(own, keys, {"_last": before(last)}, bucket_ns=bucket_ns)
    cut = (F.col("_marks") != F.col("_last._marks")) | F.col("_last._delimits")
    if max_gap_ns is not None:
        cut = cut | (F.col(TS) - F.col("_last.end") > max_gap_ns)
    own = own.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    kept = ~F.col("_delimits") if not include_delimiter else None
    own = number_within(own, keys, F.col("_cut"), "_n", (), bucket_ns, kept)
    own = along(own, keys, {"_segment": total("_cut")}, bucket_ns=bucket_ns)
    if kept is not None:
        own = own.where(kept)
    size = min(fixed or max_words, max_words)
    own = own.withColumn("_chunk", F.floor(F.col("_n") / size))
    payload = [c for c in ("payload_bytes", "payload_text") if c in words.columns]
    item = F.struct(F.col(TS).alias("start_ns"), F.col(SEQ).alias("seq"), (F.col(TS) + F.col("duration_ns")).alias("end_ns"), "value", *payload)
    packets = own.groupBy(*keys, "_segment", "_chunk").agg(F.sort_array(F.collect_list(item)).alias("words"))
    return packets.select(
        *keys,
        F.col("words")[0]["start_ns"].alias("start_ns"),
        F.element_at("words", -1)["end_ns"].alias("end_ns"),
        F.size("words").cast("long").alias("n_words"),
        F.lit("word_packet").alias("protocol"),
        F.transform("words", lambda x: F.struct(x["value"].alias("value"), x["start_ns"].alias("start_ns"), x["end_ns"].alias("end_ns"), *(x[p].alias(p) for p in payload))).alias("words"),
    )


def word_statistics(words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, first and last start, and extent (largest end) of each key's words."""
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_words"), F.min(TS).alias("first_ns"), F.max(TS).alias("last_ns"), F.max(F.col(TS) + F.col("duration_ns")).alias("extent_ns")
    )


__all__ = [
    "extract_field", "frame_packets", "in_range", "in_set", "match_lane", "match_words", "matches", "parse_set", "semi_in_set",
    "timed_matches", "word_ends", "word_statistics",
]
