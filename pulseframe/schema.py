"""The stream tables and the checks at the entry of operators.

A stream is a DataFrame with key columns, which tell independent timelines apart, ``ts_ns`` (nanoseconds, LONG)
and ``seq`` (LONG, breaks ties of time). Levels add ``value``, which holds until the key's next row; events have
no payload; words add ``duration_ns`` and an unsigned 64-bit ``value`` held in a LONG.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TS, SEQ = "ts_ns", "seq"


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in pairs]


def stream(keys: Sequence[T.StructField], *payload: tuple[str, T.DataType]) -> T.StructType:
    """Schema of a stream with the given key fields and payload columns."""
    return T.StructType([*keys, *_fields((TS, T.LongType()), (SEQ, T.LongType()), *payload)])


def levels(keys: Sequence[T.StructField] = (), value: T.DataType | None = None) -> T.StructType:
    return stream(keys, ("value", value or T.BooleanType()))


def events(keys: Sequence[T.StructField] = ()) -> T.StructType:
    return stream(keys)


def words(keys: Sequence[T.StructField] = ()) -> T.StructType:
    return stream(
        keys, ("duration_ns", T.LongType()), ("value", T.LongType()), ("payload_bytes", T.BinaryType()), ("payload_text", T.StringType())
    )


BLOCKS = T.StructType(
    _fields(
        ("capture_id", T.StringType()),
        ("channel", T.IntegerType()),
        ("block", T.LongType()),
        ("start_pos", T.LongType()),
        ("n", T.IntegerType()),
        ("step_ns", T.LongType()),
        ("data", T.BinaryType()),
    )
)

CAPTURES = T.StructType(
    _fields(
        ("capture_id", T.StringType()),
        ("total_probes", T.IntegerType()),
        ("samplerate", T.StringType()),
        ("samplerate_hz", T.DoubleType()),
        ("total_samples", T.LongType()),
        ("total_blocks", T.LongType()),
        ("samples_per_block", T.LongType()),
        ("probe_names", T.ArrayType(T.StringType())),
        ("trigger_sample", T.LongType()),
    )
)


class StreamError(ValueError):
    """A table that an operator can't take, or parameters that contradict each other."""


def require(df: DataFrame, keys: Sequence[str], *columns: str) -> None:
    """Raise unless ``df`` has the keys, ts_ns, seq and ``columns``."""
    missing = [c for c in (*keys, TS, SEQ, *columns) if c not in df.columns]
    if missing:
        raise StreamError(f"missing columns {missing}; the table has {df.columns}")
