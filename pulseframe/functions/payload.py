"""Payloads of any shape on a stream: rows carry the type's id and the payload as VARIANT, and are read back by type or by path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEQ, TS, StreamError, require


@dataclass(frozen=True)
class PayloadType:
    """A payload with an id that stays the same wherever it is stored, and its fields."""

    id: str
    fields: T.StructType

    def __post_init__(self) -> None:
        if not self.id or any(c.isspace() for c in self.id):
            raise StreamError(f"a payload id is a word: {self.id!r}")


def with_payload(stream: DataFrame, keys: Sequence[str], kind: PayloadType, value: Column | None = None) -> DataFrame:
    """keys, ts_ns, seq, payload_type, payload (VARIANT) of a stream whose columns (or the struct ``value``) are the payload's fields.

    Tables of several types are one table: a type that is added later needs no change of those that are written.
    """
    require(stream, keys, *(() if value is not None else kind.fields.fieldNames()))
    held = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields)) if value is None else value
    return stream.select(*keys, TS, SEQ, F.lit(kind.id).alias("payload_type"), F.to_variant_object(held).alias("payload"))


def field(path: str, kind: str) -> Column:
    """What lies at a path of the payload (``$.a.b``, ``$.list[0]``), null where there is none or it is no such ``kind``."""
    return F.try_variant_get("payload", path, kind)


def payloads_of(stored: DataFrame, keys: Sequence[str], kind: PayloadType) -> DataFrame:
    """The rows of one payload type with its fields as columns; other types are passed over, a field that a row lacks is null."""
    fields = [F.try_variant_get("payload", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in kind.fields]
    return stored.where(F.col("payload_type") == kind.id).select(*keys, TS, SEQ, *fields)
