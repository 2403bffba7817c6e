"""Text levels made from number levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import template_text
from ..schema import SEQ, TS
from .timeline import along, as_of, before, count, merged


def text_formatter(inputs: Sequence[DataFrame], keys: Sequence[str], template: str, bucket_ns: int | None = None) -> DataFrame:
    """A template over number levels: ``{i}``, ``{i:0W}`` zero-padded, ``{n}`` for input 0; other braces stay.

    One input gives a row for each of its rows. Several are merged in time order with 0 before their first row,
    and a row is given where the text changes.
    """
    if len(inputs) == 1:
        return inputs[0].select(*keys, TS, SEQ, template_text(template, [F.col("value")]).alias("value"))
    rows = merged(inputs, keys, initial=F.lit(0).cast("long"), bucket_ns=bucket_ns)
    rows = rows.withColumn("value", template_text(template, [F.col(f"v{i}") for i in range(len(inputs))])).select(*keys, TS, SEQ, "_input", "value")
    rows = along(rows, keys, {"_before": before("value"), "_n": count()}, ["_input"], bucket_ns)
    return rows.where(~F.col("value").eqNullSafe(F.col("_before"))).select(*keys, TS, F.col("_n").alias(SEQ), "value")


def timed_formatter(numbers: DataFrame, templates: DataFrame, keys: Sequence[str], known: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """As :func:`text_formatter` of one input with the template in force at each row, out of ``known`` templates."""
    found = as_of(numbers, templates, keys, {"template": "_template"}, bucket_ns=bucket_ns)
    text = F.lit(None).cast("string")
    for t in known:
        text = F.when(F.col("_template") == t, template_text(t, [F.col("value")])).otherwise(text)
    return found.select(*keys, TS, SEQ, text.alias("value"))
