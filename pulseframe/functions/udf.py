"""User operators: a function over a key's ordered rows, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.timeline import pieces, scan_sorted
from ..schema import SEQ, TS, require
from ..streaming.ordered import Finish, Step, apply_ordered


def stream_udf(function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, inputs: Sequence[str] = ()) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """An operator ``op(stream, keys)`` that applies ``function`` to each key's rows in time order.

    A key's rows are one group in memory; for timelines of any length write the operator as a step
    (:func:`stream_step`), as a fold (:func:`stream_fold`) or with the timeline formulations.
    """

    def operator(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
        require(stream, keys, *inputs)
        return stream.groupBy(*keys).applyInPandas(lambda rows: function(rows.sort_values([TS, SEQ])), schema)

    return operator


def stream_fold(
    function: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: T.StructType | str, inputs: Sequence[str] = (), finish: Callable[[dict], pd.DataFrame] | None = None
) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """An operator ``op(stream, keys)`` whose ``function(state, rows)`` gets each key's rows in time order, piece by piece.

    Only a piece and ``state``, a dict that is empty where a key begins, are in memory; how a key falls into pieces is not fixed. ``finish(state)`` is
    asked at a key's end. Both return rows of ``schema``, to which the keys are added. Whole numbers beside nulls are objects, so that none is rounded.
    """
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def operator(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        require(stream, keys, *inputs)
        given = T.StructType([stream.schema[k] for k in keys])
        table = to_arrow_schema(own)

        def with_keys(first: pa.RecordBatch, rows: pd.DataFrame) -> pa.RecordBatch:
            out = pa.RecordBatch.from_pandas(rows, schema=table, preserve_index=False)
            ids = first.select(list(keys)).take(pa.array([0] * out.num_rows, pa.int64())).columns if keys else []
            return pa.RecordBatch.from_arrays([*ids, *out.columns], names=[*keys, *table.names])

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            held = None
            for first, piece in pieces(batches, keys):
                if first:
                    if held is not None and finish is not None:
                        yield with_keys(held, finish(state))
                    state, held = {}, piece.slice(0, 1)
                yield with_keys(held, function(state, piece.to_pandas(integer_object_nulls=True)))
            if held is not None and finish is not None:
                yield with_keys(held, finish(state))

        return scan_sorted(stream, keys, [TS, SEQ], fold, T.StructType([*given, *own]))

    return operator


def stream_step(
    step: Step, payload: str, late: str = "drop", finish: Finish | None = None, idle_ms: int | None = None, inputs: int = 1
) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """An operator ``op(rows, keys)`` over a streaming table in the form of ``stream_rows`` that applies ``step`` in time order.

    The options are those of ``apply_ordered``.
    """
    return lambda rows, keys: apply_ordered(rows, keys, step, payload, late=late, finish=finish, idle_ms=idle_ms, inputs=inputs)
