"""Arrow UDFs over the plain functions that no built-in expression can state.

A batch of rows stays in Arrow; values become Python objects a few at a time and their results leave at once, so what a
worker holds besides the batch doesn't grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Values that are Python objects at a time: so many, or so many characters or bytes and one value more.
AT_ONCE, AT_ONCE_BYTES = 256, 4 << 20


def _results(columns: tuple[pa.Array, ...], function: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """Results for a batch's rows, in parts."""
    out, size = [], 0
    for values in zip(*columns, strict=True):
        first, *more = (v.as_py() for v in values)
        found = None if first is None else function(first, *more)
        out.append(found)
        size += len(first) if isinstance(first, (str, bytes)) else 0
        if len(out) >= AT_ONCE or size >= AT_ONCE_BYTES:
            yield pa.array(out, kind)
            out, size = [], 0
    if out:
        yield pa.array(out, kind)


def _arrow_type(kind: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(kind))


def column(function: Callable, kind: str) -> Callable:
    """A column function of one argument; null stays null."""
    arrow = _arrow_type(kind)

    @F.arrow_udf(kind)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield from _results((values,), function, arrow)

    return each


def column2(function: Callable, kind: str) -> Callable:
    """Of two arguments; null if the first is."""
    arrow = _arrow_type(kind)

    @F.arrow_udf(kind)
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values in batches:
            yield from _results(values, function, arrow)

    return each


def struct2(function: Callable, fields: dict[str, str]) -> Callable:
    """Of two arguments, to a struct of the given fields; all of them null if the first argument or the result is."""
    kind = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields.items()))
    arrow = to_arrow_type(kind)
    none = dict.fromkeys(fields)

    @F.arrow_udf(kind)
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            # A null first argument gives a struct of nulls, not a null.
            yield from (part if part.null_count == 0 else pa.array([none if x is None else x for x in part.to_pylist()], arrow) for part in _results((a, b), function, arrow))

    return each
