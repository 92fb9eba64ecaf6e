"""Columns computed by Python a few rows of an Arrow batch at a time, so that a worker never holds a batch's texts as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

ROWS = 64


def structs(row: Callable[[str | None], tuple], form: pa.StructType, texts: pa.Array) -> pa.Array:
    """Array of ``form``: the values that ``row`` gives for each text."""
    parts = [pa.array([], type=form)]
    for k in range(0, len(texts), ROWS):
        rows = [row(x) for x in texts.slice(k, ROWS).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], fields=list(form)))
    return pa.concat_arrays(parts)


def struct_of(row: Callable[[str | None], tuple], kind: str, text: Column) -> Column:
    """Struct column of ``kind`` (a DDL list of fields): ``row`` of each text, null included, gives the fields' values."""
    fields = StructType.fromDDL(kind)

    @F.arrow_udf(fields)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield structs(row, to_arrow_type(fields), texts)
            del texts
            pa.default_memory_pool().release_unused()

    return of.asNondeterministic()(text)  # else each field that is read computes it anew
