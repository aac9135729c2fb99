"""Python over Arrow batches, a slice at a time: a batch has up to ten thousand texts, and as Python objects they take many times their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts that are Python objects at once.
SLICE = 256


def by_slices(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row of the columns."""
    cut = lambda at: zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)
    parts = [pa.array([one(*row) for row in cut(at)], kind) for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def exploded(df: DataFrame, keep: list[str], text: Column, rows_of: Callable[[str | None], Iterable[tuple]], kinds: str) -> DataFrame:
    """``keep`` and the columns ``kinds`` of every row that ``rows_of`` gives for the text of a row of ``df``."""
    new = StructType.fromDDL(kinds)
    schema = StructType([*(df.schema[k] for k in keep), *new.fields])
    types, n = [to_arrow_type(f.dataType) for f in new.fields], len(keep)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                place, found = [], []
                for i, t in enumerate(b.column(n).to_pylist()):
                    own = list(rows_of(t))
                    place += [i] * len(own)
                    found += own
                if found:
                    at_ = pa.array(place, pa.int64())
                    values = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(at_) for k in range(n)), *values], names=schema.names)
        pa.default_memory_pool().release_unused()

    return df.select(*keep, text.alias("_text")).mapInArrow(batches, schema)
