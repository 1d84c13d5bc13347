"""Rows that Python makes of files, handed on in batches of bounded size: a task holds one file's rows and one batch, however many files Spark passes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in a batch.
ROWS = 10_000


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int | None = None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= (most or ROWS):
            yield _packed(held, schema)
            held = []
    if held:
        yield _packed(held, schema)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def map_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What `make` gives for a partition's rows, as a DataFrame; both sides are passed row by row."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: in_batches(make(cells(batches)), arrow), schema)
