"""Add columns computed in Python from one text column, in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesmart.llm.steps import column as named_column

#: Bytes of text handed to Python code at once; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20

def give_back() -> None:
    """Return freed memory to the machine: a worker lives on and does other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Compute = Callable[[pa.Array], list[pa.Array]]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece of several rows has more than ``limit`` bytes of text."""
    values = batch.column(column)
    nested = pa.types.is_list(values.type)
    length = pc.list_value_length if nested else pc.binary_length
    sizes = pc.multiply(length(values), 8 if nested else 1).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + (size or 0) > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def with_columns(
    frame: DataFrame, column: str, added: T.StructType, setup: Callable[[], Compute]
) -> DataFrame:
    """``frame`` with the columns ``added``, computed from ``column``.

    ``setup`` runs once in a task and returns the function that maps an Arrow array of the column's
    values to one array for each added column. A column of ``frame`` with the name of an added one is replaced.
    """
    names = {f.name.lower() for f in added}
    if column.lower() in names:
        raise ValueError(f"{column} is read and cannot be replaced")
    kept = [f for f in frame.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, *added])
    # Plain names on the way to Python: PySpark looks columns up by their unquoted names.
    plain = [f"c{k}" for k in range(len(kept))]
    read = plain[[f.name.lower() for f in kept].index(column.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = setup()
        for batch in batches:
            for part in slices(batch, read):
                columns = compute(part.column(read))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], names=[f.name for f in schema]
                )
        del compute
        give_back()

    named = (named_column(f.name).alias(c) for f, c in zip(kept, plain, strict=True))
    return frame.select(*named).mapInArrow(run, schema)
