"""Arrow batches in and out of tasks, kept small in bytes whatever the length of the texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a column of texts handled at once.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``limit`` bytes; a row stays whole."""
    values = batch.column(column)
    start, held = 0, 0
    for i, value in enumerate(values):
        buffer = value.as_buffer() if value.is_valid else None
        held += buffer.size if buffer is not None else 0
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return to the system what Arrow and the C library hold but no longer use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, giving memory back after the last batch of a task.

    The worker lives on beside the tasks of later stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def map_batches(
    df: DataFrame,
    column: str,
    function: Callable[[pa.RecordBatch], dict[str, Iterable]],
    schema: StructType,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """``mapInArrow`` with ``function`` on pieces of each batch; it returns the output columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                made = function(piece)
                columns = [
                    made[f.name]
                    if isinstance(made[f.name], pa.Array)
                    else pa.array(made[f.name], f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(tidied(run), schema)
