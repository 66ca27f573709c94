"""What the operators over whole texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keelstone.session import prepare

#: Rows of an Arrow batch that are worked on at a time, and the bytes of text beyond
#: which fewer are; a longer text is worked on alone.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of bounded rows and bytes."""
    total = np.zeros(batch.num_rows + 1, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            total[1:] += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + size, "right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """The columns of each slice, as Python lists."""
    for batch in batches:
        for part in parts(batch, rows):
            yield [c.to_pylist() for c in part.columns]


def map_slices(df: DataFrame, work: Callable[[], Callable[..., list[pa.Array]]], schema: str) -> DataFrame:
    """Map df in slices: work() runs once a task and returns a function from
    the slice's columns to the output's columns. Narrow; memory is bounded by
    one Arrow batch."""
    prepare(df.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        fn = work()
        for cols in slices(batches):
            yield pa.RecordBatch.from_arrays(fn(*cols), names=names)

    return df.mapInArrow(run, schema)


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())
