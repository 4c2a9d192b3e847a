"""Arrow batches in tasks: bounded by bytes in the worker, so that no session setting has to change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker handles at once; one longer text is handled alone.
BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` has about ``size`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        turn = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield batch.slice(begin, end - begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; nulls are empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def long_id(column: str):
    """An id column as a long, whatever its type; what is no number is null."""
    from pyspark.sql import functions as F

    return F.col(column).try_cast("long")
