"""Vectors as rows of doubles in bytes, their copies, and statistics that Spark adds up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(raw: DataFrame, vector: str, width: int) -> DataFrame:
    """(id, key, vec) for ``raw`` (id, ``vector``): doubles in bytes, padded with zeros to ``width``.

    key and vec are null for a vector that is null, zero or holds null or non-finite components.
    """
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for value in batch.column("vec").to_pylist():
                row = np.zeros(width)
                if value and None not in value:
                    row[: len(value)] = value
                good = bool(np.isfinite(row).all() and row.any())
                vecs.append((row + 0.0).tobytes() if good else None)  # -0.0 equals 0.0
                keys.append(hashlib.md5(vecs[-1]).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], schema=schema
            )

    return raw.select(
        F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    ).mapInArrow(run, "id long, key binary, vec binary")


def width_of(raw: DataFrame, vector: str) -> int:
    return max(int(raw.agg(F.max(F.size(vector))).first()[0] or 0), 1)


def matrix(column) -> np.ndarray:
    """A matrix of the doubles in a column of bytes."""
    values = list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def second_moments(vectors: DataFrame, width: int, unit: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Count, sum, sum of products and largest norm of ``vec``; the driver gets one number per matrix cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, largest = np.zeros((width + 1, width + 1)), 0.0
        for batch in batches:
            x = matrix(batch.column("vec").to_pylist())
            if not len(x):
                continue
            norms = np.linalg.norm(x, axis=1)
            largest = max(largest, float(norms.max()))
            x = np.hstack([np.ones((len(x), 1)), x / norms[:, None] if unit else x])
            sums += x.T @ x
        yield pa.RecordBatch.from_pydict(
            {
                "cell": pa.array(np.arange(sums.size + 1), pa.int32()),
                "value": pa.array(np.append(sums.ravel(), largest), pa.float64()),
            }
        )

    cells = vectors.select("vec").mapInArrow(partial, "cell int, value double")
    out, largest = np.zeros((width + 1) ** 2), 0.0
    for cell, total, top in cells.groupBy("cell").agg(F.sum("value"), F.max("value")).collect():
        if cell < len(out):
            out[cell] = total
        else:
            largest = top
    out = out.reshape(width + 1, width + 1)
    return float(out[0, 0]), out[0, 1:], out[1:, 1:], float(largest)
