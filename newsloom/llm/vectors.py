"""Embedding rows as numbers: which of them take part, and their batches as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column | str) -> Column:
    """True for a vector without null, NaN or infinite components; false for null and empty ones."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    return F.coalesce(good & (F.size(v) > 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column without nulls as a matrix of doubles, short rows filled up with zeros, and the rows' own lengths."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    if (lengths == width).all():
        return matrix(column, width), lengths
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return rows, lengths


def filled(rows: list[list[float]], width: int) -> np.ndarray:
    return padded(pa.array(rows, pa.list_(pa.float64())), width)[0]


def consecutive(batches: Iterator[pa.RecordBatch], keys: list[str], make: Callable[[tuple, pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """make(key, rows) for each run of equal keys in sorted batches; only one run is held at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        while at < len(values):
            upto = at + 1
            while upto < len(values) and values[upto] == values[at]:
                upto += 1
            if values[at] != key:
                if held and (out := make(key, pa.Table.from_batches(held))) is not None:
                    yield out
                key, held = values[at], []
            held.append(batch.slice(at, upto - at))
            at = upto
    if held and (out := make(key, pa.Table.from_batches(held))) is not None:
        yield out
