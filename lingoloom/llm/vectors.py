"""Vectors of whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components beyond this magnitude count as it, so that products and squares of 256 components fit 63 bits.
LIMIT = 1 << 26


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as array<int>; null for a null vector and for one with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    near = lambda x: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * float(scale)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(near(x)).cast("int")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """array<int> rows as a matrix of int64; shorter rows count as padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of a with rows of b, exactly: in doubles where every sum stays below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows of a to rows of b, exactly."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * products(a, b)
