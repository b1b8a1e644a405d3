"""Vector expressions and the Arrow/numpy conversions shared by vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy; a zero vector is returned unchanged."""
    return F.transform(unit_double(vector), lambda x: x.cast("float"))


def unit_double(vector: Column) -> Column:
    """Unit-length copy in double precision.

    The norm is repeated into an array first: written inside the lambda it
    would be computed again for every component.
    """
    norm = l2_norm(vector)
    divisor = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.zip_with(
        vector, F.array_repeat(divisor, F.size(vector)), lambda x, n: x.cast("double") / n
    )


def norm_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Minimum, maximum and mean norm in one pass."""
    norm = l2_norm(F.col(column))
    return vectors.select(norm.alias("norm")).agg(
        F.count("*").alias("vectors"),
        F.min("norm").alias("min_norm"),
        F.max("norm").alias("max_norm"),
        F.avg("norm").alias("mean_norm"),
    )


def to_matrix(column) -> np.ndarray:
    """Arrow list column of equal-length vectors to an ``(n, d)`` double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError(f"{column.null_count} vectors are NULL")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if rows and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, int(lengths[0]) if rows else 0)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def from_matrix(matrix: np.ndarray, value_type=pa.float32()) -> pa.Array:
    """``(n, d)`` matrix to an Arrow list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1)).cast(value_type)
    return pa.ListArray.from_arrays(offsets, values)
