"""Vectors in DataFrames: which take part, and how Arrow lists become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str | Column) -> Column:
    """True for vectors that are not null or empty, not all zero and have only finite components."""
    v = F.col(col) if isinstance(col, str) else col
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def common_size(df: DataFrame, col: str) -> int:
    """The most frequent length of the vectors (the least of equals), 0 without rows. Others take no part."""
    top = df.groupBy(F.size(col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    return top["d"] if top else 0


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), size)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1))[: n + 1], pa.int32()), pa.array(values.reshape(-1), kind))
