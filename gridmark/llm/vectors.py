"""Rows of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, not empty, without null, NaN or infinite components, and not zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(df: DataFrame, vec: str, id: str) -> DataFrame:
    """``(uid, id, dim, vec)``: a row number, the id, the length, the vector as doubles (null: not usable)."""
    v = F.when(usable(vec), F.col(vec).cast("array<double>"))
    return df.select(F.monotonically_increasing_id().alias("uid"), F.col(id).alias("id"), F.coalesce(F.size(v), F.lit(0)).cast("long").alias("dim"), v.alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, without overflow or underflow on the way."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1
    y = x / top[:, None]
    return np.sqrt((y * y).sum(1)) * top


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1
    y = x / top[:, None]
    return y / np.sqrt((y * y).sum(1))[:, None]
