"""What the operators on vectors share: which vectors take part, and how their components become integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null, NaN nor infinite components; empty vectors are."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def quantized(vector: Column, scale: int, shift: int = 0) -> Column:
    """The components floor(scale * c) + shift, c as double, as longs; a component that a long can't hold raises."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` longs, without nulls, as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as a column of lists."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims, pa.int32()), pa.array(rows.reshape(-1), kind))
