"""Vectors as whole numbers, for the operators that need exact sums and products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest absolute component, after scaling: squares of differences and products of a few thousand components fit 64 bits.
MOST = 1 << 26


def usable(vector: Column) -> Column:
    """True for a vector that isn't null and whose components are all finite."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component as array<int>. A component beyond MOST is an error: its squares have no place in 64 bits."""
    def one(x: Column) -> Column:
        whole = F.floor(F.lit(float(factor)) * x.cast("double"))
        return F.when(F.abs(x.cast("double")) <= MOST / factor, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // factor}")).cast("bigint")).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64; missing components of shorter vectors are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out
