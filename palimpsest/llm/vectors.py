"""Vector columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """True where a vector is there and all its components are finite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column in double precision; shorter rows are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (a, n) in enumerate(zip(offsets, sizes)):
        out[i, :n] = flat[a : a + n]
    return out
