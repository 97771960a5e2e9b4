"""Which vectors take part in searches and links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True where a vector has components, none of them null or non-finite, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose vectors have equal lengths, as rows of doubles."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-320)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-320)
