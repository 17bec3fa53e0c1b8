"""What the vector operators share: validity and blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part; no other column is read."""
    vec = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.coalesce(usable(F.col("vec")), F.lit(False)))


def digest(vector: str) -> tuple[Column, Column]:
    """``d1`` and ``d2``, two 64-bit hashes by which equal vectors are found."""
    return F.xxhash64(vector).alias("d1"), F.xxhash64(F.lit(1), vector).alias("d2")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))
