"""Embedding columns: which vectors are sound, and their components as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(column: str) -> Column:
    """True if the vector is there and all its components are finite numbers."""
    vector = F.col(column).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.col(column).isNotNull() & finite


def vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and embedding (array of double) of the sound rows; no further column."""
    kept = df.where(sound(vector_column) & F.col(id_column).isNotNull())
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))


def dimension(sound_vectors: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as filled up with zeros."""
    return max(1, sound_vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of `dim` doubles."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    mask = np.arange(dim)[None, :] < lengths[:, None]
    out[mask] = flat
    return out
