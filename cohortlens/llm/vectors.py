"""Vector columns shared by the lattice and curve operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector_column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """``vec_id, vec`` (doubles) of the rows that take part.

    Left out are null ids, null or empty vectors, vectors with a null, NaN or
    infinite component, and zero vectors.
    """
    vec = F.col(vector_column).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
            .where(fine & F.exists("vec", lambda x: x != 0)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rotation(dim: int, parts: int, seed: int) -> np.ndarray:
    """Random orthonormal directions, dim x parts; directions beyond dim are zero."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    out = np.zeros((dim, parts))
    out[:, :min(dim, parts)] = q[:, :parts]
    return out
