"""Pearson correlations of numeric variables and cross-tabs of nominal ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import gram as G


def correlation_matrix(state: G.Gram) -> np.ndarray:
    sd = np.sqrt(np.diag(state.cross))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = state.cross / np.outer(sd, sd)
    np.fill_diagonal(r, np.where(sd > 0, 1.0, np.nan))
    return r


def correlation(df: DataFrame, columns: list) -> DataFrame:
    """(x, y, r) for every ordered pair; all moments come from one scan."""
    d = G.design(df, columns)
    r = correlation_matrix(G.gram(df, [d[c][0] for c in columns]))
    rows = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def crosstabs(df: DataFrame, columns: list) -> DataFrame:
    """(a, b, x, y, n): the cross-tabs of all pairs of columns, from one scan."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    pairs = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), text[i].alias("x"), text[j].alias("y"))
             for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.select(F.inline(F.array(*pairs))).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Count of every observed pair of categories, in long form."""
    return df.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
