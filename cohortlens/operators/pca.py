"""Principal components of standardised columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import gram as G
from cohortlens.operators.correlation import correlation_matrix


WRITTEN_TERMS = 200  # columns up to which scores are Column arithmetic


@dataclass
class PCAModel:
    columns: list
    mean: np.ndarray
    std: np.ndarray  # population
    variance: np.ndarray  # eigenvalues, largest first
    loadings: np.ndarray  # component x column
    residual: float = 0.0  # how far iterated components are from exact ones
    array: str | None = None  # the array column whose places the columns are

    def explained(self, spark) -> DataFrame:
        share = 100.0 * self.variance / len(self.columns)
        rows = [(f"PC{i + 1}", float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share)))]
        return spark.createDataFrame(
            rows, "component string, explained_variance double, cumulative_explained_variance double"
        )

    def components(self, spark) -> DataFrame:
        """Variance shares and, per component, the loading of every column."""
        share = 100.0 * self.variance / len(self.columns)
        rows = [
            (f"PC{i + 1}", float(s), float(c), {v: float(w) for v, w in zip(self.columns, self.loadings[i])})
            for i, (s, c) in enumerate(zip(share, np.cumsum(share)))
        ]
        return spark.createDataFrame(
            rows, "component string, explained_variance double, cumulative_explained_variance double, "
            "loadings map<string,double>")

    def loading_rows(self, spark) -> DataFrame:
        rows = [
            (f"PC{i + 1}", c, float(self.loadings[i, j]))
            for i in range(len(self.loadings)) for j, c in enumerate(self.columns)
        ]
        return spark.createDataFrame(rows, "component string, variable string, loading double")

    def scores(self, df: DataFrame) -> DataFrame:
        """Component scores: Column arithmetic over the scan, or of very many columns one product per batch."""
        if self.array is not None or len(self.columns) > WRITTEN_TERMS:
            return self._scored(df)
        z = [
            (F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s))
            for c, m, s in zip(self.columns, self.mean, self.std)
        ]
        scores = [
            sum((zc * F.lit(float(w)) for zc, w in zip(z[1:], weights[1:])), z[0] * F.lit(float(weights[0])))
            for weights in self.loadings
        ]
        return df.select("*", *[s.alias(f"PC{i + 1}") for i, s in enumerate(scores)])


    def _scored(self, df: DataFrame) -> DataFrame:
        weights, mean, p = (self.loadings / self.std).T, self.mean, len(self.columns)
        shared = df.sparkSession.sparkContext.broadcast((weights, mean))  # p x k

        @F.pandas_udf("array<double>")
        def product(rows: pd.Series) -> pd.Series:
            weights, mean = shared.value
            out = [None] * len(rows)
            known = [i for i, r in enumerate(rows) if r is not None and len(r) == p]
            if known:
                x = np.array([[np.nan if v is None else v for v in rows.iloc[i]] if None in rows.iloc[i] else rows.iloc[i] for i in known], float)
                for i, score in zip(known, ((x - mean) @ weights).tolist()):
                    out[i] = [None if v != v else v for v in score]
            return pd.Series(out)

        source = F.col(f"`{self.array}`") if self.array else F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        scored = df.withColumn("_scores", product(F.transform(source, lambda v: v.cast("double")) if self.array else source))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], *[
            F.get("_scores", F.lit(i)).alias(f"PC{i + 1}") for i in range(len(self.loadings))])


def fixed_signs(loadings: np.ndarray) -> np.ndarray:
    """Components (rows) turned so that the loading of largest magnitude is positive."""
    largest = np.argmax(np.abs(loadings) > np.abs(loadings).max(axis=1, keepdims=True) - 1e-9, axis=1)
    return loadings * np.sign(loadings[np.arange(len(loadings)), largest])[:, None]


def pca_from_state(state: G.Gram, columns: list, k: int = 5) -> PCAModel:
    if np.any(np.diag(state.cross) <= 0):
        raise ValueError("PCA needs columns that vary")
    values, vectors = np.linalg.eigh(correlation_matrix(state))
    order = np.argsort(values)[::-1][: min(k, len(columns))]
    loadings = fixed_signs(vectors[:, order].T)
    return PCAModel(list(columns), state.mean, np.sqrt(np.diag(state.cross) / state.n),
                    np.maximum(values[order], 0.0), loadings)


def pca(df: DataFrame, columns: list, k: int = 5) -> PCAModel:
    """The first k components; of more than ``MAX_TERMS`` columns without their cross products (``wide_pca``)."""
    if len(columns) > G.MAX_TERMS:
        from cohortlens.operators.wide_pca import wide_pca  # it builds this module's model

        return wide_pca(df, columns, k)
    d = G.design(df, columns)
    return pca_from_state(G.gram(df, [d[c][0] for c in columns]), columns, k)
