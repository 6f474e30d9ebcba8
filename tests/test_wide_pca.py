"""Components of very many columns against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import gram, pca, wide_pca


def table(spark, n, p, rank, seed=3, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank)) * np.linspace(3, 1, rank) @ rng.standard_normal((rank, p)) + noise * rng.standard_normal((n, p))
    return x * rng.uniform(0.1, 50, p) + rng.uniform(-1e4, 1e4, p)


def exact(x, k):
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    return values[::-1][:k], pca.fixed_signs(vectors[:, ::-1][:, :k].T)


@pytest.mark.parametrize("noise", [0.3, 20.0])
def test_equals_the_exact_one_on_200_columns(spark, noise):
    x = table(spark, 600, 200, 8, noise=noise)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, x array<double>").repartition(6)
    model = wide_pca.wide_pca(df, "x", 5)
    values, loadings = exact(x, 5)
    assert model.residual < 1e-9
    assert np.allclose(model.variance, values, atol=1e-6) and np.allclose(model.loadings, loadings, atol=1e-6)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.std, x.std(axis=0))
    z = (x - x.mean(axis=0)) / x.std(axis=0) @ loadings.T
    got = np.array([[r["PC1"], r["PC5"]] for r in model.scores(df).orderBy("k").collect()])
    assert np.allclose(got, z[:, [0, 4]], atol=1e-4)


def test_twenty_thousand_columns(spark):
    """No p x p matrix: p is ten times the limit of the exact one."""
    p, base = 20_000, np.random.default_rng(5).standard_normal((3, 20_000))
    rows = spark.range(300).select(F.array(*[F.randn(i) for i in range(3)]).alias("h")).collect()
    h = np.array([r["h"] for r in rows])
    x = h @ base + 0.1 * np.random.default_rng(6).standard_normal((300, p))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    model = wide_pca.wide_pca(df, "x", 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.svd(z, compute_uv=False)[:3] ** 2 / len(z)
    assert np.allclose(model.variance, values, rtol=1e-8) and model.loadings.shape == (3, p) and model.residual < 1e-9


def test_columns_beyond_the_limit_go_this_way(spark, monkeypatch):
    x = table(spark, 80, 12, 4)
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    want = pca.pca(df, names, 3)
    monkeypatch.setattr(gram, "MAX_TERMS", 10)
    got = pca.pca(df, names, 3)
    assert np.allclose(got.loadings, want.loadings, atol=1e-7) and np.allclose(got.variance, want.variance)


def test_odd_rows(spark):
    rows = [([1.0, 2.0, 9.0],), ([2.0, 1.0, 3.0],), ([4.0, 4.0, 1.0],), ([None, 1.0, 1.0],), (None,), ([1.0, 2.0],), ([float("nan"), 1.0, 1.0],)]
    df = spark.createDataFrame(rows, "x array<double>")
    model = wide_pca.wide_pca(df, "x", 5)
    values, loadings = exact(np.array([r[0] for r in rows[:3]]), 3)
    assert np.allclose(model.variance[:2], values[:2]) and np.allclose(model.loadings[:2], loadings[:2])
    scores = [r["PC1"] for r in model.scores(df).collect()]
    assert [s is None for s in scores] == [False] * 3 + [True] * 4
    with pytest.raises(ValueError, match="vary"):
        wide_pca.wide_pca(spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],)], "x array<double>"), "x")
    with pytest.raises(ValueError, match="no complete rows"):
        wide_pca.wide_pca(df.filter("x IS NULL"), "x")
