"""Nearest neighbours by pivots against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import knn, knn_pivots
from cohortlens.plans import federation


def frame(spark, x, first="_key", groups=None):
    names = [first, *[f"_x{i}" for i in range(x.shape[1])]]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join([f"{names[0]} long", *[f"{n} double" for n in names[1:]]]))
    if first == "_key":
        df = df.withColumn("_y", F.col("_key") * 1.0)
    if groups:
        df = df.withColumn("_by", F.element_at(F.array(*[F.lit(g) for g in groups]), (F.col("_key") % len(groups)).cast("int") + 1))
    return df


def brute(x, q, k, keep=None):
    out = {}
    for i, point in enumerate(q):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - point[j]) ** 2
        order = [t for t in np.lexsort((np.arange(len(x)), d)) if keep is None or keep(t)][:k]
        out[i] = [(float(d[t]), int(t)) for t in order]
    return out


def near(df):
    return {r["_q"]: [(n["d2"], n["neighbour"]) for n in r["near"]] for r in df.collect()}


def clustered(n, dims, clusters, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.uniform(-1, 1, (clusters, dims))[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dims))


def test_equals_all_distances_and_compares_few_rows(spark):
    """Twenty clustered columns: far fewer distances than all pairs."""
    x, q = clustered(6000, 20, 40), clustered(300, 20, 40, seed=1)
    found = knn_pivots.pivot_neighbours(frame(spark, x), frame(spark, q, "_q"), 20, 5).cache()
    assert near(found) == brute(x, q, 5)
    compared = found.agg(F.sum("compared")).first()[0] / (len(x) * len(q))
    print(f"compared {compared:.1%} of all pairs")
    assert compared < 0.15


@pytest.mark.parametrize("pivots", [1, 7, 200])
def test_no_structure_is_still_exact(spark, pivots):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((700, 12)), rng.standard_normal((60, 12))
    assert near(knn_pivots.pivot_neighbours(frame(spark, x), frame(spark, q, "_q"), 12, 4, pivots=pivots)) == brute(x, q, 4)


def test_ties_copies_and_few_rows(spark):
    """A point that a third of all rows share, equal distances, and fewer rows than k."""
    x = np.array([[0.0] * 9] * 200 + [[1.0] + [0.0] * 8] * 200 + [[0.0] * 8 + [float(i)] for i in range(200)])
    q = np.array([[0.5] + [0.0] * 8, [0.0] * 9, [5.0] * 9])
    assert near(knn_pivots.pivot_neighbours(frame(spark, x), frame(spark, q, "_q"), 9, 6)) == brute(x, q, 6)
    assert near(knn_pivots.pivot_neighbours(frame(spark, x[:3]), frame(spark, q, "_q"), 9, 6)) == brute(x[:3], q, 6)
    with pytest.raises(ValueError, match="training rows"):
        knn_pivots.pivot_neighbours(frame(spark, x).limit(0), frame(spark, q, "_q"), 9, 6)


def test_crowded_cells_are_cut(spark, monkeypatch):
    x, q = clustered(900, 8, 3, seed=5), clustered(120, 8, 3, seed=5)
    monkeypatch.setattr(knn_pivots, "PART_ROWS", 100)
    monkeypatch.setattr(knn_pivots, "CHUNK_ROWS", 20)
    assert near(knn_pivots.pivot_neighbours(frame(spark, x), frame(spark, q, "_q"), 8, 5, pivots=4)) == brute(x, q, 5)


def test_groups_in_one_run(spark):
    x, q = clustered(800, 10, 12, seed=6), clustered(50, 10, 12, seed=6)
    names = ["a", "b", "c"]
    found = knn_pivots.pivot_neighbours(frame(spark, x, groups=names), frame(spark, q, "_q"), 10, 3, ["a", "c", "none"]).collect()
    for g in ("a", "c"):
        want = brute(x, q, 3, lambda t: names[t % 3] == g)
        assert {r["_q"]: [(n["d2"], n["neighbour"]) for n in r["near"]] for r in found if r["_by"] == g} == want
    assert {r["_by"] for r in found} == {"a", "c"}


def test_many_columns_of_a_model_go_this_way(spark):
    x = clustered(300, 9, 5, seed=7)
    df = spark.createDataFrame([(i, float(i % 4), *map(float, r)) for i, r in enumerate(x)], "k long, t double, " + ", ".join(f"c{i} double" for i in range(9)))
    model = knn.knn_fit(df, "k", "t", [f"c{i}" for i in range(9)], 3)
    got = {r["k"]: [n["neighbour"] for n in r["near"]] for r in knn.neighbours(model, df, "k", 3).collect()}
    assert got == {i: [t for _, t in v] for i, v in brute(x, x, 3).items()}
    parts = federation.partial_neighbours(df, df, "k", "k", "t", ["c0", "c1"], "t", [0.0, 3.0], 2)
    assert parts.groupBy("k").count().filter("count <> 4").count() == 0
