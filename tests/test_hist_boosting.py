"""Histogram boosting against plain trees, on one process and over the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import hist_boosting as hb


def grow(x, r, h, depth, split, leaf, decrease, share=1.0):
    """A tree by trying every cut between neighbouring values; returns the value of each row."""
    out = np.full(len(x), share * r.sum() / h.sum() if h.sum() else 0.0)

    def go(rows, left_depth):
        out[rows] = share * r[rows].sum() / h[rows].sum() if h[rows].sum() > 1e-150 else 0.0
        if not left_depth or len(rows) < split:
            return
        best = None
        for i in range(x.shape[1]):
            v = np.unique(x[rows, i])
            for cut in (v[1:] + v[:-1]) / 2:
                a, b = rows[x[rows, i] <= cut], rows[x[rows, i] > cut]
                if min(len(a), len(b)) < leaf:
                    continue
                gain = r[a].sum() ** 2 / len(a) + r[b].sum() ** 2 / len(b) - r[rows].sum() ** 2 / len(rows)
                if gain >= decrease and gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                    best = gain, a, b
        if best:
            go(best[1], left_depth - 1)
            go(best[2], left_depth - 1)

    go(np.arange(len(x)), depth)
    return out


def boosted(x, y, classes, rounds, rate, depth, split=2, leaf=1, decrease=0.0):
    n = len(y)
    if not classes:
        f = np.full((n, 1), y.mean())
    elif classes == 2:
        f = np.full((n, 1), np.log(y.mean() / (1 - y.mean())))
    else:
        f = np.tile(np.log(np.bincount(y, minlength=classes) / n), (n, 1))
    for _ in range(rounds):
        if not classes:
            r, h = (y - f[:, 0])[:, None], np.ones((n, 1))
        elif classes == 2:
            p = 1 / (1 + np.exp(-f))
            r, h = y[:, None] - p, p * (1 - p)
        else:
            e = np.exp(f)
            p = e / e.sum(axis=1, keepdims=True)
            r, h = np.eye(classes)[y] - p, p * (1 - p)
        f = f + rate * np.column_stack([grow(x, r[:, k], h[:, k], depth, split, leaf, decrease * n, (classes - 1) / classes if classes > 2 else 1.0)
                                        for k in range(r.shape[1])])
    return f


def data(spark, n, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n) / 3, rng.integers(0, 5, n) * 1.5, rng.integers(0, 2, n)])
    signal = np.sin(x[:, 0] * 2) + x[:, 1] * x[:, 2] / 3 + 0.2 * rng.standard_normal(n)
    y = signal if kind == 0 else np.digitize(signal, np.quantile(signal, np.arange(1, kind) / kind))
    rows = [(i, *map(float, r), float(v) if kind == 0 else "abcdef"[int(v)]) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, f"k long, u double, v double, w double, t {'double' if kind == 0 else 'string'}").repartition(5)


def scores(model, df):
    return np.array([r["s"] for r in model.score_frame(df, "s").orderBy("k").collect()])


@pytest.mark.parametrize("kind", [0, 2, 3])
@pytest.mark.parametrize("here", [True, False])
def test_equals_plain_trees(spark, monkeypatch, kind, here):
    """Summed in one process and over blocks whose scores are written anew in between."""
    if not here:
        monkeypatch.setattr(hb, "LOCAL_CELLS", 0)
        monkeypatch.setattr(hb, "BLOCK_ROWS", 20)
        monkeypatch.setattr(hb, "SCORE_EVERY", 2)
    x, y, df = data(spark, 400, kind)
    model = hb.histogram_boosting(df, "t", ["u", "v", "w"], 0.3, 5, 3)
    assert np.allclose(scores(model, df), boosted(x, y, kind, 5, 0.3, 3), atol=1e-8)
    assert len(model.rounds) == 5 and all(len(t) == (kind if kind > 2 else 1) for t in model.rounds)


@pytest.mark.parametrize("limits", [{"min_samples_split": 150}, {"min_samples_leaf": 60}, {"min_impurity_decrease": 0.02}, {"min_weight_fraction_leaf": 0.15}])
def test_limits_mean_what_they_say(spark, limits):
    x, y, df = data(spark, 400, 0)
    model = hb.histogram_boosting(df, "t", ["u", "v", "w"], 0.5, 2, 3, **limits)
    want = boosted(x, y, 0, 2, 0.5, 3, limits.get("min_samples_split", 2),
                   limits.get("min_samples_leaf", 400 * limits.get("min_weight_fraction_leaf", 0) or 1), limits.get("min_impurity_decrease", 0.0))
    assert np.allclose(scores(model, df), want, atol=1e-8)


def test_a_split_bound_is_no_leaf_bound(spark):
    """Ten rows to split may leave a leaf of one row."""
    df = spark.createDataFrame([(i, float(i), 100.0 if i == 0 else 0.0) for i in range(10)], "k long, u double, t double")
    model = hb.histogram_boosting(df, "t", ["u"], 1.0, 1, 1, min_samples_split=10)
    assert sorted(set(scores(model, df).ravel().tolist())) == [0.0, 100.0]
    assert hb.histogram_boosting(df, "t", ["u"], 1.0, 1, 1, min_samples_split=11).rows(spark).first()["nodes"] == 1


def test_many_values_are_cut_at_percentiles(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7).alias("u"))
    df = df.withColumn("t", F.sin(F.col("u") / 2000))
    model = hb.histogram_boosting(df, "t", ["u"], 0.3, 30, 3)
    assert len(model.edges[0]) <= hb.BINS
    row = model.predict(df).agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2)).alias("mse"), F.var_pop("t").alias("var")).first()
    assert row["mse"] < 0.01 * row["var"]


def test_predictions_nulls_and_layout(spark):
    _, y, df = data(spark, 300, 3)
    gaps = df.withColumn("u", F.when(F.col("k") % 7 > 0, F.col("u")))
    model = hb.histogram_boosting(gaps, "t", ["u", "v", "w"], n_estimators=4)
    out = model.predict(gaps).collect()
    assert len(out) == 300 and {r["k"] % 7 == 0 for r in out if r["prediction"] is None} == {True}
    assert np.mean([r["prediction"] == r["t"] for r in out if r["prediction"]]) > 0.7
    again = hb.histogram_boosting(gaps.repartition(3), "t", ["u", "v", "w"], n_estimators=4)
    assert np.allclose(scores(model, df), scores(again, df), atol=1e-9)
    assert model.rows(spark).count() == 12
    with pytest.raises(ValueError, match="no complete rows"):
        hb.histogram_boosting(df.filter("k < 0"), "t", ["u"])
    one = hb.histogram_boosting(df.filter("t = 'a'"), "t", ["u"])
    assert {r["prediction"] for r in one.predict(df).collect()} == {"a"}
