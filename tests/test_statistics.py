import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import anova, correlation, gram, histogram, moments, pca, quantiles, regression, summary
from cohortlens.operators.levels import expand_levels
from cohortlens.plans import federation


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    n = 400
    x1, x2 = rng.normal(1000, 5, n), rng.exponential(2, n)
    group = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    y = 3 + 0.5 * x1 - 2 * x2 + (group == "b") * 4 + rng.normal(0, 1, n)
    site = rng.choice(["s1", "s2", "s3"], n)
    rows = [(int(i), float(a), float(b), str(g), float(t), str(s)) for i, (a, b, g, t, s) in
            enumerate(zip(x1, x2, group, y, site))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, g string, y double, site string")


def frame(df):
    return df.toPandas()


def ols(x, y):
    x = np.column_stack([np.ones(len(y)), *x])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x))), e @ e


def test_linear_regression_with_categories(study):
    p = frame(study)
    b, se, _ = ols([p.x1, p.x2, p.g == "b", p.g == "c"], p.y.to_numpy())
    got = frame(regression.linear_regression(study, "y", ["x1", "x2", "g"]))
    assert got.term.tolist() == ["intercept", "x1", "x2", "g[b]", "g[c]"]
    np.testing.assert_allclose(got.coef, b, rtol=1e-6)
    np.testing.assert_allclose(got.std_err, se, rtol=1e-6)


def test_numpy_states_equal_builtin_states(study, monkeypatch):
    columns = ["y", "x1", "x2", "g"]
    builtin = frame(regression.linear_regression(study, "y", columns[1:]))
    monkeypatch.setattr(gram, "BUILTIN_TERMS", 2)
    by_numpy = frame(regression.linear_regression(study, "y", columns[1:]))
    np.testing.assert_allclose(builtin.coef, by_numpy.coef, rtol=1e-9)
    states, names = federation.partial_gram(study, columns, "site")
    merged = frame(federation.merge_regression(states, names, "y"))
    np.testing.assert_allclose(merged.coef, builtin.coef, rtol=1e-9)


def test_fold_models_equal_refits(study):
    models = regression.fold_models(study, "y", ["x1", "x2"], "site")
    for site, model in models.items():
        again = regression.fit_linear(study.filter(F.col("site") != site), "y", ["x1", "x2"])
        np.testing.assert_allclose(model.fit.coef, again.fit.coef, rtol=1e-7)


def test_collinear_columns_do_not_break(study):
    got = frame(regression.linear_regression(study.withColumn("x3", 2 * F.col("x1")), "y", ["x1", "x3"]))
    one = frame(regression.linear_regression(study, "y", ["x1"]))
    assert got.coef[1] + 2 * got.coef[2] == pytest.approx(one.coef[1], rel=1e-6)


def test_anova_is_sequential(study):
    p = frame(study)
    y = p.y.to_numpy()
    steps = [[], [p.x1], [p.x1, p.g == "b", p.g == "c"],
             [p.x1, p.g == "b", p.g == "c", p.x1 * (p.g == "b"), p.x1 * (p.g == "c")]]
    rss = [ols(s, y)[2] for s in steps]
    got = frame(anova.anova(study, "y", ["x1", "g"]))
    assert got.term.tolist() == ["x1", "g", "x1:g", "Residual"] and got.df.tolist() == [1, 2, 2, 394]
    np.testing.assert_allclose(got.sum_sq, [rss[0] - rss[1], rss[1] - rss[2], rss[2] - rss[3], rss[3]], rtol=1e-4)
    assert got.sum_sq.sum() == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert frame(anova.anova(study, "y", ["x1", "g"], "additive")).term.tolist() == ["x1", "g", "Residual"]


def test_logistic_regression_solves_the_score_equations(study):
    got = frame(regression.logistic_regression(study, "g", ["x1", "x2"]))
    p = frame(study)
    x = np.column_stack([np.ones(len(p)), p.x1, p.x2])
    eta = {"a": np.zeros(len(p))}
    for c in ("b", "c"):
        eta[c] = x @ got[got["class"] == c].coef.to_numpy()
    total = sum(np.exp(e) for e in eta.values())
    for c in ("b", "c"):
        score = x.T @ ((p.g == c) - np.exp(eta[c]) / total)
        np.testing.assert_allclose(score / len(p), 0, atol=1e-5)
    assert (got.std_err > 0).all()


def test_pca_of_a_known_correlation_matrix():
    """Variance shares and loadings published for three correlated variables."""
    r = np.array([[1.0, -0.06559, -0.05297], [-0.06559, 1.0, 0.99515], [-0.05297, 0.99515, 1.0]])
    columns = ["task2", "course1", "course2"]
    model = pca.pca_from_state(gram.Gram(columns, 1, np.zeros(3), r), columns)
    share = 100 * model.variance / 3
    np.testing.assert_allclose(share, [66.73864, 33.10222, 0.15914], atol=2e-3)
    np.testing.assert_allclose(np.abs(model.loadings[0]), [0.08337, 0.70491, 0.70438], atol=1e-4)
    np.testing.assert_allclose(model.loadings @ model.loadings.T, np.eye(3), atol=1e-9)
    assert share.sum() == pytest.approx(100)


def test_pca_scores_have_the_eigenvalues_as_variance(study):
    model = pca.pca(study, ["x1", "x2", "y"])
    scores = frame(model.scores(study).select("PC1", "PC2", "PC3"))
    np.testing.assert_allclose(scores.var(ddof=0), model.variance, rtol=1e-9)


def test_correlation_matches_numpy(study):
    p = frame(study)[["x1", "x2", "y"]]
    got = frame(correlation.correlation(study, ["x1", "x2", "y"])).pivot(index="x", columns="y", values="r")
    np.testing.assert_allclose(got.loc[p.columns, p.columns].to_numpy(float), np.corrcoef(p.T), atol=1e-10)


def test_constant_column_has_no_correlation(study):
    got = frame(correlation.correlation(study.withColumn("k", F.lit(1.0)), ["x1", "k"]))
    assert got.r.isna().sum() == 3


def test_merged_states_equal_the_whole(study):
    parts = moments.moment_states(study.filter("site = 's1'"), ["x1", "x2"], ["site"])
    for s in ("s2", "s3"):  # as when sites work on their own
        parts = parts.unionByName(moments.moment_states(study.filter(F.col("site") == s), ["x1", "x2"], ["site"]))
    merged = frame(federation.merge_summary(parts)).set_index("variable")
    p = frame(study)
    for v in ("x1", "x2"):
        assert merged.loc[v, "std"] == pytest.approx(p[v].std(), rel=1e-9)
        assert merged.loc[v, "EX^2"] == pytest.approx((p[v] ** 2).mean(), rel=1e-12)


def test_large_offsets_keep_their_digits(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id") % 2).alias("x"))
    row = summary.summary_statistics(df, ["x"]).first()
    assert row["std"] == pytest.approx(np.std([0, 1] * 500, ddof=1), rel=1e-9)


@pytest.mark.parametrize("buckets", [7, 4096])
def test_narrowed_percentiles_are_exact(spark, buckets):
    rng = np.random.default_rng(5)
    # a third of the rows share one value, tails are heavy, one group is tiny
    values = np.concatenate([np.full(300, 4.0), rng.lognormal(0, 5, 590), [-1e12, 1e15, 0.0, 4.0, 4.0]])
    df = spark.createDataFrame([("a" if i % 5 else None, float(v)) for i, v in enumerate(values)], "g string, v double")
    states = moments.merged_levels(moments.moment_states(df, ["v"], ["g"]), ["g"])
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = quantiles.narrowed_percentiles(df, ["v"], ["g"], probs, states, leaf_rows=20, buckets=buckets)
    want = quantiles.direct_percentiles(expand_levels(df, ["g"]), ["v"], ["g", "_all"], probs)
    assert {(r["g"], r["_all"]): r["q"] for r in got.collect()} == {(r["g"], r["_all"]): r["q"] for r in want.collect()}


def test_mixed_group_sizes(study):
    usual = summary.summary_statistics(study, ["x1", "y"], ["g"])
    mixed = summary.summary_statistics(study, ["x1", "y"], ["g"], direct_rows=250)

    def q(df):
        return {(tuple(r["group"]), r["index"]): (r["25%"], r["50%"], r["75%"]) for r in df.collect()}

    assert q(usual) == q(mixed) and len(q(usual)) == 8


def test_summary_layout_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "u"), (None, "u"), (3.0, None), (5.0, "v")], "x double, c string")
    out = summary.summary_statistics(df, ["x", "c"], labels={"x": "The x"})
    assert out.columns == summary.SUMMARY_COLUMNS
    rows = {r["index"]: r for r in out.collect()}
    assert rows["x"]["count"] == 3 and rows["x"]["null_count"] == 1 and rows["x"]["label"] == "The x"
    assert rows["x"]["type"] == "real" and rows["x"]["group"] == ["all"] and rows["x"]["EX^2"] == pytest.approx(35 / 3)
    assert rows["c"]["top"] == "u" and rows["c"]["frequency"] == 2 and rows["c"]["unique"] == 2
    empty = summary.summary_statistics(df.filter("x > 99"), ["x", "c"]).collect()
    assert all(r["count"] == 0 for r in empty)


def test_null_group_is_not_the_overall_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "g string, x double")
    rows = {(tuple(r["group_variables"]), tuple(r["group"])): r["50%"] for r in
            summary.summary_statistics(df, ["x"], ["g"]).collect()}
    assert rows == {(("g",), ("a",)): 1.0, (("g",), (None,)): 3.0, ((), ("all",)): 2.0}


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(21)], "v double")
    closed = {r["bin"]: r["count"] for r in histogram.histogram(df, "v").collect()}
    assert len(closed) == 20 and sum(closed.values()) == 21 and closed[19] == 2
    dropped = [r["count"] for r in histogram.histogram(df, "v", drop_max=True).collect()]
    assert sum(dropped) == 20
    flat = histogram.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").collect()
    assert sum(r["count"] for r in flat) == 3


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_percentiles_with_odd_values_agree_at_any_size(spark, odd):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(size=900))] + [("a", odd)] * 2 + [("c", odd)]
    df = spark.createDataFrame(rows, "g string, v double")

    def q(direct_rows):
        out = summary.summary_statistics(df, ["v"], ["g"], direct_rows=direct_rows).collect()
        return {tuple(r["group"]): [str(r[c]) for c in ("25%", "50%", "75%")] for r in out}

    assert q(1) == q(4_000_000)


def test_groups_far_apart_keep_their_spread(spark):
    rows = [("a", i % 7 / 10) for i in range(300)] + [("b", 1e9 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {tuple(r["group"]): r["std"] for r in summary.summary_statistics(df, ["v"], ["g"]).collect()}
    assert got[("b",)] == pytest.approx(np.std([0, 1] * 150, ddof=1), rel=1e-6)
    assert got[("a",)] == pytest.approx(np.std([i % 7 / 10 for i in range(300)], ddof=1), rel=1e-6)


def test_state_names_are_reserved(spark):
    with pytest.raises(ValueError, match="rename"):
        moments.moment_states(spark.createDataFrame([("a", 1.0)], "variable string, v double"), ["v"], ["variable"])
