"""Absorbed factors against the same regression with 0/1 terms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import absorb, anova, gram, regression


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for i in range(400):
        a, b = rng.choice("pqrstuv"), rng.choice(["x", "y", "z"])
        u, v = rng.random() * 3 + ord(a) % 5 + 1e4, rng.gauss(0, 1)
        data.append((i, 2 * u - v + ord(a) + 3 * ord(b) + rng.gauss(0, 1), u, v, a, b, rng.choice(["m", "n"])))
    data += [(1000, None, 1.0, 1.0, "p", "x", "m"), (1001, 1.0, None, 1.0, "p", "x", "m"), (1002, 1.0, 1.0, 1.0, None, "x", "m"),
             (1003, float("nan"), 1.0, 1.0, "q", "x", "m")]
    return spark.createDataFrame(data, "k long, t double, u double, v double, a string, b string, c string").cache()


def table(df):
    return {r["term"]: (r["coef"], r["std_err"], r["t_values"], r["p_values"]) for r in df.collect()}


def close(a, b, tol=1e-7):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=tol, abs_tol=tol)


@pytest.mark.parametrize("terms", [1, 12])
def test_one_factor_equals_written_terms(spark, rows, monkeypatch, terms):
    """Both with the built-in sums and with matrix products of what the means leave."""
    monkeypatch.setattr(absorb, "BUILTIN_TERMS", terms)
    want = table(regression.linear_regression(rows, "t", ["u", "v", "c", "a"]))
    got = table(absorb.absorbed_regression(rows, "t", ["u", "v", "c", "a"], ["a"]).rows(spark))
    assert got.keys() == want.keys()
    for term in want:
        assert all(close(x, y, 1e-6) for x, y in zip(got[term], want[term])), (term, got[term], want[term])


def test_two_factors_equal_written_terms(spark, rows):
    want = table(regression.linear_regression(rows, "t", ["u", "v", "a", "b"]))
    model = absorb.absorbed_regression(rows, "t", ["u", "v", "a", "b"], ["a", "b"])
    got = table(model.rows(spark))
    assert got.keys() == want.keys()
    for term in want:
        assert close(got[term][0], want[term][0], 1e-5), term
        if term in ("u", "v"):
            assert all(close(x, y, 1e-6) for x, y in zip(got[term], want[term]))
    dense = {r["k"]: r["prediction"] for r in regression.fit_linear(rows, "t", ["u", "v", "a", "b"]).predict(rows).collect()}
    for r in model.predict(rows).collect():
        if r["u"] is not None and r["a"] is not None:
            assert close(r["prediction"], dense[r["k"]], 1e-6)


def test_three_factors(spark, rows):
    want = table(regression.linear_regression(rows, "t", ["u", "a", "b", "c"]))
    got = table(absorb.absorbed_regression(rows, "t", ["u", "a", "b", "c"], ["a", "b", "c"]).rows(spark))
    assert all(close(x, y, 1e-6) for x, y in zip(got["u"], want["u"]))


def test_factors_in_separate_parts_lose_one_effect_each(spark):
    """Two sets of categories that no row connects: the rank is that of the written terms."""
    rng = random.Random(1)
    data = [(rng.gauss(0, 1), rng.gauss(0, 1), g + rng.choice("ab"), g + rng.choice("cd")) for g in "12" for _ in range(30)]
    df = spark.createDataFrame(data, "t double, u double, a string, b string")
    want = table(regression.linear_regression(df, "t", ["u", "a", "b"]))
    fit = absorb.absorbed_regression(df, "t", ["u", "a", "b"], ["a", "b"]).fit
    assert fit.levels == 8 - 2 and fit.residual_df == 60 - 6 - 1
    assert close(table(absorb.AbsorbedModel(fit, []).rows(spark))["u"][1], want["u"][1], 1e-6)


def test_wide_factor_is_noticed(spark, rows, monkeypatch):
    monkeypatch.setattr(gram, "MAX_LEVELS", 5)
    assert gram.wide_factors(rows, ["u", "a", "b"]) == ["a"]
    model = regression.fit_linear(rows, "t", ["u", "a", "b"])
    assert isinstance(model, absorb.AbsorbedModel) and list(model.fit.groups) == ["a"]
    unseen = model.predict(rows.limit(1).withColumn("a", F.lit("new"))).first()
    assert unseen["prediction"] is None
    with pytest.raises(ValueError, match="additive"):
        anova.anova(rows, "t", ["a", "b"])


@pytest.mark.parametrize("factors", [["a", "u", "b"], ["u", "a", "b"], ["b", "u", "a"]])
def test_anova_equals_written_terms(spark, rows, monkeypatch, factors):
    want = anova.anova(rows, "t", factors, "additive").collect()
    monkeypatch.setattr(gram, "MAX_LEVELS", 5)
    got = anova.anova(rows, "t", factors, "additive").collect()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert all(close(x, y, 1e-6) for x, y in zip(a[2:], b[2:]))


def test_terms_that_categories_explain_and_single_rows(spark):
    """A term constant within categories has no coefficient of its own; categories of one row fit exactly."""
    data = [(1.0, 5.0, "a"), (2.0, 5.0, "a"), (4.0, 6.0, "b"), (3.0, 6.0, "b"), (9.0, 7.0, "c")]
    df = spark.createDataFrame(data, "t double, u double, a string")
    model = absorb.absorbed_regression(df, "t", ["u", "a"], ["a"])
    assert model.fit.rank == 0 and model.fit.residual_df == 2 and math.isclose(model.fit.rss, 1.0)
    only = absorb.absorbed_regression(df, "t", ["a"], ["a"])
    assert table(only.rows(spark))["a[c]"][0] == 7.5 and {r["effect"] for r in only.effects("a").collect()} == {1.5, 3.5, 9.0}
    with pytest.raises(ValueError, match="no complete rows"):
        absorb.absorbed_regression(df.filter("t > 100"), "t", ["a"], ["a"])
