"""Bounds that say so: steps that run out, states that are too many."""

import numpy as np
import pytest

from cohortlens.model import AlgorithmSpec, FeatureTable, MiningQuery
from cohortlens.operators import gram, regression
from cohortlens.plans.mining import run_mining
from cohortlens.sources.tables import Catalog


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(x), "ab"[int(x + rng.normal(0, 1) > 0)], i % 7) for i, x in enumerate(rng.normal(size=200))]
    return spark.createDataFrame(data, "k long, x double, g string, part int")


def test_a_logit_that_does_not_settle_says_so(spark, rows, monkeypatch):
    catalog = Catalog([FeatureTable("t", lambda s: rows, "k")])
    asked = MiningQuery(variables=("g",), covariables=("x",), target_table="t", algorithm=AlgorithmSpec("linearRegression"))
    assert run_mining(spark, catalog, asked).feedback == []
    monkeypatch.setattr(regression, "LOGISTIC_ITERATIONS", 2)
    out = run_mining(spark, catalog, asked)
    assert len(out.feedback) == 1 and "did not settle in 2 steps" in out.feedback[0] and out.data.count() == 2
    with pytest.warns(UserWarning, match="did not settle"):
        regression.logistic_regression(rows, "g", ["x"])


def test_states_are_bounded_by_their_numbers(spark, rows, monkeypatch):
    d = gram.design(rows, ["x"])
    states = gram.gram_states(rows, d["x"], ["part"])
    assert len(gram.collect_gram(states, ["x"], ["part"])) == 7
    monkeypatch.setattr(gram, "MAX_NUMBERS", 5)
    with pytest.raises(ValueError, match="cross-product states of 1 terms"):
        gram.collect_gram(states, ["x"], ["part"])
