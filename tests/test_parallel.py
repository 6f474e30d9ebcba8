"""Algorithms, folds and datasets overlap; errors stay with their part."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, ExperimentQuery, FeatureTable, ValidationSpec
from cohortlens.plans import federation, parallel, registry
from cohortlens.plans.experiment import run_experiment
from cohortlens.sources.tables import Catalog


def meeting(parties):
    """A step that ends only when so many parts are at it at once."""
    barrier = threading.Barrier(parties)
    return lambda: barrier.wait(timeout=60)


class Mean:
    def __init__(self, value):
        self.value = value

    def predict(self, df, output="prediction"):
        return df.withColumn(output, F.lit(self.value))


@pytest.fixture
def registered():
    names = []

    def add(code, **kw):
        names.append(code)
        return registry.register_algorithm(code, **kw)

    yield add
    for n in names:
        registry.ALGORITHMS.pop(n, None)
        registry.FITTERS.pop(n, None)


def catalog(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), "ab"[i % 2]) for i in range(60)], "k long, x double, y double, site string")
    return df, Catalog([FeatureTable("t", lambda s: df, "k", "site")])


def test_algorithms_overlap_and_errors_stay_apart(spark, registered):
    df, tables = catalog(spark)
    meet = meeting(3)

    def counted(task):
        n = task.df.count()  # a job of its own
        meet()
        return task.df.sparkSession.createDataFrame([(n,)], "n long")

    def broken(task):
        meet()
        raise ValueError("no luck")

    registered("one", run=counted)
    registered("two", run=counted)
    registered("bad", run=broken)
    out = run_experiment(spark, tables, ExperimentQuery(
        variables=("x",), target_table="t", algorithms=(AlgorithmSpec("one"), AlgorithmSpec("bad"), AlgorithmSpec("two")))).collect()
    assert [(r["position"], r["algorithm"], r["result"], r["error"]) for r in sorted(out, key=lambda r: r["position"])] == [
        (0, "one", "result", None), (1, "bad", "error", "no luck"), (2, "two", "result", None)]


def test_folds_overlap(spark, registered):
    df, tables = catalog(spark)
    meet, calls = meeting(3), []

    def fit(rows, y, xs, key):
        calls.append(rows.count())
        if len(calls) > 1:  # the first fit is that on all rows
            meet()
        return Mean(1.0)

    registered("waits", fit=fit, predictive=True)
    out = run_experiment(spark, tables, ExperimentQuery(
        variables=("x",), covariables=("y",), target_table="t", algorithms=(AlgorithmSpec("waits"),), validations=(ValidationSpec("kfold", {"k": 3}),))).collect()
    assert {r["result"] for r in out} == {"model", "kfold", "document"} and sorted(calls) == [40, 40, 40, 60]


def test_datasets_overlap(spark):
    df, _ = catalog(spark)
    meet = meeting(2)

    def run(part):
        meet()
        return part.agg(F.count("*").alias("n"))

    assert sorted(map(tuple, federation.scatter_gather(run, df, "site", ["a", "b"]).collect())) == [(30, "a"), (30, "b")]


def test_each_part_has_a_pool_and_the_callers_properties(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("cohortlens.test", "mine")
    try:
        meet = meeting(2)

        def look():
            meet()
            return sc.getLocalProperty("spark.scheduler.pool"), sc.getLocalProperty("cohortlens.test")

        found = parallel.all_of(parallel.side_by_side(spark, [look, look], name="x"))
    finally:
        sc.setLocalProperty("cohortlens.test", None)
    assert found == [("cohortlens-x-0", "mine"), ("cohortlens-x-1", "mine")]
    assert sc.getLocalProperty("spark.scheduler.pool") is None


def test_first_error_in_order():
    with pytest.raises(KeyError):
        parallel.all_of([(1, None), (None, KeyError("a")), (None, ValueError("b"))])
