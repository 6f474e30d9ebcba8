"""Walks from seeds against full iteration."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortlens.operators import walks


def exact(rows, seed, damping, turns=400):
    """Full iteration over the subject-to-subject matrix."""
    n, step = len(rows), np.zeros((len(rows), len(rows)))
    holders = {}
    for i, r in enumerate(rows):
        for c, v in enumerate(r):
            if v is not None:
                holders.setdefault((c, v), []).append(i)
    for i, r in enumerate(rows):
        held = [(c, v) for c, v in enumerate(r) if v is not None]
        for h in held:
            for j in holders[h]:
                step[i, j] += 1 / len(held) / len(holders[h])
    at, out = np.eye(n)[seed], np.zeros(n)
    stay = step.sum(axis=1) == 0
    for _ in range(turns):
        out += np.where(stay, at, (1 - damping) * at)
        at = damping * at @ step
    return out


def table(spark, n=150, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = "hot" if rng.random() < 0.35 else f"a{rng.randint(0, 30)}"
        rows.append((hot, rng.choice([None, f"b{rng.randint(0, 20)}"]), rng.choice([None, *"xyz"])))
    rows += [(None, None, None), ("alone", None, None)]
    return rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, a string, b string, c string").repartition(4)


@pytest.mark.parametrize(("damping", "error"), [(0.5, 1e-3), (0.3, 1e-4)])
def test_error_bound_holds_for_every_row(spark, damping, error):
    rows, df = table(spark)
    seeds = [0, 7, len(rows) - 2, len(rows) - 1, 99999]
    out = walks.subject_walks(df, "k", ["a", "b", "c"], spark.createDataFrame([(s,) for s in seeds], "s long"), damping, error).collect()
    assert {r["seed"] for r in out} == set(seeds[:-1])
    for s in seeds[:-1]:
        got, want = {r["k"]: r["score"] for r in out if r["seed"] == s}, exact(rows, s, damping)
        assert len(got) <= 2 / (error * (1 - damping)) + 1
        for i, r in enumerate(rows):
            off = want[i] - got.get(i, 0.0)
            assert -1e-12 <= off <= error * sum(v is not None for v in r) + 1e-12, (s, i, off)


def test_coarse_walks_are_sparse(spark):
    """What a hot value would hand to a third of all subjects stays there when it is too little for each."""
    rows, df = table(spark, 600)
    seeds = spark.createDataFrame([(3,)], "s long")
    coarse = walks.subject_walks(df, "k", ["a", "b", "c"], seeds, 0.4, 0.02).count()
    fine = walks.subject_walks(df, "k", ["a", "b", "c"], seeds, 0.4, 1e-4).count()
    assert coarse < 60 < fine


def test_numeric_columns_and_wrong_parameters(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 0.1, "b"), (3, 9.9, "a"), (4, None, None)], "k long, x double, g string")
    got = {(r["seed"], r["k"]) for r in walks.subject_walks(df, "k", ["x", "g"], df.select("k"), 0.3, 1e-3).collect()}
    assert {(1, 1), (1, 2), (1, 3), (4, 4)} <= got and (4, 1) not in got
    with pytest.raises(ValueError):
        walks.subject_walks(df, "k", ["g"], df.select("k"), damping=1.0)


def test_totals_are_those_of_the_single_rows(spark):
    """Also with null and repeated keys, seeds without values or without a row, and columns that the walk does not use."""
    rng, (rows, _) = random.Random(2), table(spark, 80)
    data = [(rng.choice([None, i // 2, i]), *r, rng.choice([None, "u", "v"])) for i, r in enumerate(rows)] + [(3, "a1", None, "x", "u")] * 3
    df = spark.createDataFrame(data, "k long, a string, b string, c string, t string").repartition(4)
    seeds = spark.createDataFrame([(s,) for s in (1, 3, 3, 7, 80, 81, 999, None)], "s long")
    for by in (["t"], ["a", "t"]):
        args = (df, "k", ["a", "b", "c"], seeds, 0.1, 5e-3)
        want = walks.subject_walks(*args).join(df, "k").groupBy("seed", *by).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
        want = {tuple(r[c] for c in ("seed", *by)): (r["n"], pytest.approx(r["s"], abs=1e-12)) for r in want.collect()}
        got = walks.subject_walks(*args, totals=by)
        assert got.columns == ["seed", *by, "subjects", "score"]
        assert {tuple(r[c] for c in ("seed", *by)): (r["subjects"], r["score"]) for r in got.collect()} == want


def test_totals_make_no_row_per_seed_and_subject(spark, monkeypatch):
    """Seeds and subjects only meet as kinds of subjects: what the end joins has a row per seed and bundle of profiles."""
    made, kept = [], walks.checkpoint
    monkeypatch.setattr(walks, "checkpoint", lambda df: made.append(kept(df)) or made[-1])
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    out = walks.subject_walks(df, "k", ["g"], df.filter("k % 10 = 0").select("k"), 0.3, 0.01, totals=["g"])
    got = {(r["seed"], r["g"]): (r["subjects"], round(r["score"], 6)) for r in out.collect()}
    pairs = [m.count() for m in made if {"_seed", "_bundle"} <= set(m.columns)]
    assert pairs == [0] and len(got) == 300 and set(got.values()) == {(1, 0.7)}  # too little for each of a thousand
    out = walks.subject_walks(df, "k", ["g"], df.filter("k % 10 = 0").select("k"), 0.1, 1e-5, totals=["g"])
    assert {(r["subjects"], round(r["score"], 2)) for r in out.collect()} == {(1000, 1.0)}
    assert [m.count() for m in made if {"_seed", "_bundle"} <= set(m.columns)] == [0, 300]
