import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting, kmeans, knn, linear, naive_bayes, network, neural, scoring, subgroups


def brute(train, queries, k):
    """k nearest by distance, then key."""
    out = {}
    for qk, q in queries:
        ranked = sorted(((sum((a - b) ** 2 for a, b in zip(q, x)), key, y) for key, x, y in train))
        out[qk] = [(key, y) for _, key, y in ranked[:k]]
    return out


@pytest.mark.parametrize("leaf_rows, part_rows, chunk_rows", [(4096, 200_000, 50_000), (16, 200_000, 50_000), (16, 5, 7)])
def test_knn_is_exact_on_skewed_points(spark, monkeypatch, leaf_rows, part_rows, chunk_rows):
    monkeypatch.setattr(knn, "PART_ROWS", part_rows)
    monkeypatch.setattr(knn, "CHUNK_ROWS", chunk_rows)
    rng = np.random.default_rng(1)
    # a third of the training points coincide, and many distances tie
    points = [(0.5, 0.5)] * 100 + [(float(a), float(b)) for a, b in rng.integers(0, 6, (120, 2))] + [(50.0, 50.0)] * 2
    train = [(i, p, float(i % 7)) for i, p in enumerate(points)]
    queries = [(i, (float(a), float(b))) for i, (a, b) in enumerate(rng.uniform(-1, 7, (90, 2)))] + [(90, (60.0, 60.0))]
    t = spark.createDataFrame([(k, *x, y) for k, x, y in train], "id long, a double, b double, y double")
    q = spark.createDataFrame([(k, *x) for k, x in queries], "id long, a double, b double")
    model = knn.knn_fit(t, "id", "y", ["a", "b"], leaf_rows=leaf_rows)
    got = {r["id"]: [(n["neighbour"], n["y"]) for n in r["near"]] for r in knn.neighbours(model, q, "id", 5).collect()}
    assert got == brute(train, queries, 5)


def test_knn_classes_and_nominal_inputs(spark):
    t = spark.createDataFrame([(1, "x", 0.0, "no"), (2, "x", 1.0, "no"), (3, "y", 0.0, "yes"), (4, "y", 1.0, "yes")],
                              "id int, c string, v double, label string")
    q = spark.createDataFrame([(9, "x", 0.4), (8, "y", 0.4)], "id int, c string, v double")
    rows = knn.knn_fit(t, "id", "label", ["c", "v"], k=2).predict(q).collect()
    assert {r["id"]: r["prediction"] for r in rows} == {9: "no", 8: "yes"}


def test_votes_break_ties_by_the_smaller_class(spark):
    near = F.array(*[F.struct(F.lit(0.0).alias("d2"), F.lit(i).alias("neighbour"), F.lit(y).alias("y"))
                     for i, y in enumerate(["b", "a", "b", "a"])])
    assert spark.range(1).select(knn.vote(near, True)).first()[0] == "a"


def test_training_points_are_limited_before_the_shuffle(spark):
    t = spark.range(1000).select("id", (F.col("id") % 3).alias("a"))
    from pyspark.sql import Window

    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("id"))).filter("r <= 5")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_by_hand(spark):
    rows = [("p", 1.0, "u"), ("p", 3.0, "u"), ("p", 2.0, "v"), ("q", 10.0, "v"), ("q", 14.0, "w")]
    df = spark.createDataFrame(rows, "y string, x double, c string")
    model = naive_bayes.naive_bayes_fit(df, "y", ["x", "c"], classes=["p", "q", "r"])
    assert model.log_prior["p"] == pytest.approx(math.log(3 / 5)) and model.log_prior["r"] == -1e10
    assert model.gaussians["q", "x"] == pytest.approx((12.0, 4.0), abs=1e-6)
    assert model.log_prob["p", "c", "u"] == pytest.approx(math.log((2 + 1) / (3 + 3)))
    assert [r["prediction"] for r in model.predict(df).collect()] == ["p", "p", "p", "q", "q"]
    priors = naive_bayes.naive_bayes_fit(df, "y", ["c"], class_prior={"p": 0.1, "q": 0.9})
    assert priors.log_prior["q"] == pytest.approx(math.log(0.9))


def test_naive_bayes_folds_equal_refits(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(
        [(str(rng.choice(["p", "q"])), float(rng.normal()), str(rng.choice(["u", "v"])), int(i % 3)) for i in range(90)],
        "y string, x double, c string, f int")
    for f, model in naive_bayes.naive_bayes_folds(df, "y", ["x", "c"], "f").items():
        again = naive_bayes.naive_bayes_fit(df.filter(F.col("f") != f), "y", ["x", "c"])
        assert model.log_prior == pytest.approx(again.log_prior)
        for k, v in again.gaussians.items():
            assert model.gaussians[k] == pytest.approx(v)
        assert model.log_prob == pytest.approx(again.log_prob)


def test_many_categories_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame(
        [(i, str(rng.choice(["p", "q"])), float(rng.normal()), str(rng.integers(0, 30)), i % 2) for i in range(200)],
        "id int, y string, x double, c string, f int")
    model = naive_bayes.naive_bayes_fit(df, "y", ["x", "c"])
    folds = naive_bayes.naive_bayes_folds(df, "y", ["x", "c"], "f")

    def both():
        return (sorted((r["id"], r["prediction"]) for r in model.predict(df.withColumn("c", F.concat("c", F.lit("")))).collect()),
                sorted((r["id"], r["prediction"]) for r in naive_bayes.predict_by_fold(df, folds, "f").collect()))

    inside = both()
    monkeypatch.setattr(naive_bayes, "LOOKUP_VALUES", 5)
    assert both() == inside


# pooled confusion matrix of a published two-fold study and its scores
MATRIX = {"AD": [73, 60, 141, 0], "CN": [12, 131, 155, 0], "Other": [21, 40, 1085, 0], "MCI": [0, 0, 0, 0]}
LABELS = ["AD", "CN", "Other", "MCI"]


def test_weighted_scores(spark):
    rows = [(a, p, n) for a, row in MATRIX.items() for p, n in zip(LABELS, row)]
    counts = spark.createDataFrame(rows, "actual string, predicted string, n long")
    s = scoring.multiclass_from_confusion(counts).first()
    assert s["n"] == 1718
    got = [s[c] for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr")]
    assert got == pytest.approx([0.75029, 0.73228, 0.75029, 0.72, 0.36105], abs=6e-6)


def test_pooled_scores_are_not_the_mean_of_folds(spark):
    rows = [("1", "a", "a")] * 9 + [("1", "a", "b")] + [("2", "a", "b")] * 2
    df = spark.createDataFrame(rows, "fold string, actual string, prediction string")
    got = {r["fold"]: r["accuracy"] for r in scoring.score_multiclass(df, "actual", "prediction", ["a", "b"], "fold").collect()}
    assert got == pytest.approx({"1": 0.9, "2": 0.0, "all": 0.75})
    matrix = scoring.confusion(df, "actual", "prediction", ["a", "b", "c"]).collect()
    assert len(matrix) == 9 and sum(r["n"] for r in matrix) == 12


def test_regression_and_binary_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    s = scoring.score_regression(df, "y", "p").first()
    assert s["mse"] == pytest.approx(2 / 3) and s["mae"] == pytest.approx(2 / 3)
    assert s["r_squared"] == pytest.approx(1 - 2 / (14 / 3))
    b = scoring.score_binary(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int"), "y", "p", 1).first()
    assert (b["accuracy"], b["precision"], b["sensitivity"], b["false_positive_rate"]) == (0.75, 1.0, 0.5, 0.0)


def test_kmeans_step_merges_datasets(spark):
    df = spark.createDataFrame([(float(v), "s" if v < 3 else "t") for v in [0, 1, 2, 10, 11, 12]], "x double, site string")
    states = kmeans.kmeans_states(df, ["x"], [[0.0], [20.0]], ["site"])
    new = {r["cluster"]: (r["n"], r["x"]) for r in kmeans.kmeans_step(states, ["x"]).collect()}
    assert new == {0: (4, 13 / 4), 1: (2, 11.5)}
    model = kmeans.kmeans(df, ["x"], 2)
    assert sorted(c[0] for c in model.centres) == pytest.approx([1.0, 11.0])


def separable(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        c = ["low", "mid", "high"][i % 3]
        rows.append((i, c, float(rng.normal({"low": -6, "mid": 0, "high": 6}[c])), float(rng.normal())))
    return spark.createDataFrame(rows, "id int, y string, x double, z double")


@pytest.mark.parametrize("fit", [
    lambda df: linear.linear_model(df, "y", ["x", "z"], penalty="none"),
    lambda df: linear.linear_model(df, "y", ["x", "z"], penalty="elasticnet"),
    lambda df: neural.neural_network(df.coalesce(2), "y", ["x", "z"], "8", learning_rate_init=0.05, rounds=15),
    lambda df: boosting.gradient_boosting(df, "y", ["x", "z"], n_estimators=3),
    lambda df: knn.knn_fit(df, "id", "y", ["x", "z"]),
    lambda df: naive_bayes.naive_bayes_fit(df, "y", ["x", "z"]),
])
def test_classifiers_separate_classes(spark, fit):
    df = separable(spark)
    out = fit(df).predict(df)
    assert out.filter(F.col("prediction") == F.col("y")).count() >= 290
    assert set(df.columns) < set(out.columns)


@pytest.mark.parametrize("activation", neural.ACTIVATIONS)
def test_network_gradient(activation):
    net = neural.Network([3, 4, 2], activation, True)
    rng = np.random.default_rng(0)
    w, x = net.start(1), rng.normal(size=(6, 3))
    y = np.eye(2)[rng.integers(0, 2, 6)]

    def loss(w):
        reg = sum((m[:-1] ** 2).sum() for m in net.layers(w)) * 0.1 / 2 / len(x)
        return -(y * np.log(net.forward(w, x)[-1])).sum() / len(x) + reg

    numeric = np.array([(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
    np.testing.assert_allclose(net.gradient(w, x, y, 0.1), numeric, atol=1e-6)


def test_regressors_beat_the_mean(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(x), float(3 * x + rng.normal(0, 0.1))) for i, x in enumerate(rng.normal(size=300))],
                               "id int, x double, y double")
    for model in (linear.linear_model(df, "y", ["x"]), boosting.gradient_boosting(df, "y", ["x"], n_estimators=10),
                  neural.neural_network(df.coalesce(2), "y", ["x"], "8", learning_rate_init=0.05, rounds=15)):
        s = scoring.score_regression(model.predict(df), "y", "prediction").first()
        assert s["r_squared"] > 0.8


def test_l1_penalty_drops_inputs(spark):
    df = separable(spark).withColumn("target", 2 * F.col("x"))
    coef = {r["term"]: r["coef"] for r in linear.linear_model(df, "target", ["x", "z"], alpha=1.0, penalty="l1").rows(spark).collect()}
    assert coef["z"] == 0.0 and coef["x"] > 0
    with pytest.raises(ValueError):
        linear.linear_model(df, "target", ["x"], penalty="l3")


def dense_walk(subjects, classes, n_columns, damping, iters):
    """Reference walk over the explicit subject-to-subject matrix."""
    n = len(subjects)
    step = np.zeros((n, n))
    for i, a in enumerate(subjects):
        held = [c for c in range(n_columns) if a[1 + c] is not None]
        for c in held:
            same = [j for j, b in enumerate(subjects) if b[1 + c] == a[1 + c]]
            for j in same:
                step[j, i] += 1 / len(held) / len(same)
    out = {}
    for cls in classes:
        r = np.array([1.0 if s[0] == cls else 0.0 for s in subjects])
        r /= r.sum()
        s = r.copy()
        for _ in range(iters):
            s = (1 - damping) * r + damping * step @ s
        out[cls] = s
    return out


def test_network_features_equal_the_dense_walk(spark):
    rng = np.random.default_rng(8)
    subjects = [(str(rng.choice(["p", "q"])), str(rng.choice(list("abc"))), None if i % 9 == 0 else str(rng.choice(list("uv"))))
                for i in range(40)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(subjects)], "id int, y string, c1 string, c2 string")
    want = dense_walk(subjects, ["p", "q"], 2, 0.85, 6)
    got = sorted(network.network_features(df, "id", "y", ["c1", "c2"], iters=6, normalize=False).collect())
    np.testing.assert_allclose([r["ppr_p"] for r in got], want["p"], atol=1e-12)
    np.testing.assert_allclose([r["ppr_q"] for r in got], want["q"], atol=1e-12)


def test_subgroups_find_the_planted_rule(spark):
    rows = [("hit" if a == "x" and b == "u" else "miss", a, b) for a in "xyz" for b in "uvw" for _ in range(20)]
    df = spark.createDataFrame(rows, "y string, a string, b string")
    best = subgroups.subgroups(df, "y", ["a", "b"], support=0.05).filter("target = 'y=hit'").orderBy(F.desc("lift")).first()
    assert best["rule"] == "a=x, b=u" and best["cov"] == 20 and best["prec"] == 1.0 and best["lift"] == pytest.approx(9.0)
    assert best["pval"] < 1e-6


def test_subgroup_numbers_against_brute_force(spark):
    rng = np.random.default_rng(9)
    data = [(str(rng.choice(["p", "q"])), str(rng.choice(list("ab"))), str(rng.choice(list("uvw")))) for _ in range(200)]
    df = spark.createDataFrame(data, "y string, a string, b string")
    got = subgroups.subgroups(df, "y", ["a", "b"], beam=100, support=0.0, alpha=1.0).collect()
    for r in got:
        conds = dict(c.split("=") for c in r["rule"].split(", "))
        cover = [d for d in data if all(d["yab".index(k)] == v for k, v in conds.items())]
        pos = [d for d in cover if d[0] == r["target"].split("=")[1]]
        assert (r["cov"], r["pos"]) == (len(cover), len(pos))


def test_repeated_query_keys_are_refused(spark):
    rows = [(i, float(i), float(2 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = knn.knn_fit(df, "id", "y", ["x"], 3)
    with pytest.raises(ValueError, match="repeat"):
        model.predict(df.union(df))


def test_boosted_rows_all_come_back(spark):
    rows = [(i, None if i % 4 == 0 else float(i), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = boosting.gradient_boosting(df, "y", ["x"], n_estimators=2)
    out = model.predict(df).collect()
    assert len(out) == 40 and sum(r["prediction"] is None for r in out) == 10
    assert model.rows(spark).count() == 2


def test_network_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    rows = [(i, float(a), float(b), "in" if a * a + b * b < 1 else "out") for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    found = []
    for parts in (2, 8):
        model = neural.neural_network(df.repartition(parts), "y", ["a", "b"], "16", rounds=4)
        found.append({r["id"]: r["prediction"] for r in model.predict(df).collect()})
    assert found[0] == found[1]
    assert model.rows(spark).count() == 3 * 16 + 17 * 2
