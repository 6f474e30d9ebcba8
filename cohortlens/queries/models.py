"""Predictive models, clustering, network features, subgroups, scores and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, ExperimentQuery, FeatureTable, ValidationSpec
from cohortlens.operators import boosting, hist_boosting, kmeans, knn, linear, naive_bayes, network, neural, regression, scoring, subgroups
from cohortlens.plans import experiment, federation, validation
from cohortlens.queries import COHORT_SQL, cohort, kfold_sql, query, rounded, table
from cohortlens.sources.tables import Catalog

CENTRES = [[10.0, 920.0], [25.0, 1000.0], [40.0, 1080.0]]


def _near_sql(queries: str, qkey: str, train: str, tkey: str, y: str, pairs: list, k: int, where: str = "TRUE") -> str:
    """The k nearest training rows of each query row; ties by training key."""
    d2 = " + ".join(f"(q.{a} - t.{b}) * (q.{a} - t.{b})" for a, b in pairs)
    return f"""SELECT * FROM (SELECT q.{qkey} AS qkey, t.{y} AS y, row_number() OVER
  (PARTITION BY q.{qkey} ORDER BY {d2}, t.{tkey}) AS rn FROM {queries} q, {train} t WHERE {where}) WHERE rn <= {k}"""


def _vote_sql(near: str) -> str:
    return f"""SELECT qkey, first(y ORDER BY n DESC, y) AS prediction FROM
  (SELECT qkey, y, count(*) AS n FROM ({near}) GROUP BY ALL) GROUP BY qkey"""


_NATION_PAIRS = [("s_nationkey", "c_nationkey"), ("s_acctbal", "c_acctbal")]


def _customers(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), "c_mktsegment", "c_acctbal")


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))


@query("knn_classification", "SELECT qkey AS \"key\", prediction FROM (" + _vote_sql(_near_sql(
    "supplier", "s_suppkey", "customer", "c_custkey", "c_mktsegment", _NATION_PAIRS, 5)) + ")")
def knn_classification(spark, d):
    model = knn.knn_fit(_customers(spark, d), "key", "c_mktsegment", ["nation", "balance"], 5)
    return model.predict(_suppliers(spark, d)).select("key", "prediction")


# every part predicted from the parts of the other folds
@query("knn_regression_held_out", f"""
WITH s AS (SELECT p_partkey, p_size, p_retailprice, {kfold_sql('p_partkey', 3)} AS f FROM part)
SELECT n.qkey AS p_partkey, round(avg(n.y), 6) AS prediction FROM ({_near_sql(
    's', 'p_partkey', 's', 'p_partkey', 'p_retailprice', [('p_size', 'p_size')], 5, 'q.f <> t.f')}) n GROUP BY 1""")
def knn_regression_held_out(spark, d):
    from cohortlens.operators.folds import kfold_split, split_column

    split = kfold_split(table(spark, d, "part"), "p_partkey", 3)
    out = validation.held_out_predictions("knn", split, "p_retailprice", ["p_size"], "p_partkey", split_column(3), 3)
    return rounded(out.select("p_partkey", "prediction"))


@query("knn_merged_datasets", "SELECT qkey AS \"key\", prediction FROM (" + _vote_sql(_near_sql(
    "supplier", "s_suppkey", "(SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))",
    "c_custkey", "c_mktsegment", _NATION_PAIRS, 5)) + ")")
def knn_merged_datasets(spark, d):
    states = federation.partial_neighbours(
        _customers(spark, d), _suppliers(spark, d), "key", "key", "c_mktsegment", ["nation", "balance"],
        "c_mktsegment", ["BUILDING", "MACHINERY"])
    return federation.merge_neighbours(states, "key", 5, True)


def _centres_sql() -> str:
    return "(VALUES " + ", ".join(f"({i}, {s}::DOUBLE, {p}::DOUBLE)" for i, (s, p) in enumerate(CENTRES)) + ") c(cluster, s, p)"


_ASSIGN_SQL = f"""(SELECT p_partkey, p_size, p_retailprice, p_brand, cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, cluster) AS rn
 FROM (SELECT part.*, cluster, (p_size - s) * (p_size - s) + (p_retailprice - p) * (p_retailprice - p) AS d2 FROM part, {_centres_sql()})) WHERE rn = 1)"""


@query("kmeans_step", f"""
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(sum(d2), 4) AS inertia, round(avg(p_size), 6) AS p_size,
  round(avg(p_retailprice), 6) AS p_retailprice FROM {_ASSIGN_SQL} GROUP BY 1""")
def kmeans_step(spark, d):
    states = federation.partial_state("kmeans", table(spark, d, "part"), ["p_size", "p_retailprice"], "p_brand", centres=CENTRES)
    out = federation.merge_state("kmeans", states, columns=["p_size", "p_retailprice"])
    return rounded(out.withColumn("inertia", F.round("inertia", 4)))


@query("kmeans_assign", f"SELECT p_partkey, CAST(cluster AS INTEGER) AS cluster FROM {_ASSIGN_SQL}")
def kmeans_assign(spark, d):
    model = kmeans.KMeansModel(["p_size", "p_retailprice"], CENTRES)
    return model.predict(table(spark, d, "part")).select("p_partkey", "cluster")


def _lloyd_sql(steps: int) -> str:
    """Lloyd steps from CENTRES, one table of centres per step."""
    ctes = [f"c0 AS (SELECT cluster, s, p FROM {_centres_sql()})"]
    for i in range(steps):
        ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.s, c{i}.s) AS s, coalesce(m.p, c{i}.p) AS p FROM c{i} LEFT JOIN (
  SELECT cluster, avg(p_size) AS s, avg(p_retailprice) AS p FROM (
   SELECT p_partkey, p_size, p_retailprice, cluster, row_number() OVER (PARTITION BY p_partkey ORDER BY
    (p_size - s) * (p_size - s) + (p_retailprice - p) * (p_retailprice - p), cluster) AS rn FROM part, c{i}) WHERE rn = 1 GROUP BY 1) m
  ON m.cluster = c{i}.cluster)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT CAST(cluster AS INTEGER) AS cluster, round(s, 6) AS p_size, round(p, 6) AS p_retailprice FROM c{steps}"""


@query("kmeans_lloyd", _lloyd_sql(4))
def kmeans_lloyd(spark, d):
    model = kmeans.lloyd(table(spark, d, "part"), ["p_size", "p_retailprice"], CENTRES, 4, ["p_brand"])
    return rounded(model.centre_rows(spark))


@query("kmeans")
def kmeans_centres(spark, d):
    return rounded(kmeans.kmeans(table(spark, d, "part"), ["p_size", "p_retailprice"]).centre_rows(spark), 4)


_NB_FLOOR = "(SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_extendedprice)) FROM lineitem)"


@query("naive_bayes_model", "\nUNION ALL ".join(f"""
SELECT l_returnflag AS class, round(ln(count(*) / (SELECT count(*) FROM lineitem)), 8) AS log_prior, '{v}' AS variable,
  round(avg({v}), 6) AS mean, round(var_pop({v}) + {_NB_FLOOR}, 3) AS variance FROM lineitem GROUP BY 1"""
    for v in ("l_quantity", "l_extendedprice")))
def naive_bayes_model(spark, d):
    model = naive_bayes.naive_bayes_fit(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    out = model.rows(spark)
    return out.select("class", F.round("log_prior", 8).alias("log_prior"), "variable",
                      F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"))


def _gauss(v: str, p: str) -> str:
    return f"- ({v} - {p}m) * ({v} - {p}m) / (2 * {p}v) - 0.5 * ln(2 * pi() * {p}v)"


# numeric inputs by class densities, nominal ones by smoothed frequencies over all categories
_MIXED_SQL = f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS y, o_totalprice AS x, o_orderpriority AS c FROM orders),
floor AS (SELECT 1e-9 * var_pop(x) AS f FROM o),
g AS (SELECT y, ln(count(*) / (SELECT count(*) FROM o)) AS prior, avg(x) AS xm, var_pop(x) + (SELECT f FROM floor) AS xv, count(*) AS seen FROM o GROUP BY 1),
cats AS (SELECT count(DISTINCT c) AS k FROM o),
pc AS (SELECT g.y, v.c, ln((count(o.c) + 1.0) / (any_value(g.seen) + (SELECT k FROM cats))) AS lp
  FROM g CROSS JOIN (SELECT DISTINCT c FROM o) v LEFT JOIN o ON o.y = g.y AND o.c = v.c GROUP BY ALL),
ll AS (SELECT o.o_orderkey, g.y AS label, g.prior {_gauss('o.x', 'g.x')} + pc.lp AS ll
  FROM o, g, pc WHERE pc.y = g.y AND pc.c = o.c)
SELECT o_orderkey, first(label ORDER BY ll DESC, label) AS prediction FROM ll GROUP BY 1"""


@query("naive_bayes_predict", _MIXED_SQL)
def naive_bayes_predict(spark, d):
    o = table(spark, d, "orders")
    model = naive_bayes.naive_bayes_fit(o, "o_orderstatus", ["o_totalprice", "o_orderpriority"])
    return model.predict(o).select("o_orderkey", "prediction")


def _multiclass_sql(source: str, group: str) -> str:
    """Weighted scores of (actual, prediction) rows, with a 0 where nothing was predicted."""
    return f"""SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 8) AS accuracy, round(sum(n / t * p), 8) AS weighted_precision,
  round(sum(n / t * r), 8) AS weighted_recall, round(sum(n / t * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 8) AS weighted_f1,
  round(sum(n / t * CASE WHEN t > n THEN (pred - tp) / (t - n) ELSE 0 END), 8) AS weighted_fpr FROM (
  SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r, sum(n) OVER (PARTITION BY fold) AS t FROM (
   SELECT fold, c, count(*) FILTER (WHERE actual = c) AS n, count(*) FILTER (WHERE prediction = c) AS pred,
    count(*) FILTER (WHERE actual = c AND prediction = c) AS tp
   FROM (SELECT {group} AS fold, actual, prediction FROM {source}) s,
    (SELECT actual AS c FROM {source} UNION SELECT prediction FROM {source}) GROUP BY fold, c)) GROUP BY fold"""


def _cv_source(k: int) -> str:
    return f"""WITH s AS (SELECT o_orderkey, o_orderstatus AS y, o_totalprice AS x, {kfold_sql('o_orderkey', k)} AS f FROM orders),
m AS (SELECT i AS f, y, count(*) AS c, avg(x) AS xm, var_pop(x) AS vp FROM s, range(1, {k + 1}) t(i) WHERE s.f <> i GROUP BY ALL),
w AS (SELECT i AS f, 1e-9 * var_pop(x) AS fl, count(*) AS t FROM s, range(1, {k + 1}) q(i) WHERE s.f <> i GROUP BY ALL),
ll AS (SELECT s.o_orderkey, s.f, s.y AS actual, m.y AS label, ln(m.c / w.t)
  - (s.x - m.xm) * (s.x - m.xm) / (2 * (m.vp + w.fl)) - 0.5 * ln(2 * pi() * (m.vp + w.fl)) AS ll
  FROM s JOIN m ON m.f = s.f JOIN w ON w.f = s.f),
p AS MATERIALIZED (SELECT o_orderkey, f, any_value(actual) AS actual, first(label ORDER BY ll DESC, label) AS prediction FROM ll GROUP BY 1, 2)"""


@query("cross_validate_naive_bayes", _cv_source(4) + "\n" + _multiclass_sql("p", "CAST(f AS VARCHAR)")
       + "\nUNION ALL " + _multiclass_sql("p", "'all'"))
def cross_validate_naive_bayes(spark, d):
    return rounded(validation.cross_validate(
        "naiveBayes", table(spark, d, "orders"), "o_orderstatus", ["o_totalprice"], "o_orderkey", 4), 8)


@query("held_out_regression", f"""
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS y, l_quantity AS x, CAST(l_linenumber AS INTEGER) AS f FROM lineitem),
m AS (SELECT i AS f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s, (SELECT DISTINCT f AS i FROM s) WHERE f <> i GROUP BY 1)
SELECT s.f AS fold, count(*) AS n, round(avg((y - a - b * x) ** 2), 3) AS mse FROM s JOIN m ON s.f = m.f GROUP BY 1""")
def held_out_regression(spark, d):
    """Each line number is a fold; all fold models come from one scan."""
    li = table(spark, d, "lineitem")
    models = regression.fold_models(li, "l_extendedprice", ["l_quantity"], "l_linenumber")
    predicted = naive_bayes.predict_by_fold(li, models, "l_linenumber")
    error = F.col("l_extendedprice") - F.col("prediction")
    out = predicted.groupBy(F.col("l_linenumber").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"))
    return rounded(out, 3)


_RULE_SQL = """(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS actual,
  CASE WHEN o_totalprice >= 250000 THEN '1' ELSE '0' END AS prediction, o_orderpriority AS fold FROM orders)"""


def _rule(spark, d):
    return table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("actual"),
        F.when(F.col("o_totalprice") >= 250000, "1").otherwise("0").alias("prediction"),
        F.col("o_orderpriority").alias("fold"))


@query("score_binary", f"""
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(tp / (tp + fp), 8) AS "precision",
  round(tp / (tp + fn), 8) AS sensitivity, round(fp / (fp + tn), 8) AS false_positive_rate FROM (
 SELECT coalesce(fold, 'all') AS fold, count(*) FILTER (WHERE actual = '1' AND prediction = '1') AS tp,
  count(*) FILTER (WHERE actual = '1' AND prediction = '0') AS fn, count(*) FILTER (WHERE actual = '0' AND prediction = '1') AS fp,
  count(*) FILTER (WHERE actual = '0' AND prediction = '0') AS tn FROM {_RULE_SQL} GROUP BY GROUPING SETS ((fold), ()))""")
def score_binary(spark, d):
    return rounded(scoring.score_binary(_rule(spark, d), "actual", "prediction", "1", "fold"), 8)


@query("score_multiclass", "\nUNION ALL ".join("SELECT * FROM (" + _multiclass_sql(
    f"(SELECT l_returnflag AS actual, CASE WHEN l_quantity < 20 THEN 'A' ELSE 'N' END AS prediction, {by} AS l_linestatus FROM lineitem)",
    "l_linestatus") + ")" for by in ("l_linestatus", "'all'")))
def score_multiclass(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("actual"), F.when(F.col("l_quantity") < 20, "A").otherwise("N").alias("prediction"),
        F.col("l_linestatus").alias("fold"))
    return rounded(scoring.score_multiclass(li, "actual", "prediction", by="fold"), 8)


@query("confusion_matrix", """
SELECT a AS actual, p AS predicted, count(l_returnflag) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) x(a) CROSS JOIN
 (VALUES ('A'), ('N'), ('R'), ('X')) y(p) LEFT JOIN lineitem ON l_returnflag = a AND (CASE WHEN l_quantity < 20 THEN 'A' ELSE 'N' END) = p GROUP BY ALL""")
def confusion_matrix(spark, d):
    li = table(spark, d, "lineitem").withColumn("guess", F.when(F.col("l_quantity") < 20, "A").otherwise("N"))
    return scoring.confusion(li, "l_returnflag", "guess", ["A", "N", "R", "X"])


def _regression_scores_sql(source: str, y: str, yhat: str, by: str | None) -> str:
    key = f"coalesce({by}, 'all') AS {by}," if by else ""
    group = f"GROUP BY GROUPING SETS (({by}), ())" if by else ""
    e = f"({y} - {yhat})"
    return f"""SELECT {key} count(*) AS n, round(avg({e} * {e}), 3) AS mse, round(sqrt(avg({e} * {e})), 6) AS rmse, round(avg(abs{e}), 6) AS mae,
  round(1 - avg({e} * {e}) / var_pop({y}), 8) + 0.0 AS r_squared, round(1 - var_pop({e}) / var_pop({y}), 8) + 0.0 AS explained_variance FROM {source} {group}"""


def _score_rows(df):
    return rounded(df.withColumn("mse", F.round("mse", 3)).withColumn("rmse", F.round("rmse", 6))
                   .withColumn("mae", F.round("mae", 6)), 8)


@query("score_regression", _regression_scores_sql("lineitem", "l_extendedprice", "(2000 * l_quantity)", "l_returnflag"))
def score_regression(spark, d):
    li = table(spark, d, "lineitem").withColumn("guess", 2000 * F.col("l_quantity"))
    return _score_rows(scoring.score_regression(li, "l_extendedprice", "guess", "l_returnflag"))


_ACROSS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


# trained on two regions, scored on each of the others
@query("cross_dataset_validation", f"""
WITH c AS (SELECT x.*, length(c_mktsegment) AS width FROM {COHORT_SQL} x),
m AS (SELECT regr_slope(c_acctbal, width) AS b, regr_intercept(c_acctbal, width) AS a FROM c WHERE r_name IN ('AFRICA', 'ASIA'))
SELECT dataset, n, rmse, mae FROM ({_regression_scores_sql(
    "(SELECT r_name AS dataset, c_acctbal, a + b * width AS guess FROM c, m WHERE r_name IN ('AMERICA', 'EUROPE'))",
    "c_acctbal", "guess", "dataset")}) WHERE dataset <> 'all'""")
def cross_dataset_validation(spark, d):
    c = cohort(spark, d).withColumn("width", F.length("c_mktsegment"))
    trained = ["AFRICA", "ASIA"]
    model = regression.fit_linear(c.filter(F.col("r_name").isin(*trained)), "c_acctbal", ["width"])
    out = validation.validate_on_datasets(model, c, "c_acctbal", ["width"], "r_name", _ACROSS, trained)
    return rounded(out.select("dataset", "n", "rmse", "mae"))


@query("validate_model", f"""
WITH m AS (SELECT regr_slope(c_acctbal, c_nationkey) AS b, regr_intercept(c_acctbal, c_nationkey) AS a FROM customer)
SELECT * FROM ({_regression_scores_sql('(SELECT s_acctbal, a + b * s_nationkey AS guess FROM supplier, m)', 's_acctbal', 'guess', None)})""")
def validate_model(spark, d):
    model = regression.fit_linear(_customers(spark, d), "c_acctbal", ["nation"])
    s = _suppliers(spark, d).withColumn("c_acctbal", F.col("balance"))
    return _score_rows(validation.validate_model(model, s, "c_acctbal", ["nation"]))


@query("linear_model_classification")
def linear_model_classification(spark, d):
    model = linear.linear_model(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_linestatus"],
                                penalty="elasticnet", alpha=0.01)
    return rounded(model.rows(spark), 4)


@query("linear_model_regression")
def linear_model_regression(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(linear.linear_model(li, "l_extendedprice", ["l_quantity", "l_discount"], alpha=0.1, penalty="l1").rows(spark), 3)


# without a penalty the model is the least-squares line
@query("linear_model_unpenalised", """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 3) AS prediction FROM lineitem, m""")
def linear_model_unpenalised(spark, d):
    li = table(spark, d, "lineitem")
    model = linear.linear_model(li, "l_extendedprice", ["l_quantity"], penalty="none")
    return rounded(model.predict(li).select("l_orderkey", "l_linenumber", "prediction"), 3)


# one tree that may split off every category predicts the category means
@query("gradient_boosting_first_tree", """
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 3) AS prediction FROM orders""")
def gradient_boosting_first_tree(spark, d):
    o = table(spark, d, "orders")
    model = boosting.gradient_boosting(o, "o_totalprice", ["o_orderstatus"], n_estimators=1)
    return rounded(model.predict(o).select("o_orderkey", "prediction"), 3)


# at the maximum of the likelihood, expected and observed sums of every input agree
@query("logistic_calibration", """
SELECT l_returnflag AS class, CAST(count(*) AS DOUBLE) AS rows_expected, round(sum(l_quantity), 1) AS quantity_expected,
  round(sum(l_discount), 2) AS discount_expected FROM lineitem GROUP BY 1""")
def logistic_calibration(spark, d):
    li = table(spark, d, "lineitem")
    coef: dict = {}
    for r in regression.logistic_regression(li, "l_returnflag", ["l_quantity", "l_discount"]).collect():
        coef.setdefault(r["class"], {})[r["term"]] = r["coef"]
    eta = {c: F.exp(b["intercept"] + b["l_quantity"] * F.col("l_quantity") + b["l_discount"] * F.col("l_discount"))
           for c, b in coef.items()}
    total = sum(eta.values(), F.lit(1.0))
    shares = [F.struct(F.lit("A").alias("class"), (1 / total).alias("p"))]
    shares += [F.struct(F.lit(c).alias("class"), (e / total).alias("p")) for c, e in eta.items()]
    rows = li.select("l_quantity", "l_discount", F.inline(F.array(*shares)))
    return rows.groupBy("class").agg(
        F.round(F.sum("p"), 2).alias("rows_expected"), F.round(F.sum(F.col("p") * F.col("l_quantity")), 1).alias("quantity_expected"),
        F.round(F.sum(F.col("p") * F.col("l_discount")), 2).alias("discount_expected"))


@query("neural_network")
def neural_network(spark, d):
    p = table(spark, d, "customer")
    model = neural.neural_network(p, "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return model.predict(p).select("c_custkey", "prediction")


@query("gradient_boosting")
def gradient_boosting(spark, d):
    p = table(spark, d, "part")
    model = hist_boosting.histogram_boosting(p, "p_retailprice", ["p_size", "p_type"])
    return rounded(model.predict(p).select("p_partkey", "prediction"), 4)


def _network_sql(iters: int, damping: float) -> str:
    """Walks from subjects to their values and back, one pair of tables per turn."""
    classes = ["F", "O", "P"]
    ctes = ["""n AS MATERIALIZED (SELECT o_orderkey AS id, o_orderstatus AS y, o_orderpriority AS a,
  CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 4)), 3) AS INTEGER) AS b FROM orders,
  (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders))""",
            "sz AS (SELECT y, count(*) AS c FROM n GROUP BY 1)",
            "t0 AS MATERIALIZED (SELECT n.*, " + ", ".join(
                f"CASE WHEN n.y = '{c}' THEN 1.0::DOUBLE / c ELSE 0.0::DOUBLE END AS r{j}, CASE WHEN n.y = '{c}' THEN 1.0::DOUBLE / c ELSE 0.0::DOUBLE END AS s{j}"
                for j, c in enumerate(classes)) + " FROM n JOIN sz ON n.y = sz.y)"]
    for i in range(iters):
        for v in ("a", "b"):
            ctes.append(f"{v}{i} AS (SELECT {v}, " + ", ".join(
                f"sum(s{j} / 2) / count(*) AS f{j}" for j in range(3)) + f" FROM t{i} GROUP BY 1)")
        ctes.append(f"t{i + 1} AS MATERIALIZED (SELECT t.id, t.y, t.a, t.b, " + ", ".join(
            f"t.r{j}, {1 - damping} * t.r{j} + {damping} * (x.f{j} + z.f{j}) AS s{j}" for j in range(3))
            + f" FROM t{i} t JOIN a{i} x ON t.a = x.a JOIN b{i} z ON t.b = z.b)")
    out = ", ".join(f"round(s{j} / (s0 + s1 + s2), 8) AS ppr_{c}" for j, c in enumerate(classes))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id AS o_orderkey, {out} FROM t{iters}"


@query("network_features", _network_sql(10, 0.85))
def network_features(spark, d):
    return rounded(network.network_features(
        table(spark, d, "orders"), "o_orderkey", "o_orderstatus", ["o_orderpriority", "o_totalprice"]), 8)


_BINNED_SQL = """(SELECT l_returnflag AS target, least(floor((l_quantity - qlo) / ((qhi - qlo) / 4)), 3) AS q,
  least(floor((l_extendedprice - plo) / ((phi - plo) / 4)), 3) AS p, l_linestatus AS s FROM lineitem,
  (SELECT min(l_quantity) AS qlo, max(l_quantity) AS qhi, min(l_extendedprice) AS plo, max(l_extendedprice) AS phi FROM lineitem))"""


@query("subgroups_level_one", "WITH b AS (SELECT target, CAST(CAST(q AS INTEGER) AS VARCHAR) AS l_quantity, "
       "CAST(CAST(p AS INTEGER) AS VARCHAR) AS l_extendedprice, s AS l_linestatus FROM " + _BINNED_SQL + ")\n" + "\nUNION ALL ".join(f"""
SELECT target, '{v}' AS variable, {v} AS value, CAST(sum(count(*)) OVER (PARTITION BY {v}) AS BIGINT) AS cov, count(*) AS pos,
  round(count(*) / sum(count(*)) OVER (PARTITION BY {v}), 8) AS prec, round(count(*) / sum(count(*)) OVER (PARTITION BY {v})
  / (sum(count(*)) OVER (PARTITION BY target) / sum(count(*)) OVER ()), 8) AS lift FROM b GROUP BY target, {v}"""
    for v in ("l_quantity", "l_extendedprice", "l_linestatus")))
def subgroups_level_one(spark, d):
    return rounded(subgroups.level_one(
        table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_linestatus"]), 8)


_PAIRS = [("l_quantity", "q"), ("l_extendedprice", "p"), ("l_linestatus", "s")]


def _rules_sql() -> str:
    """Every rule of one or two conditions with a lift above one."""
    sets = [[c] for _, c in _PAIRS] + [["q", "p"], ["q", "s"], ["p", "s"]]
    parts = [f"""SELECT target, {len(cs)} AS depth, CAST(sum(n) OVER (PARTITION BY {', '.join(cs)}) AS BIGINT) AS cov, n AS pos FROM
 (SELECT target, {', '.join(cs)}, count(*) AS n FROM b GROUP BY ALL)""" for cs in sets]
    return f"""WITH b AS (SELECT * FROM {_BINNED_SQL}), t AS (SELECT target, count(*) AS positives, sum(count(*)) OVER () AS total FROM b GROUP BY 1)
SELECT 'l_returnflag=' || r.target AS target, depth, cov, pos, round(pos / cov, 8) AS prec,
 round(pos / cov / (positives / total), 8) AS lift FROM ({' UNION ALL '.join(parts)}) r JOIN t ON r.target = t.target
WHERE pos / cov / (positives / total) > 1"""


@query("subgroup_rules_all", _rules_sql())
def subgroup_rules_all(spark, d):
    out = subgroups.subgroups(table(spark, d, "lineitem"), "l_returnflag", [c for c, _ in _PAIRS],
                              beam=1000, support=0.0, alpha=1.0)
    return rounded(out.select("target", "depth", "cov", "pos", "prec", "lift"), 8)


@query("subgroups")
def subgroup_rules(spark, d):
    return rounded(subgroups.subgroups(
        table(spark, d, "part"), "p_retailprice", ["p_size", "p_type", "p_brand"], support=0.01, alpha=1.0))


@query("experiment")
def run_experiment(spark, d):
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    return experiment.run_experiment(spark, catalog, ExperimentQuery(
        variables=("c_mktsegment",), covariables=("c_acctbal",), target_table="cohort",
        algorithms=(AlgorithmSpec("naiveBayes"), AlgorithmSpec("statisticsSummary"), AlgorithmSpec("anova")),
        validations=(ValidationSpec("kfold", {"k": 2}),), training_datasets=("AFRICA", "ASIA"),
        validation_datasets=("EUROPE", "ASIA"))).select("position", "algorithm", "result", "error")


# a row per class and input, and a score per fold plus the pooled one
@query("model_with_scores", """
SELECT count(DISTINCT o_orderstatus) AS model_rows, CAST(3 + 1 AS BIGINT) AS score_rows FROM orders""")
def model_with_scores(spark, d):
    model, scores = experiment.fit_and_validate(
        "naiveBayes", table(spark, d, "orders"), "o_orderstatus", ["o_totalprice"], "o_orderkey", 3)
    document = experiment.model_document(model.rows(spark), scores)
    return document.select(*[
        F.json_array_length(F.get_json_object("document", f"$.cells.{cell}")).cast("bigint").alias(name)
        for cell, name in (("model", "model_rows"), ("validations", "score_rows"))])


@query("fit_and_validate", f"""
WITH s AS (SELECT p_partkey, p_size AS x, p_retailprice AS y, {kfold_sql('p_partkey', 3)} AS f FROM part),
m AS (SELECT i AS f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s, range(1, 4) t(i) WHERE s.f <> i GROUP BY 1),
p AS (SELECT CAST(s.f AS VARCHAR) AS fold, y, a + b * x AS guess FROM s JOIN m ON s.f = m.f)
SELECT coalesce(fold, 'all') AS fold, count(*) AS n, round(avg((y - guess) ** 2), 4) AS mse, round(avg(abs(y - guess)), 5) AS mae
FROM p GROUP BY GROUPING SETS ((fold), ())""")
def fit_and_validate(spark, d):
    _, scores = experiment.fit_and_validate(
        "sgdLinearModel", table(spark, d, "part"), "p_retailprice", ["p_size"], "p_partkey", 3, parameters={"penalty": "none"})
    return scores.select("fold", "n", F.round("mse", 4).alias("mse"), F.round("mae", 5).alias("mae"))
