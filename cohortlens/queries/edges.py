"""Rows that clean tables lack: far groups, nulls and NaN, odd names; and results whole from one mining call."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, ExperimentQuery, FeatureTable, MiningQuery, ValidationSpec
from cohortlens.operators import bands, boosting, histogram, profile, regression, subgroups, summary
from cohortlens.plans import validation
from cohortlens.plans.cached import cached_mining
from cohortlens.plans.experiment import run_experiment
from cohortlens.plans.mining import run_mining
from cohortlens.queries import COHORT_SQL, cohort, joined, query, rounded, table
from cohortlens.queries.statistics import _BAND_Z, _histogram, _histogram_sql
from cohortlens.queries.stores import _event_stream, _folder
from cohortlens.sources import cache, results
from cohortlens.sources.tables import Catalog
from cohortlens.streaming import states

_FAR = 1e9


def _far(df, value: str, group: str, at: str):
    """The values of one group moved far away from the others'."""
    return df.withColumn("x", F.col(value) + F.when(F.col(group) == at, F.lit(_FAR)).otherwise(0.0))


@query("summary_far_groups", f"""
SELECT l_returnflag AS "group", count(*) AS "count", round(avg(l_quantity), 4) AS mean_inside, round(stddev_samp(l_quantity), 4) AS std
FROM lineitem GROUP BY 1""")
def summary_far_groups(spark, d):
    out = summary.summary_statistics(_far(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "N"), ["x"], ["l_returnflag"])
    out = out.select(joined("group"), "count", "mean", "std").filter("group <> 'all'")
    inside = F.col("mean") - F.when(F.col("group") == "N", F.lit(_FAR)).otherwise(0.0)
    return out.select("group", "count", F.round(inside, 4).alias("mean_inside"), F.round("std", 4).alias("std"))


@query("bands_far_groups", f"""
SELECT l_returnflag AS "group", round({_BAND_Z} * 2 * stddev_samp(l_quantity) / sqrt(count(*)), 4) AS width FROM lineitem GROUP BY 1""")
def bands_far_groups(spark, d):
    out = bands.group_confidence_bands(_far(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "N"), ["x"], ["l_returnflag"])
    return out.select("group", F.round(F.col("upper") - F.col("lower"), 4).alias("width"))


@query("regression_far_groups", """
SELECT l_returnflag AS "group", round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY 1""")
def regression_far_groups(spark, d):
    rows = _far(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "N")
    out = regression.linear_regression_by(rows, "l_extendedprice", ["x"], "l_returnflag")
    return out.filter("term = 'x' AND group <> 'all'").select("group", F.round("coef", 3).alias("slope"))


@query("stream_far_groups", """
SELECT event_type, count(*) AS "count", round(stddev_samp(value), 4) AS std FROM events GROUP BY 1""")
def stream_far_groups(spark, d):
    path = _folder(spark, "stream")
    far = _far(_event_stream(spark, d), "value", "event_type", "click")
    states.stream_states(far, path, ["x"], ["event_type"]).awaitTermination()
    return states.read_stream_summary(spark, path, ["event_type"]).select("event_type", "count", F.round("std", 4).alias("std"))


_SPARSE_SQL = """(SELECT o_orderkey, o_orderstatus, o_orderpriority,
 CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders)"""


def _sparse(spark, d, odd: float | None = float("nan")):
    """Orders with gaps; one status has no value at all. Every seventh gap is ``odd`` instead of null."""
    key = F.col("o_orderkey")
    gone = (key % 3 == 0) | (F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(gone, None).when(key % 7 == 0, F.lit(odd)).otherwise(F.col("o_totalprice")).alias("price"))


@query("histogram_nulls", _histogram_sql(_SPARSE_SQL, "price", "o_orderstatus"))
def histogram_nulls(spark, d):
    return _histogram(histogram.histogram(_sparse(spark, d), "price", ["o_orderstatus"]))


@query("histogram_infinite", _histogram_sql(_SPARSE_SQL, "price", None))
def histogram_infinite(spark, d):
    return _histogram(histogram.histogram(_sparse(spark, d, float("inf")), "price"))


@query("profile_nulls", _histogram_sql(_SPARSE_SQL, "price", "o_orderstatus"))
def profile_nulls(spark, d):
    _, out = profile.profile_table(_sparse(spark, d, None).select("price", "o_orderstatus"), ["o_orderstatus"])
    return _histogram(out)


@query("subgroups_nulls", f"""
WITH s AS (SELECT * FROM {_SPARSE_SQL} WHERE price IS NOT NULL), e AS (SELECT min(price) AS lo, max(price) AS hi FROM s),
b AS (SELECT o_orderstatus AS target, CAST(CAST(least(floor((price - lo) / ((hi - lo) / 4)), 3) AS INTEGER) AS VARCHAR) AS value FROM s, e)
SELECT target, value, CAST(sum(pos) OVER (PARTITION BY value) AS BIGINT) AS cov, pos
FROM (SELECT target, value, count(*) AS pos FROM b GROUP BY 1, 2)""")
def subgroups_nulls(spark, d):
    return subgroups.level_one(_sparse(spark, d), "o_orderstatus", ["price"]).select("target", "value", "cov", "pos")


@query("stream_histogram_nulls", """
SELECT CAST(b AS INTEGER) AS bin, count(value) AS "count" FROM range(20) t(b)
LEFT JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) ON least(floor(value / 5.0), 19) = b GROUP BY 1""")
def stream_histogram_nulls(spark, d):
    path, ranges = _folder(spark, "stream"), {"value": (0.0, 100.0)}
    gaps = _event_stream(spark, d).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    states.stream_states(gaps, path, ["value"], ranges=ranges).awaitTermination()
    return states.read_stream_histogram(spark, path, ranges).select("bin", "count")


@query("boosting_predict_nulls", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round(avg(o_totalprice) FILTER (o_orderkey % 5 > 0) OVER (PARTITION BY o_orderstatus), 3) END
 AS prediction FROM orders""")
def boosting_predict_nulls(spark, d):
    o = table(spark, d, "orders")
    gaps = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")))
    model = boosting.gradient_boosting(gaps, "o_totalprice", ["o_orderstatus"], n_estimators=1)
    return rounded(model.predict(gaps).select("o_orderkey", "prediction"), 3)


@query("cross_dataset_named_all", f"""
WITH c AS (SELECT x.*, length(c_mktsegment) AS width FROM {COHORT_SQL} x),
m AS (SELECT regr_slope(c_acctbal, width) AS b, regr_intercept(c_acctbal, width) AS a FROM c WHERE r_name IN ('AFRICA', 'ASIA'))
SELECT CASE r_name WHEN 'EUROPE' THEN 'all' ELSE r_name END AS dataset, count(*) AS n, round(avg((c_acctbal - a - b * width) ** 2), 3) AS mse,
 round(sqrt(avg((c_acctbal - a - b * width) ** 2)), 5) AS rmse, round(avg(abs(c_acctbal - a - b * width)), 5) AS mae,
 round(1 - avg((c_acctbal - a - b * width) ** 2) / var_pop(c_acctbal), 8) AS r_squared,
 round(1 - var_pop(c_acctbal - a - b * width) / var_pop(c_acctbal), 8) AS explained_variance
FROM c, m WHERE r_name IN ('AMERICA', 'EUROPE') GROUP BY 1""")
def cross_dataset_named_all(spark, d):
    c = cohort(spark, d).withColumn("width", F.length("c_mktsegment")).replace("EUROPE", "all", "r_name")
    trained = ["AFRICA", "ASIA"]
    model = regression.fit_linear(c.filter(F.col("r_name").isin(*trained)), "c_acctbal", ["width"])
    out = validation.validate_on_datasets(model, c, "c_acctbal", ["width"], "r_name", [*trained, "AMERICA", "all"], trained)
    return out.select("dataset", "n", F.round("mse", 3).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"),
                      F.round("r_squared", 8).alias("r_squared"), F.round("explained_variance", 8).alias("explained_variance"))


def _mine(spark, d, code: str, variables: tuple, parameters: dict | None = None, **roles):
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d).join(
        table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), "c_custkey", "r_name")])
    return run_mining(spark, catalog, MiningQuery(
        variables=variables, target_table="cohort", algorithm=AlgorithmSpec(code, parameters or {}), **roles))


@query("crosstab_all_pairs", "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, count(*) AS n FROM {COHORT_SQL} GROUP BY ALL"
    for a, b in (("c_mktsegment", "n_name"), ("c_mktsegment", "r_name"), ("n_name", "r_name"))))
def crosstab_all_pairs(spark, d):
    return _mine(spark, d, "correlationHeatmap", ("c_mktsegment",), covariables=("n_name", "r_name")).data


_PAIR = "(SELECT corr(c_acctbal, c_nationkey) AS r FROM customer)"


@query("mining_pca", "\nUNION ALL ".join(
    f"""SELECT '{pc}' AS component, round(50 * (1 {sign} abs(r)), 6) AS explained_variance, '{v}' AS variable,
 round({w}, 6) AS loading FROM {_PAIR}""" for pc, sign, v, w in (
        ("PC1", "+", "c_acctbal", "sqrt(0.5)"), ("PC1", "+", "c_nationkey", "sign(r) * sqrt(0.5)"),
        ("PC2", "-", "c_acctbal", "sqrt(0.5)"), ("PC2", "-", "c_nationkey", "-sign(r) * sqrt(0.5)"))))
def mining_pca(spark, d):
    out = _mine(spark, d, "pca", ("c_acctbal",), covariables=("c_nationkey",)).data
    return rounded(out.select("component", "explained_variance", F.explode("loadings").alias("variable", "loading")))


@query("mining_pca_scores", """
WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a,
 (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b, sign(corr(c_acctbal, c_nationkey) OVER ()) AS s FROM customer)
SELECT c_custkey, round((a + s * b) * sqrt(0.5), 5) AS "PC1", round((a - s * b) * sqrt(0.5), 5) AS "PC2" FROM z""")
def mining_pca_scores(spark, d):
    return rounded(_mine(spark, d, "pca", ("c_acctbal",), {"result": "scores"}, covariables=("c_nationkey",)).data, 5)


# every customer is in the cluster of the centre that is nearest to its balance
@query("mining_kmeans", "SELECT c_custkey, TRUE AS nearest FROM customer")
def mining_kmeans(spark, d):
    found = _mine(spark, d, "kmeans", ("c_acctbal",), {"result": "assignments"}).data
    centres = _mine(spark, d, "kmeans", ("c_acctbal",)).data.collect()  # one row per cluster
    away = F.create_map(*[x for r in centres for x in (F.lit(r["cluster"]), F.abs(F.col("c_acctbal") - r["c_acctbal"]))])
    rows = found.join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rows.select("c_custkey", (F.element_at(away, F.col("cluster")) <= F.array_min(F.map_values(away)) + 1e-9).alias("nearest"))


@query("bands_two_groupings", f"""
SELECT c_mktsegment || ', ' || r_name AS "group", 'c_acctbal' AS variable, count(*) AS n, round(avg(c_acctbal), 5) AS mean,
 round(stddev_samp(c_acctbal), 5) AS std FROM {COHORT_SQL} GROUP BY ALL""")
def bands_two_groupings(spark, d):
    out = _mine(spark, d, "groupConfidenceBands", ("c_acctbal",), grouping=("c_mktsegment", "r_name")).data
    return rounded(out.select("group", "variable", "n", "mean", "std"), 5)


@query("fingerprint_follows_content", "SELECT TRUE AS same_in_other_order, FALSE AS same_after_an_edit FROM (SELECT count(*) FROM nation)")
def fingerprint_follows_content(spark, d):
    n = table(spark, d, "nation")
    edited = n.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("CHANGED")).otherwise(F.col("n_name")))
    marks = [tuple(cache.table_fingerprint(x).first()) for x in (n, n.repartition(3).orderBy(F.desc("n_name")), edited)]
    first, other, third = marks
    return spark.createDataFrame([(first == other, first == third)], "same_in_other_order boolean, same_after_an_edit boolean")


# the second of two equal queries comes from the cache
@query("mining_cached", f"""
SELECT r_name AS "group", count(*) AS n, round(avg(c_acctbal), 5) AS mean, TRUE AS second_from_cache, FALSE AS first_from_cache
FROM {COHORT_SQL} GROUP BY 1""")
def mining_cached(spark, d):
    path = _folder(spark, "cache")
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    asked = MiningQuery(variables=("c_acctbal",), target_table="cohort", grouping=("r_name",),
                        algorithm=AlgorithmSpec("groupConfidenceBands"))
    first, second = (cached_mining(spark, catalog, asked, path) for _ in range(2))
    row = F.from_json("row", "group string, n long, mean double").alias("r")
    return second.data.select(row).select(
        "r.group", "r.n", F.round("r.mean", 5).alias("mean"), F.lit(second.from_cache).alias("second_from_cache"),
        F.lit(first.from_cache).alias("first_from_cache"))


# two datasets: one state each, merged
@query("mining_map_reduce", f"""
WITH c AS (SELECT x.*, length(c_mktsegment) AS width FROM {COHORT_SQL} x WHERE r_name IN ('ASIA', 'EUROPE'))
SELECT 'intercept' AS term, round(regr_intercept(c_acctbal, width), 5) AS coef, TRUE AS merged FROM c
UNION ALL SELECT 'width', round(regr_slope(c_acctbal, width), 5), TRUE FROM c""")
def mining_map_reduce(spark, d):
    catalog = Catalog([FeatureTable(
        "cohort", lambda s: cohort(s, d).withColumn("width", F.length("c_mktsegment")), "c_custkey", "r_name")])
    out = run_mining(spark, catalog, MiningQuery(
        variables=("c_acctbal",), target_table="cohort", covariables=("width",), datasets=("ASIA", "EUROPE"),
        algorithm=AlgorithmSpec("linearRegression")))
    return out.data.select("term", F.round("coef", 5).alias("coef"), F.lit(out.merged).alias("merged"))


@query("stream_compacted", """
SELECT event_type, count(*) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1""")
def stream_compacted(spark, d):
    path = _folder(spark, "stream")
    events = table(spark, d, "events")
    for batch in range(4):  # as four micro-batches leave them
        part = events.filter(F.pmod("event_id", F.lit(4)) == batch)
        states.moment_states(part, ["value"], ["event_type"]).write.parquet(f"{path}/moments/batch={batch}")
        states.compact_states(spark, path, ["event_type"])
    return rounded(states.read_stream_summary(spark, path, ["event_type"]).select("event_type", "count", "mean", "std"))


@query("binary_model_results", """
SELECT CAST(event_id AS VARCHAR) AS job_id, 'serialized_model' AS kind, event_type || '-' || event_id AS model FROM events""")
def binary_model_results(spark, d):
    path = _folder(spark, "models")
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.lit("node").alias("node"), F.col("ts").alias("timestamp"),
        F.lit("serialized_model").alias("shape"), F.lit("fit").alias("function"), F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("error"),
        F.concat_ws("-", "event_type", F.col("event_id").cast("string")).cast("binary").alias("model"))
    results.to_result_rows(rows).write.parquet(path)
    back = results.read_job_results(spark.read.parquet(path))
    return back.select("job_id", "kind", results.decode_model(F.col("data")).cast("string").alias("model"))


def _experiment(spark, d):
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    return run_experiment(spark, catalog, ExperimentQuery(
        variables=("c_mktsegment",), covariables=("c_acctbal",), target_table="cohort",
        algorithms=(AlgorithmSpec("naiveBayes"), AlgorithmSpec("statisticsSummary"), AlgorithmSpec("anova")),
        validations=(ValidationSpec("kfold", {"k": 2}),), training_datasets=("AFRICA", "ASIA"),
        validation_datasets=("EUROPE", "ASIA")))


_TRAINED = f"(SELECT * FROM {COHORT_SQL} WHERE r_name IN ('AFRICA', 'ASIA'))"


# a model row per class, two folds and the pooled row, one other dataset; a nominal target is an error for ANOVA
@query("experiment_parts", f"""
SELECT 0 AS position, 'naiveBayes' AS algorithm, 'model' AS result, count(DISTINCT c_mktsegment) AS n FROM {_TRAINED}
UNION ALL SELECT 0, 'naiveBayes', 'kfold', 3 UNION ALL SELECT 0, 'naiveBayes', 'document', 1
UNION ALL SELECT 0, 'naiveBayes', 'datasets', 1 UNION ALL SELECT 1, 'statisticsSummary', 'result', 2
UNION ALL SELECT 2, 'anova', 'error', 1""")
def experiment_parts(spark, d):
    return _experiment(spark, d).groupBy("position", "algorithm", "result").agg(F.count("*").alias("n"))


@query("experiment_model", f"""
SELECT c_mktsegment AS class, round(ln(count(*) / (SELECT count(*) FROM {_TRAINED})), 8) AS log_prior, round(avg(c_acctbal), 5) AS mean
FROM {_TRAINED} GROUP BY 1""")
def experiment_model(spark, d):
    rows = _experiment(spark, d).filter("result = 'model'").select(
        F.from_json("data", "class string, log_prior double, mean double").alias("m")).select("m.*")
    return rows.select("class", F.round("log_prior", 8).alias("log_prior"), F.round("mean", 5).alias("mean"))
