"""Summary statistics, histograms, regression, variance and correlation, whole and per dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, FeatureTable, MiningQuery, Rule
from cohortlens.operators import anova as anova_ops
from cohortlens.operators import bands, correlation, histogram, pca, profile, regression, summary
from cohortlens.plans import federation
from cohortlens.plans.mining import run_mining
from cohortlens.plans.registry import register_algorithm
from cohortlens.queries import COHORT_SQL, cohort, joined, query, rounded, table
from cohortlens.sources.tables import Catalog

# Averages of prices in cents can end exactly on half a digit, where engines that
# add in another order round apart; both sides shift by this much first.
NUDGE = 1e-9


def _numeric_sql(source: str, variables: list, grouping: str | None) -> str:
    """Summary rows of numeric variables, per group and overall."""
    parts = []
    for v in variables:
        for g in ([grouping] if grouping else []) + [None]:
            name = f"'{g}'" if g else "''"
            value = f"CAST({g} AS VARCHAR)" if g else "'all'"
            parts.append(f"""SELECT {name} AS group_variables, {value} AS "group", '{v}' AS "index",
  count({v}) AS "count", count(*) - count({v}) AS null_count, round(avg({v}) + {NUDGE}, 6) AS mean,
  round(stddev_samp({v}) + {NUDGE}, 6) AS std, round(sqrt(avg(CAST({v} AS DOUBLE) * {v})) + {NUDGE}, 6) AS "root EX^2",
  CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max,
  round(quantile_cont({v}::DOUBLE, 0.25), 6) AS "25%", round(quantile_cont({v}::DOUBLE, 0.5), 6) AS "50%",
  round(quantile_cont({v}::DOUBLE, 0.75), 6) AS "75%" FROM {source} {f'GROUP BY {g}' if g else ''}""")
    return "\nUNION ALL ".join(parts)


def _nudged(df, *keep, extra=()):
    """Mean, std and root mean square, rounded alike in both engines, plus other columns as they are."""
    return df.select(
        *keep, F.round(F.col("mean") + NUDGE, 6).alias("mean"), F.round(F.col("std") + NUDGE, 6).alias("std"),
        F.round(F.sqrt("`EX^2`") + NUDGE, 6).alias("root EX^2"), *extra)


def _numeric(df):
    return _nudged(
        df, joined("group_variables"), joined("group"), "index", "count", "null_count",
        extra=["min", "max", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ("25%", "50%", "75%")]])


def _nominal_sql(source: str, variables: list, grouping: str | None) -> str:
    parts = []
    for v in variables:
        for g in ([grouping] if grouping else []) + [None]:
            key = f"CAST({g} AS VARCHAR)" if g else "'all'"
            parts.append(f"""SELECT {f"'{g}'" if g else "''"} AS group_variables, k AS "group", '{v}' AS "index",
  CAST(coalesce(sum(n) FILTER (WHERE x IS NOT NULL), 0) AS BIGINT) AS "count",
  CAST(coalesce(sum(n) FILTER (WHERE x IS NULL), 0) AS BIGINT) AS null_count,
  count(x) AS "unique", first(x ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, n DESC, x) AS top,
  max(n) FILTER (WHERE x IS NOT NULL) AS frequency
  FROM (SELECT {key} AS k, CAST({v} AS VARCHAR) AS x, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY k""")
    return "\nUNION ALL ".join(parts)


def _nominal(df):
    return df.select(joined("group_variables"), joined("group"), "index", "count", "null_count", "unique", "top", "frequency")


@query("mining_summary", _numeric_sql(
    f"(SELECT * FROM {COHORT_SQL} WHERE r_name IN ('AFRICA', 'ASIA') AND c_acctbal >= 0)", ["c_acctbal"], "c_mktsegment"))
def mining_summary(spark, d):
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    result = run_mining(spark, catalog, MiningQuery(
        variables=("c_acctbal",), grouping=("c_mktsegment",), datasets=("AFRICA", "ASIA"),
        filters=Rule("c_acctbal", "greaterOrEqual", ("0",)), target_table="cohort",
        algorithm=AlgorithmSpec("statisticsSummary")))
    return _numeric(result.data)


# an algorithm of one's own: the range of each variable per group
@query("registered_algorithm", """
SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1""")
def registered_algorithm(spark, d):
    def spread(task):
        return task.df.groupBy(*task.grouping).agg((F.max(task.target) - F.min(task.target)).alias("spread"))

    register_algorithm("spread", spread)
    source = lambda s: table(s, d, "orders").drop("o_orderdate")
    catalog = Catalog([FeatureTable("orders", source, "o_orderkey")])
    result = run_mining(spark, catalog, MiningQuery(
        variables=("o_totalprice",), grouping=("o_orderpriority",), target_table="orders", algorithm=AlgorithmSpec("spread")))
    return rounded(result.data, 2)


@query("summary_numeric", _numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"))
def summary_numeric(spark, d):
    return _numeric(summary.summary_statistics(
        table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]))


_SPARSE = "(SELECT nullif(l_quantity, 7) AS q, l_linenumber FROM lineitem)"


@query("summary_numeric_nulls", _numeric_sql(_SPARSE, ["q"], "l_linenumber"))
def summary_numeric_nulls(spark, d):
    li = table(spark, d, "lineitem").select(F.nullif("l_quantity", F.lit(7.0)).alias("q"), "l_linenumber")
    return _numeric(summary.summary_statistics(li, ["q"], ["l_linenumber"]))


# the same percentiles by narrowing buckets, the way taken for groups too large for one task
@query("summary_numeric_large_groups", _numeric_sql("orders", ["o_totalprice"], "o_orderpriority"))
def summary_numeric_large_groups(spark, d):
    return _numeric(summary.summary_statistics(
        table(spark, d, "orders"), ["o_totalprice"], ["o_orderpriority"], direct_rows=1000))


@query("summary_nominal", _nominal_sql("lineitem", ["l_returnflag", "l_linestatus"], "l_linenumber"))
def summary_nominal(spark, d):
    return _nominal(summary.summary_statistics(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_linenumber"]))


def _histogram_sql(source: str, v: str, grouping: str | None, bins: int = 20, drop_max: bool = False) -> str:
    groups = [(f"'{grouping}'", f"CAST({grouping} AS VARCHAR)")] if grouping else []
    groups.append(("''", "'all'"))
    lo, hi = f"(SELECT min({v})::DOUBLE FROM {source})", f"(SELECT max({v})::DOUBLE FROM {source})"
    keep = f"WHERE {v} < {hi}" if drop_max else f"WHERE {v} IS NOT NULL"
    parts = [f"""SELECT {name} AS group_variables, g.k AS "group", '{v}' AS variable, CAST(b AS INTEGER) AS bin,
  CAST(CAST({lo} + b * (({hi} - {lo}) / {bins}) AS DECIMAL(18, 2)) AS VARCHAR) || ' - ' ||
  CAST(CAST({lo} + (b + 1) * (({hi} - {lo}) / {bins}) AS DECIMAL(18, 2)) AS VARCHAR) AS category,
  coalesce(c.n, 0) AS "count"
  FROM (SELECT DISTINCT {key} AS k FROM {source}) g CROSS JOIN range({bins}) t(b) LEFT JOIN
  (SELECT {key} AS k, least(floor(({v} - {lo}) / (({hi} - {lo}) / {bins})), {bins - 1}) AS bin, count(*) AS n
   FROM {source} {keep} GROUP BY ALL) c ON c.k = g.k AND c.bin = b""" for name, key in groups]
    return "\nUNION ALL ".join(parts)


def _histogram(df):
    return df.select(joined("group_variables"), joined("group"), "variable", "bin", "category", "count")


@query("histogram_numeric", _histogram_sql("lineitem", "l_extendedprice", "l_returnflag"))
def histogram_numeric(spark, d):
    return _histogram(histogram.histogram(table(spark, d, "lineitem"), "l_extendedprice", covariables=["l_returnflag", "l_tax"]))


@query("histogram_open_last_bin", _histogram_sql("customer", "c_acctbal", None, drop_max=True))
def histogram_open_last_bin(spark, d):
    return _histogram(histogram.histogram(table(spark, d, "customer"), "c_acctbal", drop_max=True))


@query("histogram_nominal", """
SELECT 'l_linestatus' AS group_variables, l_linestatus AS "group", l_returnflag AS category, count(*) AS "count" FROM lineitem GROUP BY ALL
UNION ALL SELECT '', 'all', l_returnflag, count(*) FROM lineitem GROUP BY ALL""")
def histogram_nominal(spark, d):
    out = histogram.histogram(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus"])
    return out.select(joined("group_variables"), joined("group"), "category", "count")


@query("histogram_declared_categories", """
SELECT c.category, count(o_orderstatus) AS "count" FROM (VALUES ('F'), ('O'), ('P'), ('X')) c(category)
LEFT JOIN orders ON o_orderstatus = c.category GROUP BY 1""")
def histogram_declared_categories(spark, d):
    out = histogram.histogram(table(spark, d, "orders"), "o_orderstatus",
                              categories={"o_orderstatus": ["F", "O", "P", "X"]})
    return out.select("category", "count")


_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_summary", _numeric_sql("lineitem", _PROFILE, "l_linestatus") + "")
def profile_summary(spark, d):
    out, _ = profile.profile_table(table(spark, d, "lineitem").select(*_PROFILE, "l_linestatus"), ["l_linestatus"])
    return _numeric(out)


@query("profile_histograms", "\nUNION ALL ".join(_histogram_sql("lineitem", v, "l_linestatus") for v in _PROFILE))
def profile_histograms(spark, d):
    _, out = profile.profile_table(table(spark, d, "lineitem").select(*_PROFILE, "l_linestatus"), ["l_linestatus"])
    return _histogram(out)


_BAND_Z = 1.959963984540054


@query("group_confidence_bands", "\nUNION ALL ".join(f"""
SELECT l_returnflag AS "group", '{v}' AS variable, count(*) AS n, round(avg({v}), 6) AS mean,
  round(stddev_samp({v}), 6) AS std, round(avg({v}) - {_BAND_Z} * stddev_samp({v}) / sqrt(count(*)), 6) AS lower,
  round(avg({v}) + {_BAND_Z} * stddev_samp({v}) / sqrt(count(*)), 6) AS upper FROM lineitem GROUP BY 1"""
    for v in ("l_quantity", "l_tax")))
def group_confidence_bands(spark, d):
    return rounded(bands.group_confidence_bands(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation", "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) + 0.0 AS r FROM lineitem" for a in _CORR for b in _CORR))
def correlation_matrix(spark, d):
    return rounded(correlation.correlation(table(spark, d, "lineitem"), _CORR), 8)


@query("crosstab", """
SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY ALL""")
def crosstab(spark, d):
    return correlation.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def _simple_regression_sql(y: str, x: str, source: str, extra: str = "", group: str = "") -> str:
    """Coefficients, standard errors and t values of y on one x."""
    return f"""
SELECT {extra} 'intercept' AS term, round(a, 6) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS std_err,
  round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) AS t_values FROM (
  SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM (SELECT {extra} regr_intercept({y}, {x}) AS a, regr_slope({y}, {x}) AS b,
   regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, regr_syy({y}, {x}) AS syy, avg({x}) AS mx, count(*) AS n FROM {source} {group}))
UNION ALL
SELECT {extra} '{x}', round(b, 6), round(sqrt(s2 / sxx), 6), round(b / sqrt(s2 / sxx), 4) FROM (
  SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM (SELECT {extra} regr_slope({y}, {x}) AS b,
   regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, regr_syy({y}, {x}) AS syy, count(*) AS n FROM {source} {group}))"""


def _terms(df, *extra):
    return df.select(*extra, "term", F.round("coef", 6).alias("coef"), F.round("std_err", 6).alias("std_err"),
                     F.round("t_values", 4).alias("t_values"))


@query("linear_regression", _simple_regression_sql("l_extendedprice", "l_quantity", "lineitem"))
def linear_regression(spark, d):
    return _terms(regression.linear_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]))


@query("linear_regression_two_covariables", """
WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,
  regr_sxx(l_extendedprice, l_quantity) AS s11, regr_sxx(l_extendedprice, l_discount) AS s22,
  regr_sxy(l_quantity, l_discount) AS s12, regr_sxy(l_extendedprice, l_quantity) AS s1y,
  regr_sxy(l_extendedprice, l_discount) AS s2y FROM lineitem),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 5) AS coef FROM b
UNION ALL SELECT 'l_quantity', round(b1, 5) FROM b UNION ALL SELECT 'l_discount', round(b2, 5) FROM b""")
def linear_regression_two_covariables(spark, d):
    out = regression.linear_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(out.select("term", "coef"), 5)


# with one nominal covariable the coefficients are differences of group means
@query("linear_regression_nominal", """
WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1),
b AS (SELECT m FROM g ORDER BY p LIMIT 1)
SELECT 'intercept' AS term, round(m, 4) AS coef FROM b
UNION ALL SELECT 'o_orderpriority[' || p || ']', round(g.m - b.m, 4) FROM g, b WHERE p <> (SELECT min(p) FROM g)""")
def linear_regression_nominal(spark, d):
    out = regression.linear_regression(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return rounded(out.select("term", "coef"), 4)


@query("logistic_regression")
def logistic_regression(spark, d):
    return rounded(regression.logistic_regression(
        table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_linestatus"]), 5)


# an intercept and one 0/1 input: the logit's coefficients are log odds
@query("logistic_regression_two_classes", """
WITH c AS (SELECT o_orderstatus = 'F' AS f, count(*) FILTER (WHERE high) AS a, count(*) FILTER (WHERE NOT high) AS b
  FROM (SELECT o_orderstatus, o_totalprice >= 250000 AS high FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY 1)
SELECT 'intercept' AS term, round(ln(a / b), 6) AS coef FROM c WHERE f
UNION ALL SELECT 'status[O]', round(ln(o.a / o.b) - ln(f.a / f.b), 6) FROM c o, c f WHERE f.f AND NOT o.f""")
def logistic_regression_two_classes(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") >= 250000, "high").otherwise("a_low").alias("price"))
    return rounded(regression.logistic_regression(o, "price", ["status"]).filter("class = 'high'").select("term", "coef"), 6)


@query("anova_oneway", """
WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY 1),
s AS (SELECT count(*) - 1 AS df1, sum(n) - count(*) AS df2, sum(w) AS ssw,
  sum(n * (m - (SELECT avg(o_totalprice) FROM orders)) ** 2) AS ssb FROM g)
SELECT 'o_orderpriority' AS term, CAST(df1 AS INTEGER) AS df, round(ssb / 1e6, 3) AS sum_sq_millions, round(ssb / df1 / (ssw / df2), 6) AS f_value FROM s
UNION ALL SELECT 'Residual', CAST(df2 AS INTEGER), round(ssw / 1e6, 3), NULL FROM s""")
def anova_oneway(spark, d):
    out = anova_ops.anova(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("term", "df", F.round(F.col("sum_sq") / 1e6, 3).alias("sum_sq_millions"),
                      F.round("F", 6).alias("f_value"))


# sequential sums of squares: the first factor alone, then what the second adds
@query("anova_additive", """
WITH m AS (SELECT count(*) AS n, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS s11,
  regr_sxx(l_extendedprice, l_discount) AS s22, regr_sxy(l_quantity, l_discount) AS s12,
  regr_sxy(l_extendedprice, l_quantity) AS s1y, regr_sxy(l_extendedprice, l_discount) AS s2y FROM lineitem),
s AS (SELECT *, s1y * s1y / s11 AS ss1, (s2y - s12 * s1y / s11) ** 2 / (s22 - s12 * s12 / s11) AS ss2 FROM m)
SELECT 'l_quantity' AS term, 1 AS df, round(ss1 / 1e6, 3) AS sum_sq_millions FROM s
UNION ALL SELECT 'l_discount', 1, round(ss2 / 1e6, 3) FROM s
UNION ALL SELECT 'Residual', CAST(n - 3 AS INTEGER), round((syy - ss1 - ss2) / 1e6, 3) FROM s""")
def anova_additive(spark, d):
    out = anova_ops.anova(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "additive")
    return out.select("term", "df", F.round(F.col("sum_sq") / 1e6, 3).alias("sum_sq_millions"))


# with both factors and their interaction in, the model is the table of cell means
@query("anova_factorial_cells", """
WITH a AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY ALL),
g AS (SELECT avg(l_extendedprice) AS m FROM lineitem)
SELECT 'l_returnflag' AS term, round(sum(a.n * (a.m - g.m) ** 2) / 1e6, 4) AS sum_sq_millions FROM a, g
UNION ALL SELECT 'rest', round((sum(c.n * (c.m - a.m) ** 2)) / 1e6, 4) FROM c JOIN a ON a.l_returnflag = c.l_returnflag
UNION ALL SELECT 'Residual', round(sum(w) / 1e6, 2) FROM c""")
def anova_factorial_cells(spark, d):
    out = anova_ops.anova(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    term = F.when(F.col("term").contains("linestatus"), "rest").otherwise(F.col("term")).alias("term")
    sums = out.groupBy(term).agg((F.sum("sum_sq") / 1e6).alias("s"))
    return sums.select("term", F.when(F.col("term") == "Residual", F.round("s", 2)).otherwise(F.round("s", 4)).alias("sum_sq_millions"))


@query("anova_factorial")
def anova_factorial(spark, d):
    return rounded(anova_ops.anova(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_quantity"]), 4)


# two standardised columns have the eigenvalues 1 + |r| and 1 - |r|
@query("pca_variance", """
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 'PC1' AS component, round(50 * (1 + r), 6) AS explained_variance, round(50 * (1 + r), 6) AS cumulative_explained_variance FROM r
UNION ALL SELECT 'PC2', round(50 * (1 - r), 6), 100.0::DOUBLE FROM r""")
def pca_variance(spark, d):
    return rounded(pca.pca(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).explained(spark))


@query("pca_scores", """
WITH m AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp,
  corr(p_size, p_retailprice) AS r FROM part)
SELECT p_partkey, round(CASE WHEN r >= 0 THEN (z1 + z2) ELSE (z1 - z2) END / sqrt(2), 6) + 0.0 AS first FROM
 (SELECT p_partkey, r, (p_size - ms) / ss AS z1, (p_retailprice - mp) / sp AS z2 FROM part, m)""")
def pca_scores(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = pca.pca(p, ["p_size", "p_retailprice"]).scores(p)
    return rounded(out.select("p_partkey", F.col("PC1").alias("first")))


@query("pca_loadings")
def pca_loadings(spark, d):
    return rounded(pca.pca(table(spark, d, "lineitem"), _CORR).loading_rows(spark))


# ---- results over several datasets --------------------------------------------------------

@query("scatter_gather", """
SELECT l_linestatus AS dataset, 'l_quantity' AS "index", count(*) AS "count", round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1
UNION ALL SELECT l_linestatus, 'l_tax', count(*), round(avg(l_tax), 6) FROM lineitem GROUP BY 1""")
def scatter_gather(spark, d):
    out = federation.scatter_gather(
        lambda df: summary.numeric_summary(df, ["l_quantity", "l_tax"], percentiles=False),
        table(spark, d, "lineitem"), "l_linestatus", ["F", "O"])
    return rounded(out.select("dataset", "index", "count", "mean"))


@query("compound_result", """
SELECT array_to_string(list_sort(list(DISTINCT 'job-' || o_orderpriority)), '+') AS job_id, 'compound' AS type,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS data_provenance,
  array_to_string(list_sort(list(DISTINCT 'status ' || o_orderstatus)), ',') AS feedback FROM orders""")
def compound_result(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.collect_set(F.concat(F.lit("status "), "o_orderstatus")).alias("feedback"))
    out = federation.compound(o.withColumn("job_id", F.concat(F.lit("job-"), "dataset")))
    return out.select("job_id", "type", joined("data_provenance"), joined("feedback"))


@query("map_reduce_summary", "\nUNION ALL ".join(f"""
SELECT '{v}' AS variable, count({v}) AS "count", count(*) - count({v}) AS null_count, round(avg({v}) + {NUDGE}, 6) AS mean,
  round(stddev_samp({v}) + {NUDGE}, 6) AS std, round(sqrt(avg({v} * {v})) + {NUDGE}, 6) AS "root EX^2", min({v}) AS min, max({v}) AS max FROM lineitem"""
    for v in ("l_quantity", "l_extendedprice")))
def map_reduce_summary(spark, d):
    states = federation.partial_state("statisticsSummary", table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    out = federation.merge_state("statisticsSummary", states)
    return _nudged(out, "variable", "count", "null_count", extra=["min", "max"])


@query("map_reduce_value_counts", "SELECT 'o_orderstatus' AS variable, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL")
def map_reduce_value_counts(spark, d):
    states = federation.partial_state("valueCounts", table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")
    return federation.merge_state("valueCounts", states).select("variable", "value", F.col("n").cast("bigint").alias("n"))


@query("map_reduce_histogram", _histogram_sql("orders", "o_totalprice", None))
def map_reduce_histogram(spark, d):
    states, ranges = federation.partial_state("histograms", table(spark, d, "orders"), ["o_totalprice"], "o_orderpriority")
    return _histogram(federation.merge_state("histograms", states, ranges=ranges))


@query("map_reduce_regression", _simple_regression_sql("l_extendedprice", "l_quantity", "lineitem"))
def map_reduce_regression(spark, d):
    states, names = federation.partial_state(
        "linearRegression", table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], "l_returnflag")
    return _terms(federation.merge_state("linearRegression", states, names=names, target="l_extendedprice"))


@query("regression_per_dataset",
       _simple_regression_sql("l_extendedprice", "l_quantity", "lineitem", 'l_returnflag AS "group",', "GROUP BY l_returnflag")
       .replace('SELECT l_returnflag AS "group", \'', 'SELECT "group", \'')
       + "\nUNION ALL " + _simple_regression_sql("l_extendedprice", "l_quantity", "lineitem", "'all' AS \"group\","))
def regression_per_dataset(spark, d):
    return _terms(regression.linear_regression_by(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag"), "group")


@query("map_reduce_pca", """
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 'PC1' AS component, round(50 * (1 + r), 6) AS explained_variance FROM r
UNION ALL SELECT 'PC2', round(50 * (1 - r), 6) FROM r""")
def map_reduce_pca(spark, d):
    states, names = federation.partial_state("pca", table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_linestatus")
    out = federation.merge_state("pca", states, names=names).explained(spark)
    return rounded(out.select("component", "explained_variance"))
