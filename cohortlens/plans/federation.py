"""Results over several datasets: kept apart, or merged from partial states."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, is_nominal, nominal_columns, numeric_columns
from cohortlens.operators import gram as G
from cohortlens.operators.gram import nominal_levels
from cohortlens.operators.histogram import BINS, bin_counts, finish_bins, finish_categories, numeric_ranges
from cohortlens.operators.kmeans import KMeansModel, kmeans_states, kmeans_step, lloyd, seed_centres
from cohortlens.operators.knn import knn_fit, merge_near, vote
from cohortlens.operators.knn_pivots import pivot_neighbours
from cohortlens.operators.moments import merge_moments, moment_columns, moment_states
from cohortlens.operators.pca import PCAModel, pca_from_state
from cohortlens.operators.regression import TERM_SCHEMA, least_squares, term_rows
from cohortlens.operators.sketches import sketch_quantiles
from cohortlens.operators.summary import PROBS, described, summary_of_counts, summary_of_states, value_counts
from cohortlens.plans.parallel import all_of, side_by_side
from cohortlens.session import checkpoint


def scatter_gather(run: Callable, df: DataFrame, dataset_column: str, datasets: list) -> DataFrame:
    """The same operator on each dataset, side by side, results kept apart under ``dataset``.

    For operators that only take a table. Those with a grouping do better with
    the dataset as one more grouping column, which is one job.
    """
    if not datasets:
        raise ValueError("No results")

    def one(d):
        return run(df.filter(F.col(dataset_column) == d)).withColumn("dataset", F.lit(d))

    parts = all_of(side_by_side(df.sparkSession, [partial(one, d) for d in datasets], name="dataset"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compound(results: DataFrame) -> DataFrame:
    """One row over several results (job_id, dataset, feedback): ids joined, sets united."""
    gathered = results.withColumn("note", F.explode_outer("feedback")).agg(
        F.array_sort(F.collect_set("job_id")).alias("ids"),
        F.array_sort(F.collect_set("dataset")).alias("data_provenance"),
        F.array_sort(F.collect_set("note")).alias("feedback"),
    )
    return gathered.select(
        F.array_join("ids", "+").alias("job_id"),
        F.when(F.size("ids") > 1, F.lit("compound")).otherwise(F.lit("single")).alias("type"),
        "data_provenance", "feedback",
    )


def partial_summary(df: DataFrame, variables: list, by: str) -> DataFrame:
    """Moment states per dataset, each with a rank sketch for the quartiles."""
    return moment_states(df, variables, [by], sketches=True)


def merge_summary(states: DataFrame, by=()) -> DataFrame:
    """Summary from the states of any number of datasets or batches.

    Quartiles come from the merged sketches, within ``sketches.rank_error``; states without sketches give none.
    """
    m, merged = moment_columns(), merge_moments(states, by)
    q = sketch_quantiles(PROBS) if "sketch" in merged.columns else F.lit(None).cast("array<double>")
    found = merged.select(
        *by, "variable", F.col("n").alias("count"), F.col("nulls").alias("null_count"),
        m["mean"].alias("mean"), m["std"].alias("std"), m["EX^2"].alias("EX^2"), "min", "max", q.alias("_q"),
    )
    return found.select(
        "*", *[F.get("_q", F.lit(i)).alias(f"{100 * p:.0f}%") for i, p in enumerate(PROBS)]).drop("_q")


def partial_statistics(df: DataFrame, variables: list, by: str, grouping=(), sketches: bool = True) -> tuple:
    """(moment states, value counts) per dataset and group, for numeric and nominal variables; None without such."""
    keys = list(dict.fromkeys([by, *grouping]))
    numeric, nominal = numeric_columns(df, variables), nominal_columns(df, variables)
    return (moment_states(df, numeric, keys, sketches) if numeric else None,
            value_counts(df, nominal, keys) if nominal else None)


def merge_statistics(states: tuple, df: DataFrame, variables: list, grouping=(), rows: bool = True) -> DataFrame:
    """Summary statistics in the layout of ``summary_statistics`` from the partial states.

    With ``rows`` the percentiles are exact, by a second pass over ``df``; else only its schema is read, and
    they come from the sketches.
    """
    moments, counts = states
    parts = []
    if moments is not None:
        numeric = numeric_columns(df, variables)
        kept = df.select(*dict.fromkeys([*grouping, *numeric])) if rows else None
        parts.append(summary_of_states(moments, grouping, kept, numeric))
    if counts is not None:
        parts.append(summary_of_counts(counts, grouping))
    return described(parts, df, variables)


def merge_value_counts(states: DataFrame, by=()) -> DataFrame:
    return states.groupBy(*by, "variable", "value").agg(F.sum("n").alias("n"))


def partial_histogram(
    df: DataFrame, variables: list, by: str, ranges: dict | None = None, bins: int = BINS, grouping=(),
) -> tuple:
    """(bin counts per dataset and group, the common bin ranges)."""
    ranges = ranges or numeric_ranges(df, variables)
    if not ranges:
        raise ValueError(f"no values in {', '.join(variables)}")
    return bin_counts(df, ranges, list(dict.fromkeys([by, *grouping])), bins), ranges


def merge_histogram(states: DataFrame, ranges: dict, bins: int = BINS, grouping=()) -> DataFrame:
    merged = states.groupBy(*grouping, "variable", "bin").agg(F.sum("n").alias("n"))
    return finish_bins(merged, ranges, grouping, bins)


def partial_categories(df: DataFrame, variables: list, by: str, grouping=()) -> DataFrame:
    """Category counts per dataset and group."""
    return value_counts(df, variables, list(dict.fromkeys([by, *grouping]))).filter(F.col("value").isNotNull())


def merge_categories(states: DataFrame, grouping=()) -> DataFrame:
    return finish_categories(states, grouping)


def merged_kmeans(df: DataFrame, columns: list, by: str, n_clusters: int = 3, steps: int = 20) -> KMeansModel:
    """Clusters over all datasets: seeding and every Lloyd step add up one state per dataset and cluster.

    Only centres travel to the datasets, and counts and sums back.
    """
    rows = checkpoint(df.select(by, *columns).dropna(subset=columns))
    return lloyd(rows, columns, seed_centres(rows, columns, n_clusters, by=[by]), steps, [by])


def partial_gram(df: DataFrame, columns: list, by: str) -> tuple:
    """(cross-product states per dataset, the terms in order)."""
    d = G.design(df, columns)
    terms = [t for c in columns for t in d[c]]
    return G.gram_states(df, terms, [by]), [t.name for t in terms]


def merge_regression(states: DataFrame, names: list, target: str) -> DataFrame:
    """Regression of ``target`` on the other terms over all datasets."""
    state = G.collect_gram(G.merge_gram(states, len(names)), names)[()]
    fit = least_squares(state, target, [n for n in names if n != target])
    return states.sparkSession.createDataFrame(term_rows(fit), TERM_SCHEMA)


def merge_pca(states: DataFrame, names: list, k: int = 5) -> PCAModel:
    return pca_from_state(G.collect_gram(G.merge_gram(states, len(names)), names)[()], names, k)


def partial_neighbours(
    train: DataFrame, queries: DataFrame, key: str, query_key: str, target: str, columns: list, by: str,
    datasets: list, k: int = 5,
) -> DataFrame:
    """(query_key, d2, neighbour, y): the k nearest rows of each dataset, all datasets in one run."""
    levels = nominal_levels(queries, [c for c in columns if is_nominal(queries, c)])
    model = knn_fit(train, key, target, columns, k, levels)
    y = F.col(f"`{target}`").cast("string" if model.classification else "double")
    rows = complete_rows(train.select(F.col(key).alias("_key"), y.alias("_y"), *model.features(train), F.col(by).alias("_by")))
    asked = queries.select(F.col(query_key).alias("_q"), *model.features(queries))
    found = pivot_neighbours(rows, asked, model.dims, k, datasets)
    return found.select(F.col("_q").alias(query_key), F.inline("near"))


def merge_neighbours(states: DataFrame, query_key: str, k: int, classification: bool) -> DataFrame:
    """Prediction from the nearest of all datasets' neighbours."""
    near = merge_near(states, k, query_key)
    return near.select(query_key, vote(F.col("near"), classification).alias("prediction"))


def partial_state(op: str, df: DataFrame, columns: list, by: str, **options):
    """Intermediate state of a mergeable algorithm, one set of rows per dataset."""
    return {
        "statisticsSummary": lambda: partial_summary(df, columns, by, **options),
        "valueCounts": lambda: value_counts(df, columns, [by]),
        "histograms": lambda: partial_histogram(df, columns, by, **options),
        "linearRegression": lambda: partial_gram(df, columns, by),
        "pca": lambda: partial_gram(df, columns, by),
        "kmeans": lambda: kmeans_states(df, columns, by=[by], **options),
    }[op]()


def merge_state(op: str, states, **options):
    """Final result from the states of any number of datasets."""
    return {
        "statisticsSummary": merge_summary, "valueCounts": merge_value_counts, "histograms": merge_histogram,
        "linearRegression": merge_regression, "pca": merge_pca, "kmeans": kmeans_step,
    }[op](states, **options)


def write_states(states: DataFrame, path: str, op: str, job_id: str) -> None:
    """Append partial states; a job's own folder is replaced, so a rerun does not count twice."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/op={op}/job_id={job_id}")


def read_states(spark, path: str, op: str, job_ids: list) -> DataFrame:
    """States of one algorithm, picked by job id; only those folders are read."""
    base = f"{path.rstrip('/')}/op={op}"
    if not job_ids:
        raise ValueError("no job ids to merge")
    return spark.read.option("basePath", base).parquet(*[f"{base}/job_id={j}" for j in job_ids])
