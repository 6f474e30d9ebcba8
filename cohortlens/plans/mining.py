"""From a mining query to the rows and the result of one algorithm."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.names import is_nominal, resolve
from cohortlens.model import FeatureTable, FilterRule, MiningQuery
from cohortlens.operators.counts import datasets_used, require_rows
from cohortlens.operators.filters import apply_filters, filter_datasets, filter_nulls, select_features
from cohortlens.operators.histogram import series_columns
from cohortlens.plans.federation import (
    merge_categories, merge_state, merge_statistics, merged_kmeans, partial_categories, partial_state, partial_statistics,
)
from cohortlens.plans.registry import Task, algorithm, kmeans_result, parameters_of
from cohortlens.session import small_rows
from cohortlens.sources.tables import Catalog, open_table

MAX_DATASETS = 10_000
PACKAGE = str(Path(__file__).resolve().parent.parent)


@dataclass
class Rows:
    """The rows a query selects, with what was found on the way."""

    df: DataFrame
    table: FeatureTable
    variables: list
    covariables: list
    grouping: list
    feedback: list = field(default_factory=list)

    def provenance(self) -> DataFrame:
        column = self.table.dataset_column
        return datasets_used(self.df, self.table.name, column if column in self.df.columns else None)


def check_columns(columns: list, query) -> tuple:
    """Resolve the query's columns: unknown targets fail, unknown covariables are dropped with a note."""
    feedback, variables, covariables, grouping = [], [], [], []
    for names, out, optional in (
        (query.variables, variables, False),
        (query.covariables, covariables, not query.covariables_must_exist),
        (query.grouping, grouping, not query.covariables_must_exist),
    ):
        for name in names:
            try:
                out.append(resolve(columns, name))
            except ValueError:
                if not optional:
                    raise
                feedback.append(f"Covariable {name} does not exist and was ignored")
    if not variables:
        raise ValueError("a query needs at least one variable")
    return variables, covariables, grouping, feedback


def select_rows(
    spark: SparkSession, catalog: Catalog, query, datasets=(), variables_can_be_null: bool = False,
    covariables_can_be_null: bool = False,
) -> Rows:
    """Table scan, dataset filter, null filter, the user's filter last, then the projection."""
    table = catalog.describe(query.target_table)
    names = open_table(spark, table).columns
    variables, covariables, grouping, feedback = check_columns(names, query)
    used = [*variables, *covariables, *grouping, *_fields(query.filters, names)]
    used += [c for c in (table.primary_key, table.dataset_column) if c]
    df = catalog.frame(spark, table.name, columns=list(dict.fromkeys(used)))
    df = filter_datasets(df, table.dataset_column, datasets)
    df = filter_nulls(df, variables, covariables, grouping, variables_can_be_null, covariables_can_be_null)
    df = apply_filters(df, query.filters)
    extra = [c for c in (table.primary_key, table.dataset_column) if c]
    return Rows(select_features(df, variables, covariables, grouping, extra), table,
                variables, covariables, grouping, feedback)


def _fields(rule: FilterRule | None, columns: list) -> list:
    if rule is None:
        return []
    if hasattr(rule, "rules"):
        return [f for r in rule.rules for f in _fields(r, columns)]
    return [resolve(columns, rule.field)]


def features(spark: SparkSession, catalog: Catalog, query: MiningQuery) -> DataFrame:
    """The raw rows of a query: its columns, nulls kept."""
    rows = select_rows(spark, catalog, query, query.datasets, True, True)
    return select_features(rows.df, rows.variables, rows.covariables, rows.grouping)


@dataclass
class MiningResult:
    data: DataFrame
    provenance: DataFrame
    feedback: list
    merged: bool = False  # from one partial state per dataset


def run_mining(spark: SparkSession, catalog: Catalog, query: MiningQuery) -> MiningResult:
    if query.algorithm is None:
        raise ValueError("the query names no algorithm")
    code = query.algorithm.code
    if code == "data":
        rows = select_rows(spark, catalog, query, query.datasets, True, True)
        return MiningResult(features(spark, catalog, query), rows.provenance(), rows.feedback)
    definition = algorithm(code)
    rows = select_rows(spark, catalog, query, query.datasets,
                       definition.variables_can_be_null, definition.covariables_can_be_null)
    require_rows(rows.df, rows.table.name)
    task = Task(rows.df, rows.variables, rows.covariables, rows.grouping, rows.table.primary_key,
                parameters_of(code, query.algorithm.parameters))
    if len(rows.variables) > 1 and not definition.all_variables:
        rows.feedback.append(f"{code} takes one variable: {', '.join(rows.variables[1:])} had no part in it")
    data = None
    if definition.mergeable and len(query.datasets) > 1 and rows.table.dataset_column:
        data = merged_plan(code, task, rows.table.dataset_column)
    merged = data is not None
    if not merged:
        with warnings.catch_warnings(record=True) as noted:
            warnings.simplefilter("always", UserWarning)
            data = definition.run(task)
        rows.feedback.extend(str(w.message) for w in noted if w.category is UserWarning and w.filename.startswith(PACKAGE))
    return MiningResult(data, rows.provenance(), rows.feedback, merged)


def merged_plan(code: str, task: Task, by: str) -> DataFrame | None:
    """The result by way of one state per dataset, for algorithms whose states hold all of it; else None."""
    columns = [*task.variables, *task.covariables]
    if code == "statisticsSummary":
        states = partial_statistics(task.df, columns, by, task.grouping, sketches=False)  # the rows are here: exact percentiles
        return merge_statistics(states, task.df, columns, task.grouping)
    if code == "linearRegression" and not is_nominal(task.df, task.target):
        states, names = partial_state(code, task.df, [task.target, *task.inputs], by)
        return merge_state(code, states, names=names, target=task.target)
    if code == "histograms":
        grouping = series_columns(task.df, task.grouping, task.covariables)
        if is_nominal(task.df, task.target):
            return merge_categories(partial_categories(task.df, [task.target], by, grouping), grouping)
        states, ranges = partial_state(code, task.df, [task.target], by, bins=task.parameters["bins"], grouping=grouping)
        return merge_state(code, states, ranges=ranges, bins=task.parameters["bins"], grouping=grouping)
    if code == "pca" and task.parameters["result"] == "components":
        states, names = partial_state(code, task.df, columns, by)
        return merge_state(code, states, names=names, k=int(task.parameters["k"])).components(task.df.sparkSession)
    if code == "kmeans":
        model = merged_kmeans(task.df, columns, by, int(task.parameters["n_clusters"]))
        return kmeans_result(model, task)
    return None


def with_provenance(result: MiningResult) -> DataFrame:
    """Result rows with the datasets they come from and the feedback as columns."""
    used = [r["dataset"] for r in small_rows(result.provenance, MAX_DATASETS, "datasets")]
    return result.data.select(
        "*", F.array(*[F.lit(d) for d in sorted(used)]).cast("array<string>").alias("data_provenance"),
        F.array(*[F.lit(m) for m in result.feedback]).cast("array<string>").alias("feedback"),
    )
