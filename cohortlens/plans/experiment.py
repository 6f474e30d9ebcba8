"""Experiments: several algorithms over one common set of rows."""

from __future__ import annotations

from functools import partial, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import ExperimentQuery
from cohortlens.operators.counts import require_rows
from cohortlens.operators.filters import experiment_null_policy
from cohortlens.operators.folds import kfold_split, split_column, validate_folds
from cohortlens.plans.mining import select_rows
from cohortlens.plans.parallel import side_by_side
from cohortlens.plans.registry import Task, algorithm, describe_model, parameters_of
from cohortlens.plans.validation import check_folds, cross_validate, fit, validate_on_datasets
from cohortlens.session import checkpoint
from cohortlens.sources.results import inject_cell
from cohortlens.sources.tables import Catalog

RESULT_SCHEMA = "position int, algorithm string, result string, data string, error string"


def _long(df: DataFrame, position: int, code: str, result: str) -> DataFrame:
    """A result table in long form: one JSON document per row."""
    return df.select(
        F.lit(position).alias("position"), F.lit(code).alias("algorithm"), F.lit(result).alias("result"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("data"),
        F.lit(None).cast("string").alias("error"),
    )


def model_document(model_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """One JSON document: the model's numbers and, in its ``validations`` cell, its scores."""
    def tagged(df, cell):
        return df.select(F.lit(cell).alias("cell"),
                         F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))

    def as_array(cell):  # a few rows per class or fold
        rows = F.array_sort(F.collect_list(F.when(F.col("cell") == cell, F.col("row"))))
        return F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias(cell)

    both = tagged(model_rows, "model").unionByName(tagged(scores, "scores")).agg(as_array("model"), as_array("scores"))
    document = F.concat(F.lit('{"cells":{"model":'), "model", F.lit("}}"))
    return both.select(inject_cell(document, "validations", F.col("scores")).alias("document"))


def fit_and_validate(
    code: str, df: DataFrame, target: str, inputs: list, key: str, k: int, seed: float = 0.67,
    parameters: dict | None = None, split_df: DataFrame | None = None,
) -> tuple:
    """(model trained on all rows, scores per fold and pooled)."""
    model = fit(code, df, target, inputs, key, parameters)
    return model, cross_validate(code, df, target, inputs, key, k, seed, parameters, split_df=split_df)


def run_experiment(
    spark: SparkSession, catalog: Catalog, query: ExperimentQuery, strict_nulls: bool = False
) -> DataFrame:
    """Rows (position, algorithm, result, data, error).

    All algorithms see the same rows. Predictive ones are also cross-validated
    when the query asks for it. They run side by side over the persisted rows; one that fails leaves an
    error row and the others go on; an empty list, an unknown algorithm or a bad k fail at once.
    """
    if not query.algorithms:
        raise ValueError("an experiment needs at least one algorithm")
    definitions = [algorithm(a.code) for a in query.algorithms]
    folds = []
    for v in query.validations:
        if v.code != "kfold":
            raise ValueError(f"unknown validation {v.code}")
        folds.append(check_folds(v.parameters.get("k", 5)))
    rows = select_rows(spark, catalog, query, query.training_datasets,
                       *experiment_null_policy(definitions, strict_nulls))
    key, seed = rows.table.primary_key, rows.table.seed
    predictive = any(d.predictive for d in definitions)
    if predictive and folds and not key:
        raise ValueError(f"table {rows.table.name} has no single-column key to cross-validate on")
    df = require_rows(rows.df, rows.table.name).persist(StorageLevel.MEMORY_AND_DISK)
    splits = {}
    out = spark.createDataFrame([], RESULT_SCHEMA)
    try:
        if predictive:
            for k in folds:
                splits[k] = kfold_split(df, key, k, seed)
                validate_folds(splits[k], split_column(k), k)

        def results(position, spec, definition) -> DataFrame:
            """All result rows of one algorithm."""
            parts = []
            task = Task(df, rows.variables, rows.covariables, rows.grouping, key, parameters_of(spec.code, spec.parameters))
            if definition.predictive:
                model = fit(spec.code, df, task.target, task.inputs, key, spec.parameters)
                described = describe_model(model, df)
                parts.append(_long(described, position, spec.code, "model"))
                for k in folds:
                    scores = cross_validate(spec.code, df, task.target, task.inputs, key, k, seed,
                                            spec.parameters, split_df=splits[k])
                    scores = checkpoint(scores)  # k + 1 rows, used twice
                    parts.append(_long(scores, position, spec.code, "kfold"))
                    parts.append(_long(model_document(described, scores), position, spec.code, "document"))
                if query.validation_datasets and rows.table.dataset_column:
                    parts.append(_long(
                        _other_datasets(spark, catalog, query, model, task, rows), position, spec.code, "datasets"))
            else:
                parts.append(_long(definition.run(task), position, spec.code, "result"))
            return checkpoint(reduce(DataFrame.unionByName, parts))  # result-sized; failures show up here

        chosen = list(enumerate(zip(query.algorithms, definitions)))
        outcomes = side_by_side(spark, [partial(results, i, spec, definition) for i, (spec, definition) in chosen], name="algorithm")
        for (position, (spec, _)), (done, error) in zip(chosen, outcomes):
            if error is not None:  # an algorithm's failure is part of the experiment's result
                message = str(error).strip().split("\n")[0] or type(error).__name__
                done = spark.createDataFrame([(position, spec.code, "error", None, message)], RESULT_SCHEMA)
            out = out.unionByName(done)
        return out
    finally:
        df.unpersist()


def _other_datasets(spark, catalog, query, model, task, rows) -> DataFrame:
    column = rows.table.dataset_column
    others = select_rows(spark, catalog, query, query.validation_datasets).df
    return validate_on_datasets(model, others, task.target, task.inputs, column,
                                list(query.validation_datasets), query.training_datasets)
