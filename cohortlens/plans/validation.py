"""Validation of predictive algorithms: held-out folds, other datasets, streams."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import is_nominal
from cohortlens.operators.filters import filter_nulls
from cohortlens.operators.folds import kfold_split, split_column, train_test, validate_folds
from cohortlens.operators.naive_bayes import predict_by_fold
from cohortlens.operators.scoring import score_multiclass, score_regression
from cohortlens.plans.parallel import all_of, side_by_side
from cohortlens.plans.registry import FITTERS, FOLD_FITTERS, algorithm, parameters_of

MIN_FOLDS, MAX_FOLDS, DEFAULT_FOLDS = 2, 20, 5
FOLDS_AT_ONCE = 5


def check_folds(k) -> int:
    k = int(k)
    if not MIN_FOLDS <= k <= MAX_FOLDS:
        raise ValueError(f"k must lie between {MIN_FOLDS} and {MAX_FOLDS}, got {k}")
    return k


def fit(code: str, df: DataFrame, target: str, inputs: list, key: str | None, parameters: dict | None = None):
    if not algorithm(code).predictive:
        raise ValueError(f"{code} is not predictive")
    return FITTERS[code](df, target, inputs, key, **parameters_of(code, parameters or {}))


def held_out_predictions(
    code: str, split_df: DataFrame, target: str, inputs: list, key: str, split: str, k: int,
    parameters: dict | None = None,
) -> DataFrame:
    """(key, fold, actual, prediction): every row predicted by the model that has not seen it."""
    rows = split_df.select(*dict.fromkeys([key, target, *inputs, split]))
    if code in FOLD_FITTERS:
        models = FOLD_FITTERS[code](rows, target, inputs, split, **parameters_of(code, parameters or {}))
        out = predict_by_fold(rows, models, split)
    else:
        def held_out(fold):
            train, test = train_test(rows, split, fold)
            return fit(code, train, target, inputs, key, parameters).predict(test)

        spark = rows.sparkSession
        parts = side_by_side(spark, [partial(held_out, fold) for fold in range(1, k + 1)], FOLDS_AT_ONCE, "fold")
        out = reduce(DataFrame.unionByName, all_of(parts))
    return out.select(key, F.col(split).alias("fold"), F.col(target).alias("actual"), "prediction")


def score(
    predictions: DataFrame, nominal: bool, by: str | None = None, labels: list | None = None, pool: bool = True
) -> DataFrame:
    if nominal:
        return score_multiclass(predictions, "actual", "prediction", labels, by, pool)
    return score_regression(predictions, "actual", "prediction", by, pool)


def cross_validate(
    code: str, df: DataFrame, target: str, inputs: list, key: str, k: int = DEFAULT_FOLDS, seed: float = 0.67,
    parameters: dict | None = None, labels: list | None = None, split_df: DataFrame | None = None,
) -> DataFrame:
    """Scores per fold and the pooled row ``all``, which is one score over all held-out predictions."""
    k, split = check_folds(k), split_column(int(k))
    if split_df is None:
        rows = filter_nulls(df.select(*dict.fromkeys([key, target, *inputs])), [target], inputs)
        split_df = kfold_split(rows, key, k, seed)
        validate_folds(split_df, split, k)
    predictions = held_out_predictions(code, split_df, target, inputs, key, split, k, parameters)
    return score(predictions, is_nominal(df, target), "fold", labels)


def validate_model(model, df: DataFrame, target: str, inputs: list, labels: list | None = None) -> DataFrame:
    """Score a fitted model on a table; an empty table is an error."""
    rows = filter_nulls(df, [target], inputs)
    if rows.isEmpty():
        raise ValueError("no rows to validate on")
    scored = model.predict(rows.withColumn("actual", F.col(target)))
    return score(scored, is_nominal(df, target), None, labels)


def validate_on_datasets(
    model, df: DataFrame, target: str, inputs: list, dataset_column: str, datasets: list,
    training_datasets=(), labels: list | None = None,
) -> DataFrame:
    """One score row per validation dataset that was not trained on; missing ones carry an error."""
    wanted = [d for d in datasets if d not in set(training_datasets)]
    if not wanted:
        raise ValueError("no validation dataset outside the training datasets")
    rows = filter_nulls(df.filter(F.col(dataset_column).isin(*wanted)), [target], inputs)
    predicted = model.predict(rows).select(
        F.col(dataset_column).alias("dataset"), F.col(target).alias("actual"), "prediction"
    )
    scores = score(predicted, is_nominal(df, target), "dataset", labels, pool=False)
    asked = df.sparkSession.createDataFrame([(d,) for d in wanted], "dataset string")
    return asked.join(scores, "dataset", "left").withColumn(
        "error", F.when(F.col("n").isNull(), F.lit("no rows to validate on"))
    )
