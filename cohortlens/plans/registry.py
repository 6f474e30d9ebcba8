"""The algorithms a query can name, and how to add one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cohortlens.functions.names import is_nominal, nominal_columns, numeric_columns
from cohortlens.operators.anova import anova
from cohortlens.operators.bands import group_confidence_bands
from cohortlens.operators.correlation import correlation, crosstabs
from cohortlens.operators.gram import nominal_levels
from cohortlens.operators.hist_boosting import histogram_boosting
from cohortlens.operators.histogram import histogram
from cohortlens.operators.kmeans import kmeans
from cohortlens.operators.knn import knn_fit
from cohortlens.operators.linear import linear_model
from cohortlens.operators.naive_bayes import naive_bayes_fit, naive_bayes_folds
from cohortlens.operators.network import network_features
from cohortlens.operators.neural import neural_network
from cohortlens.operators.pca import pca
from cohortlens.operators.regression import linear_regression, logistic_regression
from cohortlens.operators.subgroups import subgroups
from cohortlens.operators.summary import summary_statistics
from cohortlens.model import AlgorithmDef


@dataclass
class Task:
    """What an algorithm gets: the filtered rows, the query's roles, and the table's key."""

    df: DataFrame
    variables: list
    covariables: list = field(default_factory=list)
    grouping: list = field(default_factory=list)
    key: str | None = None
    parameters: dict = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.variables[0]

    @property
    def inputs(self) -> list:
        return [*self.covariables, *self.grouping]


ALGORITHMS: dict[str, AlgorithmDef] = {}
FITTERS: dict[str, Callable] = {}
FOLD_FITTERS: dict[str, Callable] = {}


def register_algorithm(
    code: str, run: Callable | None = None, fit: Callable | None = None, predictive: bool = False,
    variables_can_be_null: bool = False, covariables_can_be_null: bool = False, mergeable: bool = False,
    defaults: dict | None = None, fit_folds: Callable | None = None, all_variables: bool = False,
) -> AlgorithmDef:
    """Add an algorithm.

    ``run(task) -> DataFrame`` gives a result table. A predictive algorithm gives
    ``fit(df, target, inputs, key, **parameters)``, which returns a model with
    ``predict(df, output)``; ``fit_folds(df, target, inputs, split, **parameters)``
    may return all fold models from one scan. ``all_variables`` says that it uses
    every variable of a query and not only the first.
    """
    if predictive and fit is None:
        raise ValueError(f"predictive algorithm {code} needs fit")
    if run is None and fit is None:
        raise ValueError(f"algorithm {code} needs run or fit")
    if run is None:
        def run(task):
            model = fit(task.df, task.target, task.inputs, task.key, **task.parameters)
            return describe_model(model, task.df)
    definition = AlgorithmDef(
        code, run, predictive, variables_can_be_null, covariables_can_be_null, mergeable, defaults or {}, all_variables
    )
    ALGORITHMS[code] = definition
    if fit is not None:
        FITTERS[code] = fit
    if fit_folds is not None:
        FOLD_FITTERS[code] = fit_folds
    return definition


def algorithm(code: str) -> AlgorithmDef:
    if code not in ALGORITHMS:
        raise KeyError(f"no algorithm is registered as {code}")
    return ALGORITHMS[code]


def parameters_of(code: str, given: dict) -> dict:
    """Defaults overlaid with the given values, each read as its default's type."""
    out = dict(algorithm(code).defaults)
    for name, value in given.items():
        if name not in out:
            raise ValueError(f"{code} has no parameter {name}")
        kind = type(out[name])
        if kind is bool:
            value = str(value).lower() == "true"
        elif kind in (int, float, str) and not isinstance(value, dict):
            value = kind(value)
        out[name] = value
    return out


def describe_model(model, df: DataFrame) -> DataFrame:
    """A model's numbers as a table; models without any give their kind."""
    if hasattr(model, "rows"):
        return model.rows(df.sparkSession)
    return df.sparkSession.createDataFrame([(type(model).__name__,)], "model string")


def _regression(task: Task) -> DataFrame:
    fit = logistic_regression if is_nominal(task.df, task.target) else linear_regression
    return fit(task.df, task.target, task.inputs)


def _correlation(task: Task) -> DataFrame:
    columns = [*task.variables, *task.covariables]
    nominal = nominal_columns(task.df, columns)
    if nominal and len(nominal) < len(columns):
        raise ValueError(f"numeric and nominal variables do not correlate; leave out {', '.join(nominal)} or the others")
    if nominal and len(columns) < 2:
        raise ValueError("a cross-tab needs two nominal variables")
    return crosstabs(task.df, columns) if nominal else correlation(task.df, columns)


def _prior(text: str, df: DataFrame, y: str) -> dict | None:
    """Comma-separated priors in the order of the sorted classes; empty means from the data."""
    if not text:
        return None
    labels = nominal_levels(df, [y])[y]
    values = [float(v) for v in text.split(",")]
    if len(values) != len(labels) or abs(sum(values) - 1.0) > 1e-6:
        raise ValueError("class_prior needs one value per class, adding up to 1")
    return dict(zip(labels, values))


def _nb(df, y, xs, key, alpha=1.0, class_prior=""):
    return naive_bayes_fit(df, y, xs, alpha, _prior(class_prior, df, y))


def _nb_folds(df, y, xs, split, alpha=1.0, class_prior=""):
    return naive_bayes_folds(df, y, xs, split, alpha, _prior(class_prior, df, y))


register_algorithm(
    "histograms", lambda t: histogram(t.df, t.target, t.grouping, covariables=t.covariables, **t.parameters),
    variables_can_be_null=True, covariables_can_be_null=True, mergeable=True, defaults={"bins": 20},
)
register_algorithm(
    "statisticsSummary",
    lambda t: summary_statistics(t.df, [*t.variables, *t.covariables], t.grouping),
    variables_can_be_null=True, covariables_can_be_null=True, mergeable=True, all_variables=True,
)
register_algorithm("linearRegression", _regression, mergeable=True)
register_algorithm(
    "anova", lambda t: anova(t.df, t.target, t.inputs, **t.parameters), defaults={"design": "factorial"}
)
register_algorithm("correlationHeatmap", _correlation, all_variables=True)


def _pca(task: Task) -> DataFrame:
    """Components with their loadings, or the rows' scores."""
    result = _choice(task, "result", ("components", "scores"))
    model = pca(task.df, [*task.variables, *task.covariables], int(task.parameters["k"]))
    if result == "scores":
        scored = model.scores(task.df)
        return scored.select(*([task.key] if task.key else []), *scored.columns[len(task.df.columns):])
    return model.components(task.df.sparkSession)


def _kmeans(task: Task) -> DataFrame:
    columns = [*task.variables, *task.covariables]
    return kmeans_result(kmeans(task.df, columns, int(task.parameters["n_clusters"])), task)


def kmeans_result(model, task: Task) -> DataFrame:
    """The centres, or the cluster of each row."""
    result, columns = _choice(task, "result", ("centres", "assignments")), model.columns
    if result == "assignments":
        return model.predict(task.df).select(*([task.key] if task.key else columns), "cluster")
    return model.centre_rows(task.df.sparkSession)


def _choice(task: Task, name: str, allowed: tuple) -> str:
    if task.parameters[name] not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}")
    return task.parameters[name]


register_algorithm("pca", _pca, mergeable=True, defaults={"k": 5, "result": "components"}, all_variables=True)
register_algorithm("kmeans", _kmeans, mergeable=True, defaults={"n_clusters": 3, "result": "centres"}, all_variables=True)
register_algorithm(
    "subgroupDiscovery", lambda t: subgroups(t.df, t.target, t.inputs, **t.parameters),
    defaults={"beam": 10, "support": 0.1, "depth": 2},
)
register_algorithm(
    "networkFeatures",
    lambda t: network_features(t.df, t.key, t.target, t.inputs, **t.parameters),
    defaults={"damping": 0.85, "normalize": True},
)
register_algorithm(
    "groupConfidenceBands",
    lambda t: group_confidence_bands(t.df, numeric_columns(t.df, [*t.variables, *t.covariables]), t.grouping),
    all_variables=True,
)
register_algorithm(
    "knn", fit=lambda df, y, xs, key, k=5: knn_fit(df, key, y, xs, k), predictive=True,
    defaults={"k": 5},
)
register_algorithm(
    "naiveBayes", fit=_nb, fit_folds=_nb_folds, predictive=True, defaults={"alpha": 1.0, "class_prior": ""},
)
register_algorithm(
    "sgdLinearModel", fit=lambda df, y, xs, key, **p: linear_model(df, y, xs, **p), predictive=True,
    defaults={"alpha": 1e-4, "penalty": "l2", "l1_ratio": 0.15},
)
register_algorithm(
    "sgdNeuralNetwork", fit=lambda df, y, xs, key, **p: neural_network(df, y, xs, **p), predictive=True,
    defaults={"hidden_layer_sizes": "100", "activation": "relu", "alpha": 1e-4, "learning_rate_init": 1e-3,
              "rounds": 10},
)
register_algorithm(
    "gradientBoosting", fit=lambda df, y, xs, key, **p: histogram_boosting(df, y, xs, **p), predictive=True,
    defaults={"learning_rate": 0.1, "n_estimators": 100, "max_depth": 3, "min_samples_split": 2,
              "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0, "min_impurity_decrease": 0.0},
)
