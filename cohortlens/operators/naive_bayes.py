"""Naive Bayes over numeric (Gaussian) and nominal (multinomial) inputs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, nominal_columns, numeric_columns
from cohortlens.operators.moments import moment_columns, moment_states
from cohortlens.operators.summary import value_counts
from cohortlens.session import small_rows

# Fixed value: log-prior of a declared class without rows.
UNSEEN_LOG_PRIOR = -1e10
VAR_SMOOTHING = 1e-9
MAX_STATES = 500_000
LOOKUP_VALUES = 64


@dataclass
class NaiveBayesModel:
    classes: list
    log_prior: dict
    gaussians: dict  # (class, column) -> (mean, variance)
    log_prob: dict  # (class, column, value) -> log probability

    @property
    def nominal(self) -> dict:
        """column -> categories seen in training."""
        out: dict = {}
        for _, column, value in self.log_prob:
            out.setdefault(column, {})[value] = None
        return {c: list(v) for c, v in out.items()}

    @property
    def in_columns(self) -> bool:
        """Whether the categories are few enough to look up inside an expression."""
        return all(len(v) <= LOOKUP_VALUES for v in self.nominal.values())

    def log_density(self, label: str, looked_up: bool = False) -> Column:
        out = F.lit(float(self.log_prior[label]))
        for (c, column), (mean, variance) in self.gaussians.items():
            if c == label:
                gap = F.col(f"`{column}`").cast("double") - F.lit(mean)
                out = out - gap * gap / F.lit(2 * variance) - F.lit(0.5 * math.log(2 * math.pi * variance))
        for column, values in self.nominal.items():
            if looked_up:
                found = F.col(f"_lp_{column}")[self.classes.index(label)]
            else:
                mapping = F.create_map(*[F.lit(x) for v in values for x in (v, self.log_prob[label, column, v])])
                found = F.try_element_at(mapping, F.col(f"`{column}`").cast("string"))
            # a category never seen in training says nothing about the class
            out = out + F.coalesce(found, F.lit(0.0))
        return out

    def column(self, looked_up: bool = False) -> Column:
        """Most likely class; the first of equals."""
        options = [
            F.struct((-self.log_density(c, looked_up)).alias("cost"), F.lit(i).alias("at"), F.lit(c).alias("label"))
            for i, c in enumerate(self.classes) if self.log_prior[c] > UNSEEN_LOG_PRIOR
        ]
        return F.array_min(F.array(*options))["label"]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the class. Many categories are looked up by a join with the model's own table."""
        if self.in_columns:
            return df.withColumn(output, self.column())
        out = df
        for column, values in self.nominal.items():
            table = df.sparkSession.createDataFrame(
                [(v, [self.log_prob.get((c, column, v)) for c in self.classes]) for v in values],
                f"_v_{column} string, _lp_{column} array<double>")
            same = out[column].cast("string") == table[f"_v_{column}"]
            out = out.join(F.broadcast(table), same, "left")  # at most MAX_STATES rows
        return out.withColumn(output, self.column(True)).select(*[F.col(f"`{c}`") for c in df.columns], output)

    def rows(self, spark) -> DataFrame:
        """Class means and variances of the numeric inputs, with the log-prior."""
        rows = [
            (c, float(self.log_prior[c]), column, float(m), float(v))
            for (c, column), (m, v) in sorted(self.gaussians.items())
        ]
        return spark.createDataFrame(
            rows, "class string, log_prior double, variable string, mean double, variance double"
        )


def naive_bayes_states(df: DataFrame, y: str, columns: list, by=()) -> tuple:
    """Driver-side (moment rows, category rows) per class and ``by`` key, each from one scan."""
    by = list(by)
    numeric, nominal = numeric_columns(df, columns), nominal_columns(df, columns)
    rows = complete_rows(df.select(*dict.fromkeys([*by, y, *columns])), [y, *columns])
    rows = rows.withColumn("_class", F.col(f"`{y}`").cast("string"))
    moments, counts = [], []
    if numeric:
        m = moment_columns()
        states = moment_states(rows, numeric, [*by, "_class"]).withColumn("var", m["var_pop"])
        moments = small_rows(states, MAX_STATES, "class moments")
    if nominal:
        counts = small_rows(value_counts(rows, nominal, [*by, "_class"]), MAX_STATES, "class categories")
    return moments, counts


def _merge(parts: list) -> tuple:
    """Pairwise update of (n, mean, population variance)."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, m, v in parts:
        total = n + k
        d = m - mean
        m2 += v * k + d * d * n * k / total
        mean += d * k / total
        n = total
    return n, mean, m2 / n


def naive_bayes_from_states(
    moments: list, counts: list, alpha: float = 1.0, class_prior: dict | None = None,
    classes: list | None = None,
) -> NaiveBayesModel:
    sizes: dict = {}
    parts: dict = {}
    for r in moments:
        parts.setdefault((r["_class"], r["variable"]), []).append((r["n"], r["mean"], r["var"]))
    merged = {k: _merge(v) for k, v in parts.items()}
    for (c, _), (n, _, _) in merged.items():
        sizes[c] = n
    table: dict = {}
    for r in counts:
        at = (r["_class"], r["variable"], r["value"])
        table[at] = table.get(at, 0) + r["n"]
    if not moments:
        first = next(v for _, v, _ in table)
        for (c, v, _), n in table.items():
            if v == first:
                sizes[c] = sizes.get(c, 0) + n
    total = sum(sizes.values())
    if not total:
        raise ValueError("no rows to train on")
    labels = list(classes) if classes else sorted(sizes)
    prior = {
        c: (math.log(class_prior[c]) if class_prior else
            math.log(sizes[c] / total) if sizes.get(c) else UNSEEN_LOG_PRIOR)
        for c in labels
    }
    # a small share of the largest overall variance keeps densities finite
    overall: dict = {}
    for (c, v), state in merged.items():
        overall.setdefault(v, []).append(state)
    floor = VAR_SMOOTHING * max((_merge(s)[2] for s in overall.values()), default=0.0)
    gaussians = {k: (mean, var + floor) for k, (_, mean, var) in merged.items() if var + floor > 0}
    # one multinomial per class over the categories of all nominal inputs together
    values = sorted({(v, x) for _, v, x in table})
    log_prob = {}
    for c in sorted(sizes):
        seen = sum(table.get((c, v, x), 0) for v, x in values)
        for v, x in values:
            n = table.get((c, v, x), 0)
            log_prob[c, v, x] = (
                math.log((n + alpha) / (seen + alpha * len(values))) if n + alpha > 0 else UNSEEN_LOG_PRIOR
            )
    return NaiveBayesModel(labels, prior, gaussians, log_prob)


def naive_bayes_fit(
    df: DataFrame, y: str, columns: list, alpha: float = 1.0, class_prior: dict | None = None,
    classes: list | None = None,
) -> NaiveBayesModel:
    return naive_bayes_from_states(*naive_bayes_states(df, y, columns), alpha, class_prior, classes)


def naive_bayes_folds(df: DataFrame, y: str, columns: list, split: str, alpha: float = 1.0,
                      class_prior: dict | None = None, classes: list | None = None) -> dict:
    """fold -> model trained on the other folds, from one scan of per-fold states."""
    moments, counts = naive_bayes_states(df, y, columns, [split])
    folds = sorted({r[split] for r in [*moments, *counts]})
    return {
        f: naive_bayes_from_states([r for r in moments if r[split] != f], [r for r in counts if r[split] != f],
                                   alpha, class_prior, classes)
        for f in folds
    }


def predict_by_fold(df: DataFrame, models: dict, split: str, output: str = "prediction") -> DataFrame:
    """Held-out predictions of every fold in one pass: each row uses its own fold's model."""
    if not all(getattr(m, "in_columns", True) for m in models.values()):
        parts = [m.predict(df.filter(F.col(split) == f), output) for f, m in sorted(models.items())]
        return reduce(lambda a, b: a.unionByName(b), parts)
    out = None
    for fold, model in sorted(models.items()):
        hit, value = F.col(split) == fold, model.column()
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return df.withColumn(output, out)
