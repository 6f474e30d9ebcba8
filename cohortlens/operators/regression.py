"""Ordinary least squares from cross-product states, and logistic regression."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dist import normal_two_sided, t_two_sided
from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G
from cohortlens.operators.absorb import AbsorbedModel, absorbed_regression

TERM_SCHEMA = "term string, coef double, std_err double, t_values double, p_values double"


@dataclass
class Fit:
    """Least-squares fit of y on some terms, with an intercept."""

    names: list
    intercept: float
    coef: np.ndarray
    cov: np.ndarray  # of (intercept, coefficients)
    rss: float
    rank: int
    n: int


def least_squares(state: G.Gram, y: str, names: list) -> Fit:
    at, (iy,) = state.index(names), state.index([y])
    sxx, sxy, syy = state.cross[np.ix_(at, at)], state.cross[at, iy], state.cross[iy, iy]
    if not names:
        s2 = syy / (state.n - 1) if state.n > 1 else math.nan
        return Fit([], state.mean[iy], np.zeros(0), np.array([[s2 / state.n]]), float(syy), 0, state.n)
    scale = np.sqrt(np.diag(sxx))
    scale[scale == 0] = 1.0
    scaled = sxx / np.outer(scale, scale)
    inverse = np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(scaled, tol=1e-9, hermitian=True))
    coef = inverse @ sxy
    rss = max(float(syy - coef @ sxy), 0.0)
    mean = state.mean[at]
    df = state.n - rank - 1
    s2 = rss / df if df > 0 else math.nan
    top = 1.0 / state.n + mean @ inverse @ mean
    side = -inverse @ mean
    cov = s2 * np.block([[np.array([[top]]), side[None, :]], [side[:, None], inverse]])
    return Fit(list(names), float(state.mean[iy] - coef @ mean), coef, cov, rss, rank, state.n)


def term_rows(fit: Fit) -> list:
    df = fit.n - fit.rank - 1
    rows = []
    for i, (name, b) in enumerate(zip(["intercept", *fit.names], [fit.intercept, *fit.coef])):
        se = math.sqrt(fit.cov[i, i]) if fit.cov[i, i] >= 0 else math.nan
        t = float(b) / se if se else math.nan
        p = t_two_sided(t, df)
        rows.append((name, *[None if math.isnan(x) else float(x) for x in (b, se, t, p)]))
    return rows


class LinearModel:
    """A fitted linear predictor; ``predict`` adds one Column expression."""

    def __init__(self, fit: Fit, terms: list):
        self.fit, self.terms = fit, terms

    def column(self):
        out = F.lit(float(self.fit.intercept))
        for t, b in zip(self.terms, self.fit.coef):
            out = out + t.column * F.lit(float(b))
        return out

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column())


def _terms(df: DataFrame, y: str, xs: list) -> tuple:
    if is_nominal(df, y):
        raise ValueError(f"{y} is nominal: a linear regression needs a numeric target")
    d = G.design(df, [y, *xs])
    return d[y][0], [t for x in xs for t in d[x]]


def fit_linear(df: DataFrame, y: str, xs: list) -> LinearModel | AbsorbedModel:
    """Inputs of too many categories to write out are absorbed."""
    if not is_nominal(df, y) and (wide := G.wide_factors(df, xs)):
        return absorbed_regression(df, y, xs, [x for x in xs if x in wide])
    target, terms = _terms(df, y, xs)
    state = G.gram(df, [target, *terms])
    return LinearModel(least_squares(state, y, [t.name for t in terms]), terms)


def linear_regression(df: DataFrame, y: str, xs: list) -> DataFrame:
    """Per term: coefficient, standard error, t and p values (Student t, n - p df)."""
    model = fit_linear(df, y, xs)
    if isinstance(model, AbsorbedModel):
        return model.rows(df.sparkSession)
    return df.sparkSession.createDataFrame(term_rows(model.fit), TERM_SCHEMA)


def linear_regression_by(df: DataFrame, y: str, xs: list, by: str) -> DataFrame:
    """One regression per group of ``by`` plus the merged one (group ``all``), in one scan."""
    target, terms = _terms(df, y, xs)
    names = [target.name, *[t.name for t in terms]]
    states = G.collect_gram(G.gram_states(df, [target, *terms], [by]), names, [by])
    rows = []
    for (group,), state in sorted(states.items(), key=lambda kv: str(kv[0])):
        rows += [(str(group), *r) for r in term_rows(least_squares(state, y, names[1:]))]
    merged = merge_driver(list(states.values()))
    rows += [("all", *r) for r in term_rows(least_squares(merged, y, names[1:]))]
    return df.sparkSession.createDataFrame(rows, "group string, " + TERM_SCHEMA)


def merge_driver(states: list) -> G.Gram:
    """Merge p x p states by the pairwise update of means and cross products."""
    total = (0, None, None)
    for s in states:
        total = G.add(total, (s.n, s.mean, s.cross))
    return G.Gram(states[0].names, *total)


def fold_models(df: DataFrame, y: str, xs: list, split: str) -> dict:
    """fold -> model trained on the other folds. One scan: state(all) - state(fold)."""
    target, terms = _terms(df, y, xs)
    names = [target.name, *[t.name for t in terms]]
    states = G.collect_gram(G.gram_states(df, [target, *terms], [split]), names, [split])
    total = merge_driver(list(states.values()))
    return {
        fold: LinearModel(least_squares(G.subtract(total, s), y, names[1:]), terms)
        for (fold,), s in states.items()
    }


LOGISTIC_ITERATIONS = 50


def _newton_sums(table: DataFrame, beta: np.ndarray) -> tuple:
    """(log likelihood, gradient, information matrix) of a multinomial logit at ``beta``.

    Each task multiplies its Arrow batches; rows of the matrix are then added up
    by position, so only (classes x terms)^2 numbers reach the driver.
    """
    others, width = beta.shape
    size = others * width

    def partial(batches):
        ll, g, h = 0.0, np.zeros((others, width)), np.zeros((others, width, others, width))
        for pdf in batches:
            y = pdf["_y"].to_numpy(int)
            z = np.column_stack([np.ones(len(pdf)), pdf.drop(columns="_y").to_numpy(float)])
            eta = np.column_stack([np.zeros(len(pdf)), z @ beta.T])
            eta -= eta.max(axis=1, keepdims=True)  # keeps the exponentials finite
            p = np.exp(eta)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            ll += float((eta[np.arange(len(y)), y] - np.log(total[:, 0])).sum())
            for k in range(others):
                g[k] += ((y == k + 1) - p[:, k + 1]) @ z
                for m in range(k, others):
                    w = p[:, k + 1] * ((k == m) - p[:, m + 1])
                    h[k, :, m, :] += (z * w[:, None]).T @ z
        for k in range(others):
            for m in range(k):
                h[k, :, m, :] = h[m, :, k, :].T
        yield pd.DataFrame({"i": np.arange(size), "ll": ll, "g": g.ravel(), "h": list(h.reshape(size, size))})

    rows = table.mapInPandas(partial, "i int, ll double, g double, h array<double>").groupBy("i").agg(
        F.sum("ll").alias("ll"), F.sum("g").alias("g"),
        *[F.sum(F.get("h", F.lit(j))).alias(f"h{j}") for j in range(size)],
    ).collect()  # one row per parameter
    rows.sort(key=lambda r: r["i"])
    return (rows[0]["ll"], np.array([r["g"] for r in rows]),
            np.array([[r[f"h{j}"] for j in range(size)] for r in rows]))


def logistic_regression(df: DataFrame, y: str, xs: list, tolerance: float = 1e-10) -> DataFrame:
    """Multinomial logit by maximum likelihood; the first class is the baseline.

    Newton steps on standardised terms, one pass over the data each. If they run out before the likelihood
    settles, as where inputs separate the classes, a warning says so; mining results carry it as feedback.
    """
    levels = G.nominal_levels(df, [y])[y]
    if len(levels) < 2:
        raise ValueError(f"{y} has fewer than two classes")
    d = G.design(df, xs)
    terms = [t for x in xs for t in d[x]]
    p, others = len(terms), levels[1:]
    if (p + 1) * len(others) > G.MAX_TERMS:
        raise ValueError(f"{(p + 1) * len(others)} parameters; at most {G.MAX_TERMS} are supported")
    label = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(f"`{y}`").cast("string")) - 1
    raw = complete_rows(df.filter(F.col(f"`{y}`").isNotNull()).select(
        label.cast("int").alias("_y"), *[t.column.alias(f"_t{i}") for i, t in enumerate(terms)]))
    moments = raw.agg(*[f(f"_t{i}").alias(f"{tag}{i}") for i in range(p)
                        for f, tag in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    mean = np.array([moments[f"m{i}"] for i in range(p)])
    sd = np.array([moments[f"s{i}"] or 1.0 for i in range(p)])
    table = raw.select("_y", *[
        ((F.col(f"_t{i}") - F.lit(float(mean[i]))) / F.lit(float(sd[i]))).alias(f"_z{i}") for i in range(p)])
    beta, previous, inverse = np.zeros((len(others), p + 1)), -math.inf, None
    table = table.persist(StorageLevel.MEMORY_AND_DISK)  # the steps read the narrow rows, not the source
    try:
        for _ in range(LOGISTIC_ITERATIONS):
            ll, g, h = _newton_sums(table, beta)
            inverse = np.linalg.pinv(h, hermitian=True)
            if abs(ll - previous) <= tolerance * (abs(ll) + 1e-12):
                break
            previous, beta = ll, beta + (inverse @ g).reshape(beta.shape)
        else:
            warnings.warn(f"the logit of {y} did not settle in {LOGISTIC_ITERATIONS} steps; its coefficients are those of the last one")
    finally:
        table.unpersist()
    # back to the original scale: coefficient / sd, intercept - sum(coefficient * mean / sd)
    back = np.zeros((p + 1, p + 1))
    back[0, 0] = 1.0
    for i in range(p):
        back[0, i + 1], back[i + 1, i + 1] = -mean[i] / sd[i], 1.0 / sd[i]
    rows = []
    for k, level in enumerate(others):
        block = slice(k * (p + 1), (k + 1) * (p + 1))
        coef, cov = back @ beta[k], back @ inverse[block, block] @ back.T
        for i, name in enumerate(["intercept", *[t.name for t in terms]]):
            se = math.sqrt(max(cov[i, i], 0.0))
            stat = float(coef[i]) / se if se else None
            rows.append((level, name, float(coef[i]), se, stat,
                         normal_two_sided(stat) if stat is not None else None))
    return df.sparkSession.createDataFrame(rows, "class string, " + TERM_SCHEMA)
