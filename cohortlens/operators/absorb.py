"""Least squares with factors of any number of categories.

A factor with many categories is not written as 0/1 terms but absorbed: what is left of target and inputs
after taking off each category's mean gives the same coefficients. For one factor that is exact with one
aggregate per category. Several such factors overlap; their common effects come from conjugate
gradients on the sparse normal equations, whose matrix is only ever applied, by joins and sums over the
distinct combinations of categories.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dist import t_two_sided
from cohortlens.functions.names import complete_rows
from cohortlens.operators import gram as G
from cohortlens.session import checkpoint

TERM_SCHEMA = "term string, coef double, std_err double, t_values double, p_values double"
BUILTIN_TERMS = 12
MAX_STEPS = 300
TOLERANCE = 1e-11


@dataclass
class AbsorbedFit:
    """Coefficients of the written-out terms, and the effect of each category of the absorbed factors."""

    names: list
    coef: np.ndarray
    inverse: np.ndarray  # of the terms' cross products within categories
    rss: float
    rank: int
    n: int
    levels: int  # independent category effects, the intercept among them
    groups: dict  # factor -> DataFrame (level, n, mean) or, of several factors, (level, effect)
    steps: int = 0  # of the conjugate gradients; none for one factor

    @property
    def residual_df(self) -> int:
        return self.n - self.levels - self.rank

    @property
    def s2(self) -> float:
        return self.rss / self.residual_df if self.residual_df > 0 else math.nan


def _rows(df: DataFrame, terms: list, factors: list) -> DataFrame:
    """Complete rows: ``_f0..`` the factors as text, ``_t0..`` the terms less their anchors."""
    cells = [F.col(f"`{f}`").cast("string").alias(f"_f{i}") for i, f in enumerate(factors)]
    return complete_rows(df.select(*cells, *[(t.column - F.lit(float(t.anchor))).alias(f"_t{i}") for i, t in enumerate(terms)]))


def _sums(rows: DataFrame, by: list, p: int) -> DataFrame:
    """Per combination of categories: n, the means ``_m``, and ``_c`` cross products around them (few terms only)."""
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.avg(f"_t{i}").alias(f"_m{i}") for i in range(p)]]
    if p <= BUILTIN_TERMS:
        aggs += [F.covar_pop(f"_t{i}", f"_t{j}").alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy(*by).agg(*aggs)


def _within(rows: DataFrame, cells: DataFrame, by: list, p: int) -> np.ndarray:
    """p x p cross products of the rows around the means of their cells."""
    if p <= BUILTIN_TERMS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        found = cells.agg(*[F.sum(F.col(f"_c{i}_{j}") * F.col("_n")) for i, j in pairs]).first()
        out = np.zeros((p, p))
        for (i, j), v in zip(pairs, found):
            out[i, j] = out[j, i] = v or 0.0
        return out
    centred = rows.join(cells, by).select(*[(F.col(f"_t{i}") - F.col(f"_m{i}")).alias(f"d{i}") for i in range(p)])
    state = G.gram(centred, [G.Term(f"d{i}", F.col(f"d{i}")) for i in range(p)])
    return state.cross + state.n * np.outer(state.mean, state.mean)


def _solve(cross: np.ndarray) -> tuple:
    """(coefficients, inverse, residual sum, rank) of the first term on the others from their cross products.

    A term that categories explain but for rounding counts as explained.
    """
    sxx, sxy = cross[1:, 1:], cross[1:, 0]
    if not len(sxx):
        return np.zeros(0), sxx, float(cross[0, 0]), 0
    scale = np.sqrt(np.maximum(np.diag(sxx), 0.0))
    scale[scale == 0] = 1.0
    scaled = sxx / np.outer(scale, scale)
    inverse = np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(scaled, tol=1e-9, hermitian=True))
    coef = inverse @ sxy
    return coef, inverse, max(float(cross[0, 0] - coef @ sxy), 0.0), rank


def absorbed_fit(df: DataFrame, target: G.Term, terms: list, factors: list) -> AbsorbedFit:
    """Least squares of the target on the terms and all categories of the factors.

    Rows with a null in any of them are left out. No number of categories reaches the driver: of a factor it
    sees the count, of the terms p x p sums.
    """
    every = [target, *terms]
    p, by = len(every), [f"_f{i}" for i in range(len(factors))]
    if not 0 < p <= G.MAX_TERMS:
        raise ValueError(f"{p} terms; between 1 and {G.MAX_TERMS} are supported")
    rows = _rows(df, every, factors)
    cells = checkpoint(_sums(rows, by, p))
    n, number = cells.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no complete rows")
    cross = _within(rows, cells, by, p)
    low = np.array([float(t.anchor) for t in every])
    if len(factors) == 1:
        mean = F.array(*[F.col(f"_m{i}") + F.lit(float(low[i])) for i in range(p)])
        groups = {factors[0]: cells.select(F.col("_f0").alias("level"), F.col("_n").alias("n"), mean.alias("mean"))}
        return AbsorbedFit([t.name for t in terms], *_solve(cross), n, number, groups)
    left, effects, steps = _project(cells, by, p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for (i, j), v in zip(pairs, left.agg(*[F.sum(F.col("_n") * F.col(f"_m{i}") * F.col(f"_m{j}")) for i, j in pairs]).first()):
        cross[i, j] += v
        if i != j:
            cross[j, i] += v
    coef, inverse, rss, rank = _solve(cross)
    weights = [1.0, *[-float(b) for b in coef]]
    shift = float(low @ np.array(weights))  # of the anchors; the first factor carries it
    groups, levels = {}, 0
    for k, (f, e) in enumerate(zip(factors, effects)):
        value = sum((F.col(f"_a{i}") * F.lit(w) for i, w in enumerate(weights)), F.lit(shift if k == 0 else 0.0))
        groups[f] = e.select(F.col("_l").alias("level"), value.alias("effect"))
        levels += e.count()
    levels -= _parts(cells, by) if len(factors) == 2 else len(factors) - 1
    return AbsorbedFit([t.name for t in terms], coef, inverse, rss, rank, n, levels, groups, steps)


def _project(cells: DataFrame, by: list, p: int) -> tuple:
    """(cells with what the factors leave of the means, level effects per factor, steps taken).

    Preconditioned conjugate gradients for all p columns side by side, each with its own step lengths. The
    driver sees p numbers a step.
    """
    names = [f"_m{i}" for i in range(p)]
    left = cells.select(*by, "_n", *names)
    sizes = [checkpoint(left.groupBy(F.col(f).alias("_l")).agg(F.sum("_n").alias("_w"))) for f in by]
    effects = [s.select("_l", "_w", *[F.lit(0.0).alias(f"_a{i}") for i in range(p)], *[F.lit(0.0).alias(f"_d{i}") for i in range(p)])
               for s in sizes]
    gamma = start = None
    for step in range(MAX_STEPS):
        slopes = [left.groupBy(F.col(f).alias("_l")).agg(*[F.sum(F.col("_n") * F.col(m)).alias(f"_s{i}") for i, m in enumerate(names)])
                  for f in by]
        joined = [checkpoint(e.join(s, "_l")) for e, s in zip(effects, slopes)]
        new = np.zeros(p)
        for j in joined:
            new += np.array(j.agg(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{i}") / F.col("_w")) for i in range(p)]).first(), float)
        start = new if start is None else start
        if (new <= TOLERANCE**2 * start).all() or (gamma is not None and (new <= 1e-300).all()):
            return left, effects, step
        turn = np.zeros(p) if gamma is None else np.divide(new, gamma, out=np.zeros(p), where=gamma > 0)
        gamma = new
        moved = [j.select("_l", "_w", *[f"_a{i}" for i in range(p)], *[
            (F.col(f"_s{i}") / F.col("_w") + F.lit(float(turn[i])) * F.col(f"_d{i}")).alias(f"_d{i}") for i in range(p)]) for j in joined]
        ahead = left
        for k, (f, m) in enumerate(zip(by, moved)):
            ahead = ahead.join(m.select(F.col("_l").alias(f), *[F.col(f"_d{i}").alias(f"_q{k}_{i}") for i in range(p)]), f)
        ahead = checkpoint(ahead.select(*by, "_n", *names, *[
            sum((F.col(f"_q{k}_{i}") for k in range(1, len(by))), F.col(f"_q0_{i}")).alias(f"_q{i}") for i in range(p)]))
        curve = np.array(ahead.agg(*[F.sum(F.col("_n") * F.col(f"_q{i}") * F.col(f"_q{i}")) for i in range(p)]).first(), float)
        size = np.divide(gamma, curve, out=np.zeros(p), where=curve > 0)
        left = ahead.select(*by, "_n", *[(F.col(m) - F.lit(float(size[i])) * F.col(f"_q{i}")).alias(m) for i, m in enumerate(names)])
        effects = [m.select("_l", "_w", *[(F.col(f"_a{i}") + F.lit(float(size[i])) * F.col(f"_d{i}")).alias(f"_a{i}") for i in range(p)],
                            *[f"_d{i}" for i in range(p)]) for m in moved]
    raise ValueError(f"the factors' common effects did not settle in {MAX_STEPS} steps")


def _parts(cells: DataFrame, by: list) -> int:
    """Number of sets of categories that no row connects; each takes one effect that the others cannot tell."""
    cells = checkpoint(cells.select(*by))
    label = cells.groupBy(by[1]).agg(F.min(by[0]).alias("_p"))
    while True:
        near = cells.join(label, by[1]).groupBy(by[0]).agg(F.min("_p").alias("_p"))
        # the name of a part may itself have a smaller one
        near = near.join(near.select(F.col(by[0]).alias("_p"), F.col("_p").alias("_q")), "_p", "left").select(
            by[0], F.least(F.col("_p"), F.coalesce("_q", F.col("_p"))).alias("_p"))
        next_ = checkpoint(cells.join(near, by[0]).groupBy(by[1]).agg(F.min("_p").alias("_p")))
        changed = next_.join(label.select(by[1], F.col("_p").alias("_before")), by[1]).filter(F.col("_p") != F.col("_before"))
        if changed.isEmpty():
            return next_.select("_p").distinct().count()
        label = next_


def _tested(coef, se, df: int) -> tuple:
    """Coefficient, standard error, t and p, null where undefined."""
    t = coef / se if se and not math.isnan(se) else math.nan
    return tuple(None if x is None or math.isnan(x) else float(x) for x in (coef, se, t, t_two_sided(t, df) if not math.isnan(t) else math.nan))


def term_table(fit: AbsorbedFit, spark) -> DataFrame:
    """All terms in the layout of a linear regression.

    With one factor: the intercept is the effect of its smallest category, and every other category has a row
    of its own, as if written as 0/1 terms. With several: the written-out terms with their tests, then the
    category effects, each factor's less that of its smallest category; their errors are not
    computed, and the intercept belongs to the smallest categories together.
    """
    s2, df = fit.s2, fit.residual_df
    rows = []
    for i, name in enumerate(fit.names):
        rows.append((name, *_tested(float(fit.coef[i]), math.sqrt(max(s2 * fit.inverse[i, i], 0.0)) if s2 == s2 else math.nan, df)))
    if len(fit.groups) > 1:
        out, intercept = [], 0.0
        for factor, effects in fit.groups.items():
            first = effects.orderBy("level").first()
            intercept += first["effect"]
            nothing = [F.lit(None).cast("double").alias(c) for c in ("std_err", "t_values", "p_values")]
            out.append(effects.filter(F.col("level") != first["level"]).select(
                F.concat(F.lit(f"{factor}["), "level", F.lit("]")).alias("term"), (F.col("effect") - first["effect"]).alias("coef"), *nothing))
        found = spark.createDataFrame([("intercept", intercept, None, None, None), *rows], TERM_SCHEMA)
        for o in out:
            found = found.unionByName(o)
        return found
    (factor, groups), = fit.groups.items()
    first = groups.orderBy("level").first()
    n0, mean0 = first["n"], np.array(first["mean"], float)
    coef, inverse = fit.coef, fit.inverse
    base = float(mean0[0] - mean0[1:] @ coef)
    error = math.sqrt(s2 * (1.0 / n0 + mean0[1:] @ inverse @ mean0[1:])) if s2 == s2 else math.nan

    def category_rows(batches):
        for pdf in batches:
            mean = np.array(pdf["mean"].tolist(), float).reshape(len(pdf), -1)
            away = mean - mean0
            b = away[:, 0] - away[:, 1:] @ coef
            se = np.sqrt(s2 * (1.0 / pdf["n"].to_numpy() + 1.0 / n0 + np.einsum("ij,jk,ik->i", away[:, 1:], inverse, away[:, 1:])))
            tested = [_tested(x, e, df) for x, e in zip(b.tolist(), se.tolist())]
            yield pd.DataFrame([(f"{factor}[{v}]", *t) for v, t in zip(pdf["level"], tested)],
                               columns=["term", "coef", "std_err", "t_values", "p_values"])

    head = spark.createDataFrame([("intercept", *_tested(base, error, df)), *rows], TERM_SCHEMA)
    others = groups.filter(F.col("level") != first["level"])
    return head.unionByName(others.mapInPandas(category_rows, TERM_SCHEMA))


class AbsorbedModel:
    """A fitted regression whose category effects are looked up by a join; an unseen category has no prediction."""

    def __init__(self, fit: AbsorbedFit, terms: list):
        self.fit, self.terms = fit, terms

    def effects(self, factor: str) -> DataFrame:
        """(level, effect); of one factor an effect is the category's mean less what the terms explain."""
        groups = self.fit.groups[factor]
        if "effect" in groups.columns:
            return groups
        value = F.col("mean")[0]
        for i, b in enumerate(self.fit.coef):
            value = value - F.col("mean")[i + 1] * F.lit(float(b))
        return groups.select("level", value.alias("effect"))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        total, joined = F.lit(0.0), df
        for t, b in zip(self.terms, self.fit.coef):
            total = total + t.column * F.lit(float(b))
        joined = joined.withColumn("_explained", total)
        for i, factor in enumerate(self.fit.groups):
            e = self.effects(factor).select(F.col("level").alias(f"_l{i}"), F.col("effect").alias(f"_e{i}"))
            joined = joined.join(e, F.col(f"`{factor}`").cast("string") == F.col(f"_l{i}"), "left")
        whole = sum((F.col(f"_e{i}") for i in range(len(self.fit.groups))), F.col("_explained"))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], whole.alias(output))

    def rows(self, spark) -> DataFrame:
        return term_table(self.fit, spark)


def absorbed_regression(df: DataFrame, y: str, xs: list, factors: list) -> AbsorbedModel:
    """Regression of y on the inputs ``xs`` (numeric, or nominal with few categories) and the absorbed factors."""
    written = [x for x in xs if x not in factors]
    d = G.design(df, [y, *written])
    terms = [t for x in written for t in d[x]]
    return AbsorbedModel(absorbed_fit(df, d[y][0], terms, factors), terms)
