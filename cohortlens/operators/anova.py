"""Sequential (Type I) analysis of variance from one cross-product state."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product as cartesian

from pyspark.sql import DataFrame

from cohortlens.functions.dist import f_sf
from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G
from cohortlens.operators.absorb import absorbed_fit
from cohortlens.operators.regression import least_squares

ANOVA_SCHEMA = "term string, df int, sum_sq double, mean_sq double, F double, `PR(>F)` double"


def anova(df: DataFrame, y: str, factors: list, design: str = "factorial") -> DataFrame:
    """Each term's sum of squares is what it adds to the terms before it.

    Terms enter in request order; ``factorial`` adds the interactions after
    them, ``additive`` does not.
    """
    if design not in ("factorial", "additive"):
        raise ValueError("design is factorial or additive")
    if is_nominal(df, y):
        raise ValueError(f"{y} is nominal: the analysis of variance needs a numeric target")
    if wide := [f for f in factors if f in G.wide_factors(df, factors)]:
        if len(wide) > 1 or (design == "factorial" and len(factors) > 1):
            raise ValueError(f"{', '.join(wide)}: of factors with so many categories an additive design takes one")
        return _with_wide_factor(df, y, factors, wide[0])
    columns = G.design(df, [y, *factors])
    effects = [(f, columns[f]) for f in factors]
    if design == "factorial":
        for size in range(2, len(factors) + 1):
            for chosen in combinations(factors, size):
                terms = [reduce(G.product, ts) for ts in cartesian(*[columns[f] for f in chosen])]
                effects.append((":".join(chosen), terms))
    target = columns[y][0]
    every = [t for _, terms in effects for t in terms]
    state = G.gram(df, [target, *every])
    full = least_squares(state, y, [t.name for t in every])
    fits, used = [("", 0, least_squares(state, y, []).rss)], []
    for name, terms in effects:
        used += [t.name for t in terms]
        after = least_squares(state, y, used)
        fits.append((name, after.rank, after.rss))
    return df.sparkSession.createDataFrame(_table(fits, state.n - full.rank - 1), ANOVA_SCHEMA)


def _table(fits: list, residual_df: int) -> list:
    """Rows of the result from (term, rank, residual sum) of the growing models, the empty one first."""
    rss = fits[-1][2]
    residual_ms = rss / residual_df if residual_df > 0 else None
    rows = []
    for (_, rank, more), (name, next_rank, less) in zip(fits, fits[1:]):
        df_term = next_rank - rank
        ss = max(more - less, 0.0)
        ms = ss / df_term if df_term else None
        f = ms / residual_ms if ms is not None and residual_ms else None
        p = f_sf(f, df_term, residual_df) if f is not None else None
        rows.append((name, df_term, ss, ms, f, p))
    rows.append(("Residual", residual_df, rss, residual_ms, None, None))
    return rows


def _with_wide_factor(df: DataFrame, y: str, factors: list, wide: str) -> DataFrame:
    """Additive design with one factor of very many categories: terms before it from the plain cross products, it
    and the terms behind it from those within its categories."""
    written = [f for f in factors if f != wide]
    df = complete_rows(df.select(y, *factors))
    columns = G.design(df, [y, *written])
    every = [t for f in written for t in columns[f]]
    state = G.gram(df, [columns[y][0], *every])
    fits, used, inside = [("", 0, least_squares(state, y, []).rss)], [], False
    for f in factors:
        inside |= f == wide
        used += [] if f == wide else columns[f]
        if inside:
            fit = absorbed_fit(df, columns[y][0], used, [wide])
            fits.append((f, fit.levels - 1 + fit.rank, fit.rss))
        else:
            fit = least_squares(state, y, [t.name for t in used])
            fits.append((f, fit.rank, fit.rss))
    return df.sparkSession.createDataFrame(_table(fits, state.n - fits[-1][1] - 1), ANOVA_SCHEMA)
