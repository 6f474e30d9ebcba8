"""Additive cross-product states: the input of regression, ANOVA, correlation and PCA.

A state is one row: n, the means of the terms and the p x p centred cross
products, each group centred on its own means. States with the same terms merge
by the pairwise update, in two levels, on the executors. Only the merged
p x p numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators.moments import anchors
from cohortlens.session import BROADCAST_ROWS, small_rows

MAX_TERMS = 2000
BUILTIN_TERMS = 8
MERGE_SALTS = 32
MAX_LEVELS = 1000
MAX_NUMBERS = 100_000_000  # of all states that one collect hands to the driver


@dataclass(frozen=True)
class Term:
    """One numeric column of a design matrix."""

    name: str
    column: Column
    anchor: float = 0.0  # taken off before sums


@dataclass
class Gram:
    """Merged state on the driver: n, means and centred cross products."""

    names: list
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def index(self, names: list) -> list:
        at = {name: i for i, name in enumerate(self.names)}
        return [at[n] for n in names]


def nominal_levels(df: DataFrame, columns: list) -> dict:
    """Distinct values of the nominal columns, sorted; one job for all of them."""
    if not columns:
        return {}
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns
    ]))
    found = df.select(pairs).filter(F.col("v").isNotNull()).distinct()
    rows = small_rows(found, MAX_LEVELS * len(columns), f"categories of {', '.join(columns)}")
    levels: dict = {c: [] for c in columns}
    for r in rows:
        levels[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in levels.items()}


def wide_factors(df: DataFrame, columns: list) -> list:
    """Nominal columns of too many categories to write out as 0/1 terms; they are told apart only when there are any."""
    nominal = [c for c in columns if is_nominal(df, c)]
    if not nominal:
        return []
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in nominal
    ]))
    found = df.select(pairs).filter(F.col("v").isNotNull()).distinct()
    if found.limit(MAX_LEVELS + 1).count() <= MAX_LEVELS:
        return []
    return [r["c"] for r in found.groupBy("c").count().filter(F.col("count") > MAX_LEVELS).collect()]


def design(df: DataFrame, columns: list, levels: dict | None = None) -> dict:
    """column -> its terms: itself when numeric, one 0/1 term per category but the first when nominal."""
    nominal = [c for c in columns if is_nominal(df, c)]
    levels = levels or nominal_levels(df, nominal)
    numeric = [c for c in columns if c not in nominal]
    low, out = anchors(df, numeric) if numeric else {}, {}
    for c in columns:
        if c in nominal:
            out[c] = [
                Term(f"{c}[{v}]", (F.col(f"`{c}`").cast("string") == F.lit(v)).cast("double"))
                for v in levels[c][1:]
            ]
        else:
            out[c] = [Term(c, F.col(f"`{c}`").cast("double"), low[c])]
    return out


def product(a: Term, b: Term) -> Term:
    return Term(f"{a.name}:{b.name}", a.column * b.column)


def add(a: tuple, b: tuple) -> tuple:
    """Pairwise update of (n, means, centred cross products)."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _state_schema(df: DataFrame, by: list) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    return T.StructType([df.schema[c] for c in by] + [
        T.StructField("n", T.LongType()), T.StructField("mean", numbers), T.StructField("cross", numbers)])


def merge_gram(states: DataFrame, terms: int, by=()) -> DataFrame:
    """Add up states with the same terms; ``by`` keeps some keys apart.

    Partial states of one key meet in salted groups first, so that no task gets
    the p x p numbers of all tasks at once.
    """
    by, schema = list(by), _state_schema(states, list(by))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = (0, None, None)
        for n, mean, cross in zip(pdf["n"], pdf["mean"], pdf["cross"]):
            total = add(total, (n, np.asarray(mean, float), np.asarray(cross, float).reshape(terms, terms)))
        out = pdf[by].iloc[[0]].copy()
        out["n"], out["mean"], out["cross"] = total[0], [total[1]], [total[2].ravel()]
        return out

    salt = (F.spark_partition_id() % MERGE_SALTS).alias("_salt")
    some = states.select(*by, "n", "mean", "cross").groupBy(*by, salt).applyInPandas(merge, schema)
    return some.groupBy(*by, F.lit(0).alias("_one")).applyInPandas(merge, schema)


def gram_states(df: DataFrame, terms: list, by=()) -> DataFrame:
    """(by..., n, mean, cross) in one scan; rows with a null term are left out."""
    by, p = list(by), len(terms)
    if not 0 < p <= MAX_TERMS:
        raise ValueError(f"{p} terms; between 1 and {MAX_TERMS} are supported")
    low = [float(t.anchor) for t in terms]
    rows = df.select(*by, *[(t.column - F.lit(a)).alias(f"_t{i}") for i, (t, a) in enumerate(zip(terms, low))])
    rows = complete_rows(rows, [f"_t{i}" for i in range(p)])
    if p <= BUILTIN_TERMS:
        aggs = [F.count(F.lit(1)).alias("_n"), *[F.avg(f"_t{i}").alias(f"_m{i}") for i in range(p)]]
        aggs += [
            F.covar_pop(f"_t{i}", f"_t{j}").alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)
        ]
        wide = rows.groupBy(*by).agg(*aggs).filter("_n > 0")
        return wide.select(
            *by, F.col("_n").alias("n"), F.array(*[F.col(f"_m{i}") + F.lit(a) for i, a in enumerate(low)]).alias("mean"),
            F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") * F.col("_n") for i in range(p) for j in range(p)]).alias("cross"),
        )

    columns = [f"_t{i}" for i in range(p)]

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, part in groups:
                x = part[columns].to_numpy(dtype=float)
                if not len(x):
                    continue
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                mean = x.mean(axis=0)
                x = x - mean
                sums[key] = add(sums.get(key, (0, None, None)), (len(x), mean, x.T @ x))
        for key, (n, mean, cross) in sums.items():
            out = pd.DataFrame({"n": [n], "mean": [mean + low], "cross": [cross.ravel()]})
            for name, value in zip(reversed(by), reversed(key)):
                out.insert(0, name, [value])
            yield out

    return merge_gram(rows.mapInPandas(partial, _state_schema(df, by)), p, by)


def collect_gram(states: DataFrame, names: list, by=()) -> dict:
    """by-key -> Gram. The p x p numbers of each state, never the data; all states together are bounded too."""
    by, p = list(by), len(names)
    most = min(BROADCAST_ROWS, max(MAX_NUMBERS // (p * p), 1))
    return {
        tuple(r[c] for c in by): Gram(
            list(names), r["n"], np.array(r["mean"], dtype=float), np.array(r["cross"], dtype=float).reshape(p, p))
        for r in small_rows(states, most, f"cross-product states of {p} terms")
    }


def subtract(total: Gram, part: Gram) -> Gram:
    """State of the rows in ``total`` that are not in ``part``."""
    n = total.n - part.n
    mean = (total.mean * total.n - part.mean * part.n) / n
    d = part.mean - mean
    cross = total.cross - part.cross - np.outer(d, d) * (part.n * n / total.n)
    return Gram(total.names, n, mean, cross)


def gram(df: DataFrame, terms: list) -> Gram:
    found = collect_gram(gram_states(df, terms), [t.name for t in terms])
    if not found:
        raise ValueError("no complete rows")
    return found[()]
