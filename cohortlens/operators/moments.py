"""Mergeable moment states of numeric variables.

A state is (n, nulls, mean, m2, min, max) with m2 the sum of squared deviations
from the state's own mean. Each group is centred on itself, so groups far apart
do not spoil each other. States of a variable merge by adding n and m2 and what
the means lie apart; the same rows serve per-group, per-dataset, per-fold and
per-batch results. With ``sketches`` a state also holds a rank sketch and the number of NaN values,
so that merged states have quartiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import finite
from cohortlens.operators.levels import expand_levels
from cohortlens.operators.sketches import merged_sketch, sketch_column

COLUMNS_PER_PASS = 60
STATE_COLUMNS = ("variable", "n", "nulls", "mean", "m2", "min", "max")
SKETCH_COLUMNS = ("nans", "sketch")


def anchors(df: DataFrame, variables: list) -> dict:
    """The least finite value of each variable. Taken off before sums, it saves digits of values far from 0."""
    found = df.agg(*[F.min(finite(F.col(f"`{v}`").cast("double"))) for v in variables]).first()
    return {v: x if x is not None else 0.0 for v, x in zip(variables, found)}


def moment_states(df: DataFrame, variables: list, by=(), sketches: bool = False) -> DataFrame:
    """One state row per variable and ``by`` group.

    All variables share a scan: one wide aggregate, turned long after it has
    shrunk to one row per group. Very wide tables go in column batches.
    """
    variables, by = list(variables), list(by)
    if clash := sorted(set(by) & {*STATE_COLUMNS, *SKETCH_COLUMNS}):
        raise ValueError(f"rename the grouping columns {', '.join(clash)}: states use these names themselves")
    low, batches = anchors(df, variables), []
    for at in range(0, len(variables), COLUMNS_PER_PASS):
        batch = variables[at:at + COLUMNS_PER_PASS]
        aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
        for i, v in enumerate(batch):
            x = F.col(f"`{v}`").cast("double")
            off = x - F.lit(low[v])
            aggs += [
                F.count(x).alias(f"_n{i}"), F.avg(off).alias(f"_m{i}"), F.var_pop(off).alias(f"_v{i}"),
                F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}"),
            ]
            ranks = []
            if sketches:
                aggs += [F.count_if(F.isnan(x)).alias(f"_nan{i}"), sketch_column(x).alias(f"_s{i}")]
                ranks = [F.col(f"_nan{i}").alias("nans"), F.col(f"_s{i}").alias("sketch")]
            rows.append(F.struct(
                F.lit(v).alias("variable"),
                F.col(f"_n{i}").alias("n"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
                (F.col(f"_m{i}") + F.lit(low[v])).alias("mean"),
                F.coalesce(F.col(f"_v{i}") * F.col(f"_n{i}"), F.lit(0.0)).alias("m2"),
                F.col(f"_lo{i}").alias("min"),
                F.col(f"_hi{i}").alias("max"),
                *ranks,
            ))
        wide = df.groupBy(*by).agg(*aggs)
        batches.append(wide.select(*by, F.inline(F.array(*rows))))
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def merge_moments(states: DataFrame, by=()) -> DataFrame:
    """One state per ``by`` group and variable.

    The common mean comes first; then every state adds its own m2 and its rows times
    the squared distance of its mean from the common one, so nothing cancels.
    """
    keys = [*by, "variable"]
    centre = states.groupBy(*keys).agg(
        (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    centre = centre.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mean")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    apart = F.col("mean") - F.col("_mean")
    ranks = [F.sum("nans").alias("nans"), merged_sketch().alias("sketch")] if "sketch" in states.columns else []
    return states.join(centre, same).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.coalesce(F.col("n") * apart * apart, F.lit(0.0))).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), *ranks,
    )


def merged_levels(states: DataFrame, grouping: list) -> DataFrame:
    """States of the groups and of all rows; ``_all`` tells them apart."""
    return merge_moments(expand_levels(states, grouping), [*grouping, "_all"])


def moment_columns() -> dict:
    """mean, sample std, mean of squares and population variance from a state."""
    some = F.col("n") > 0
    return {
        "mean": F.when(some, F.col("mean")),
        "std": F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))),
        "EX^2": F.when(some, F.col("mean") * F.col("mean") + F.col("m2") / F.col("n")),
        "var_pop": F.when(some, F.col("m2") / F.col("n")),
    }
