"""Summary statistics of numeric and nominal variables, per group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import logical_type, name_at, nominal_columns, numeric_columns
from cohortlens.operators.levels import with_overall
from cohortlens.operators.moments import merged_levels, moment_columns, moment_states
from cohortlens.operators.quantiles import DIRECT_ROWS, exact_percentiles
from cohortlens.operators.sketches import sketch_quantiles
from cohortlens.session import checkpoint

PROBS = [0.25, 0.5, 0.75]

SUMMARY_COLUMNS = [
    "group_variables", "group", "index", "label", "type", "count", "null_count",
    "unique", "top", "frequency", "mean", "std", "EX^2", "min", "max", "25%", "50%", "75%",
]


def group_labels(grouping: list, is_all: Column) -> list:
    """``group_variables`` and ``group`` of a result row; the overall group is ``all``."""
    if not grouping:
        return [F.array().cast("array<string>").alias("group_variables"),
                F.array(F.lit("all")).alias("group")]
    names = F.array(*[F.lit(g) for g in grouping])
    values = F.array(*[F.col(f"`{g}`").cast("string") for g in grouping])
    return [
        F.when(is_all, F.array().cast("array<string>")).otherwise(names).alias("group_variables"),
        F.when(is_all, F.array(F.lit("all"))).otherwise(values).alias("group"),
    ]


def numeric_summary(
    df: DataFrame, variables: list, grouping=(), direct_rows: int = DIRECT_ROWS,
    percentiles: bool = True,
) -> DataFrame:
    grouping = list(grouping)
    df = df.select(*dict.fromkeys([*grouping, *variables]))
    # one row per group and variable; read several times below
    states = checkpoint(moment_states(df, variables, grouping))
    return summary_of_states(states, grouping, df if percentiles else None, variables, direct_rows)


def summary_of_states(
    states: DataFrame, grouping=(), df: DataFrame | None = None, variables=(), direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Rows of ``numeric_summary`` from moment states of the groups, any number of states to a group.

    With the rows ``df`` at hand the percentiles are exact: the merged states give counts and edges, a
    second pass the values. Without them they come from the states' sketches, within ``rank_error``;
    states without sketches have none.
    """
    grouping = list(grouping)
    merged = merged_levels(states, grouping)
    if df is not None:
        merged = checkpoint(merged)  # the percentiles read it again
    m = moment_columns()
    out = merged.select(
        *grouping, "_all", F.col("variable").alias("index"),
        F.col("n").alias("count"), F.col("nulls").alias("null_count"),
        m["mean"].alias("mean"), m["std"].alias("std"), m["EX^2"].alias("EX^2"), "min", "max",
        *([] if df is not None else
          [(sketch_quantiles(PROBS) if "sketch" in merged.columns else F.lit(None).cast("array<double>")).alias("q")]),
    )
    if df is not None:
        levels = [*grouping, "_all"]
        found = exact_percentiles(df, list(variables), grouping, PROBS, merged, direct_rows)
        q = found.select(*[F.col(g).alias(f"_p_{g}") for g in levels], F.col("variable").alias("_p_v"), "q")
        cond = F.col("index") == F.col("_p_v")
        for g in levels:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
        out = out.join(q, cond, "left")
    return out.select(
        *group_labels(grouping, F.col("_all")), "index", "count", "null_count",
        F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("bigint").alias("frequency"),
        "mean", "std", "EX^2", "min", "max",
        F.get("q", F.lit(0)).alias("25%"), F.get("q", F.lit(1)).alias("50%"), F.get("q", F.lit(2)).alias("75%"),
    )


def value_counts(df: DataFrame, variables: list, by=()) -> DataFrame:
    """(by..., variable, value, n): the mergeable state of nominal variables."""
    each = F.array(*[F.col(f"`{v}`").cast("string") for v in variables])
    counts = df.select(*by, F.posexplode(each).alias("at", "value")).groupBy(*by, "at", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(*by, name_at(list(variables), "at").alias("variable"), "value", "n")


def nominal_summary(df: DataFrame, variables: list, grouping=()) -> DataFrame:
    """Counts, number of categories and the most frequent one (ties: the smallest)."""
    return summary_of_counts(value_counts(df, variables, grouping), grouping)


def summary_of_counts(counts: DataFrame, grouping=()) -> DataFrame:
    """Rows of ``nominal_summary`` from value counts of the groups, any number of rows to a group and value."""
    grouping = list(grouping)
    counts = with_overall(counts, grouping, ["variable", "value"], [F.sum("n").alias("n")])
    seen = F.col("value").isNotNull()
    order = F.when(seen, F.struct(-F.col("n"), F.col("value")))
    out = counts.groupBy(*grouping, "_all", "variable").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.when(seen, F.lit(1))).alias("unique"),
        F.min_by("value", order).alias("top"),
        F.max(F.when(seen, F.col("n"))).alias("frequency"),
    )
    nothing = F.lit(None).cast("double")
    return out.select(
        *group_labels(grouping, F.col("_all")), F.col("variable").alias("index"),
        "count", "null_count", "unique", "top", "frequency",
        *[nothing.alias(c) for c in ("mean", "std", "EX^2", "min", "max", "25%", "50%", "75%")],
    )


def summary_statistics(
    df: DataFrame, variables: list, grouping=(), labels: dict | None = None,
    types: dict | None = None, direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One row per variable and group in the layout of ``SUMMARY_COLUMNS``."""
    numeric, nominal = numeric_columns(df, variables), nominal_columns(df, variables)
    parts = []
    if numeric:
        parts.append(numeric_summary(df, numeric, grouping, direct_rows))
    if nominal:
        parts.append(nominal_summary(df, nominal, grouping))
    return described(parts, df, variables, labels, types)


def described(parts: list, df: DataFrame, variables: list, labels: dict | None = None, types: dict | None = None) -> DataFrame:
    """Numeric and nominal rows together, with the variables' labels and types. Of ``df`` only the schema is used."""
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kinds = {"int": "integer", "numeric": "real", "char": "polynominal", "varchar": "polynominal"}
    type_of = {v: (types or {}).get(v) or kinds[logical_type(df.schema[v])] for v in variables}

    def lookup(mapping):
        return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col("index"))

    out = out.withColumn("label", lookup({v: (labels or {}).get(v, v) for v in variables}))
    return out.withColumn("type", lookup(type_of)).select(*SUMMARY_COLUMNS)
