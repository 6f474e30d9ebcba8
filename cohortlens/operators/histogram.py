"""Histograms of numeric and nominal variables, one series per group plus ``all``.

Null, NaN and infinite values lie in no bin and do not widen the range. A group
that has nothing else keeps its series, with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import finite, name_at, nominal_columns, numeric_columns
from cohortlens.operators.levels import with_overall
from cohortlens.operators.summary import group_labels, value_counts

BINS = 20


def numeric_ranges(df: DataFrame, variables: list) -> dict:
    """variable -> (min, max) of its finite values, or nothing for a variable without any."""
    aggs = []
    for i, v in enumerate(variables):
        x = finite(F.col(f"`{v}`").cast("double"))
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {v: (row[f"lo{i}"], row[f"hi{i}"]) for i, v in enumerate(variables) if row[f"lo{i}"] is not None}


def bin_index(x: Column, lo: float, hi: float, bins: int, drop_max: bool = False) -> Column:
    """Equal-width bin 0..bins-1, null without a finite value; the last bin is closed unless ``drop_max``."""
    x = finite(x)
    if lo == hi:
        return F.when(x.isNotNull(), F.lit(0))
    index = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int")
    inside = x < F.lit(hi) if drop_max else x.isNotNull()
    return F.when(inside, F.least(index, F.lit(bins - 1)))  # least() passes over nulls


def bin_counts(
    df: DataFrame, ranges: dict, by=(), bins: int = BINS, drop_max: bool = False
) -> DataFrame:
    """(by..., variable, bin, n): the mergeable state of numeric histograms with common edges; bin null: no bin."""
    each = F.array(*[
        bin_index(F.col(f"`{v}`").cast("double"), lo, hi, bins, drop_max) for v, (lo, hi) in ranges.items()
    ])
    counts = (
        df.select(*by, F.posexplode(each).alias("at", "bin"))
        .groupBy(*by, "at", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(*by, name_at(list(ranges), "at").alias("variable"), "bin", "n")


def bin_edges(variable: Column, bin_: Column, ranges: dict, bins: int) -> tuple:
    def pick(mapping):
        return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), variable)

    lo = pick({v: lo for v, (lo, _) in ranges.items()})
    width = pick({v: (hi - lo) / bins for v, (lo, hi) in ranges.items()})
    return lo + bin_ * width, lo + (bin_ + 1) * width


def finish_bins(counts: DataFrame, ranges: dict, grouping=(), bins: int = BINS) -> DataFrame:
    """Series with empty bins filled in, and bin labels, from bin counts."""
    grouping = list(grouping)
    merged = with_overall(counts, grouping, ["variable", "bin"], [F.sum("n").alias("n")])
    # one array of counts per series (at most ``bins`` entries), so no spine join is needed
    series = merged.groupBy(*grouping, "_all", "variable").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("by_bin")
    )
    rows = series.select(
        *group_labels(grouping, F.col("_all")), "variable",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "by_bin",
    )
    lo, hi = bin_edges(F.col("variable"), F.col("bin"), ranges, bins)
    return rows.select(
        "group_variables", "group", "variable", "bin",
        F.format_string("%.2f - %.2f", lo, hi).alias("category"),
        F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)).alias("count"),
    )


def numeric_histogram(
    df: DataFrame, variables: list, grouping=(), bins: int = BINS, drop_max: bool = False
) -> DataFrame:
    ranges = numeric_ranges(df, variables)
    if not ranges:
        raise ValueError(f"no values in {', '.join(variables)}")
    return finish_bins(bin_counts(df, ranges, grouping, bins, drop_max), ranges, grouping, bins)


def nominal_histogram(
    df: DataFrame, variables: list, grouping=(), categories: dict | None = None
) -> DataFrame:
    """Count per category; categories declared in the dictionary appear even when absent."""
    grouping = list(grouping)
    counts = value_counts(df, variables, grouping).filter(F.col("value").isNotNull())
    if categories:
        declared = F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.lit(c).alias("value"))
            for v in variables for c in categories.get(v, ())
        ]))
        groups = counts.select(*grouping).distinct() if grouping else df.sparkSession.range(1).select()
        zeros = groups.select(*grouping, declared, F.lit(0).cast("bigint").alias("n"))
        counts = counts.unionByName(zeros)
    return finish_categories(counts, grouping)


def finish_categories(counts: DataFrame, grouping=()) -> DataFrame:
    """Series per group and overall from category counts, any number of rows to a group and category."""
    grouping = list(grouping)
    merged = with_overall(counts, grouping, ["variable", "value"], [F.sum("n").alias("n")])
    return merged.select(
        *group_labels(grouping, F.col("_all")), "variable",
        F.col("value").alias("category"), F.col("n").alias("count"),
    )


def series_columns(df: DataFrame, grouping=(), covariables=()) -> list:
    return list(dict.fromkeys([*grouping, *nominal_columns(df, list(covariables))]))


def histogram(
    df: DataFrame, variable: str, grouping=(), bins: int = BINS, drop_max: bool = False,
    categories: dict | None = None, covariables=(),
) -> DataFrame:
    """Histogram of one variable; grouping columns and nominal covariables make the series."""
    by = series_columns(df, grouping, covariables)
    if numeric_columns(df, [variable]):
        return numeric_histogram(df, [variable], by, bins, drop_max)
    return nominal_histogram(df, [variable], by, categories)
