"""Statistics and histograms of every variable of a table in a few scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import nominal_columns, numeric_columns
from cohortlens.operators.histogram import BINS, nominal_histogram, numeric_histogram
from cohortlens.operators.summary import summary_statistics


def profile_summary(df: DataFrame, variables: list, grouping=()) -> DataFrame:
    """Summary rows of all variables; numeric ones share one scan, nominal ones another."""
    return summary_statistics(df, variables, grouping)


def profile_histograms(df: DataFrame, variables: list, grouping=(), bins: int = BINS) -> DataFrame:
    """Histogram rows of all variables in the layout of a single histogram."""
    numeric, nominal = numeric_columns(df, variables), nominal_columns(df, variables)
    parts = []
    if numeric:
        parts.append(numeric_histogram(df, numeric, grouping, bins))
    if nominal:
        rows = nominal_histogram(df, nominal, grouping)
        parts.append(rows.withColumn("bin", F.lit(None).cast("int")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def profile_table(df: DataFrame, groupings: list | None = None, exclude=()) -> tuple:
    """(summary, histograms) of every column that is not a key, for the default groupings."""
    groupings = [g for g in (groupings or []) if g in df.columns]
    variables = [c for c in df.columns if c not in exclude and c not in groupings]
    return profile_summary(df, variables, groupings), profile_histograms(df, variables, groupings)
