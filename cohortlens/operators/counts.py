"""Counts and provenance over feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import resolve
from cohortlens.model import FilterRule
from cohortlens.operators.filters import apply_filters


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_dataset(df: DataFrame, table: str, dataset_column: str | None, dataset: str) -> DataFrame:
    """Rows of one dataset; a table without a dataset column is one dataset named after it."""
    if dataset_column:
        return count_rows(df.filter(F.col(dataset_column) == dataset))
    if dataset.strip('"') == table:
        return count_rows(df)
    return count_rows(df.filter(F.lit(False)))


def count_filtered(df: DataFrame, rule: FilterRule | None) -> DataFrame:
    return count_rows(apply_filters(df, rule))


def count_group_by(df: DataFrame, column: str, rule: FilterRule | None = None) -> DataFrame:
    """Rows per value of a column, the value read as text."""
    column = resolve(df.columns, column)
    return (
        apply_filters(df, rule)
        .groupBy(F.col(column).cast("string").alias(column))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def datasets_used(
    df: DataFrame, table: str, dataset_column: str | None, rule: FilterRule | None = None
) -> DataFrame:
    """The datasets that own the rows a filter selects."""
    rows = apply_filters(df, rule)
    if dataset_column:
        return rows.select(F.col(dataset_column).alias("dataset")).distinct()
    return df.sparkSession.createDataFrame([] if rows.isEmpty() else [(table,)], "dataset string")


def require_rows(df: DataFrame, table: str, rule: FilterRule | None = None) -> DataFrame:
    """The filtered frame, or an error when no row matches. Reads one row only."""
    rows = apply_filters(df, rule)
    if rows.isEmpty():
        raise ValueError(f"No data in table {table} matching filters")
    return rows
