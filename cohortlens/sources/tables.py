"""Feature tables, data rows and datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.names import decimals_to_double, logical_type, sanitize_columns
from cohortlens.model import FeatureTable


class Catalog:
    """The configured feature tables by name."""

    def __init__(self, tables=()):
        self.tables = {t.name: t for t in tables}

    def add(self, table: FeatureTable) -> "Catalog":
        self.tables[table.name] = table
        return self

    def describe(self, name: str) -> FeatureTable:
        if name not in self.tables:
            raise KeyError(f"no table is registered as {name}")
        return self.tables[name]

    def frame(self, spark: SparkSession, name: str, sanitize: bool = False, columns=None) -> DataFrame:
        return feature_table(spark, self.describe(name), sanitize, columns)


def open_table(spark: SparkSession, table: FeatureTable) -> DataFrame:
    """The table as it lies at its source."""
    if callable(table.source):
        return table.source(spark)
    reader = spark.read.format(table.format).options(**table.options)
    return reader.load(table.source) if table.source else reader.load()


def feature_table(spark: SparkSession, table: FeatureTable, sanitize: bool = False, columns=None) -> DataFrame:
    """Scan a feature table; columns must fold into int, numeric, char or varchar.

    ``columns`` restricts the scan, so that other columns are neither read nor checked.
    """
    df = open_table(spark, table)
    if sanitize:
        df = sanitize_columns(df)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    for field in df.schema.fields:
        logical_type(field)
    return df


def describe_columns(df: DataFrame) -> list:
    """(column, logical type) of a feature table."""
    return [(f.name, logical_type(f)) for f in df.schema.fields]


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; nulls stay, decimals become doubles."""
    flat = decimals_to_double(df)
    return flat.select(F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in flat.columns]), {"ignoreNullFields": "false"}
    ).alias("json"))


@dataclass(frozen=True)
class Dataset:
    """A dataset and the tables that hold its rows; ``("*",)`` stands for all tables."""

    code: str
    label: str = ""
    description: str = ""
    tables: tuple = ("*",)
    anonymisation_level: str = "Anonymised"
    location: str | None = None


def resolve_datasets(registry: list, codes=()) -> list:
    """The registered datasets among ``codes``; unknown ones are dropped, none given means all."""
    if not codes:
        return list(registry)
    return [d for d in registry if d.code in set(codes)]


def list_datasets(spark: SparkSession, registry: list, table: str | None = None) -> DataFrame:
    """Registry rows, optionally those registered on one table."""
    rows = [
        (d.code, d.label, d.description, t, d.anonymisation_level, d.location)
        for d in registry for t in d.tables if table is None or t in ("*", table)
    ]
    return spark.createDataFrame(
        rows, "dataset string, label string, description string, table string, "
              "anonymisation_level string, location string",
    )


def scan_datasets(spark: SparkSession, catalog: Catalog, registry: list, codes=()) -> DataFrame:
    """Rows of the datasets, from every table that holds some, as one frame with ``dataset``."""
    wanted = resolve_datasets(registry, codes)
    if not wanted:
        raise ValueError("no such dataset")
    by_table: dict = {}
    for d in wanted:
        names = list(catalog.tables) if "*" in d.tables else d.tables
        for name in names:
            by_table.setdefault(name, []).append(d.code)
    out = None
    for name, ids in by_table.items():
        table, df = catalog.describe(name), catalog.frame(spark, name)
        if table.dataset_column:
            part = df.filter(F.col(table.dataset_column).isin(*ids))
            if table.dataset_column != "dataset":
                part = part.withColumnRenamed(table.dataset_column, "dataset")
        elif name in ids:  # a table without a dataset column is a dataset of its own
            part = df.withColumn("dataset", F.lit(name))
        else:
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table holds these datasets")
    return out
