"""Column names and logical column types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitize_name(name: str) -> str:
    """Lower case, ``-`` to ``_``, and ``_`` before a leading digit."""
    return re.sub(r"^([0-9])", r"_\1", name.lower().replace("-", "_"))


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def resolve(df_columns: list, name: str) -> str:
    """Exact column name first, then the sanitised one."""
    if name in df_columns:
        return name
    adapted = sanitize_name(name)
    if adapted in df_columns:
        return adapted
    raise ValueError(f"unknown column {name}")


def logical_type(field: T.StructField) -> str:
    """Fold a Spark type into int, numeric, char or varchar; reject the rest."""
    dt = field.dataType
    if isinstance(dt, T.CharType):
        return "char"
    if isinstance(dt, (T.StringType, T.VarcharType)):
        return "varchar"
    if isinstance(dt, T.IntegralType):
        return "int"
    if isinstance(dt, (T.FractionalType, T.DecimalType)):
        return "numeric"
    raise ValueError(f"Unsupported type {dt.simpleString()} on column {field.name}")


def is_nominal(df: DataFrame, name: str) -> bool:
    return logical_type(df.schema[name]) in ("char", "varchar")


def numeric_columns(df: DataFrame, names: list) -> list:
    return [c for c in names if not is_nominal(df, c)]


def nominal_columns(df: DataFrame, names: list) -> list:
    return [c for c in names if is_nominal(df, c)]


def name_at(names: list, position: str) -> Column:
    """The name at a position: rows carry the number and get the text once they are few."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.col(position))


def finite(x: Column) -> Column:
    """The value, or null when it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows without null or NaN in the columns (all by default).

    One condition per column: the optimizer copies a condition over many columns
    once per subset of renamed ones, which takes longer than the query.
    """
    conditions = []
    for c in dict.fromkeys(columns or df.columns):
        conditions.append(F.col(f"`{c}`").isNotNull())
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            conditions.append(~F.isnan(F.col(f"`{c}`")))
    return df.filter(reduce(lambda a, b: a & b, conditions))


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
