"""Projection and predicates: filter rules compiled to one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.names import resolve
from cohortlens.model import AlgorithmDef, FilterRule, RuleGroup


def _literal(value, dtype: T.DataType, field: str) -> Column:
    """The literal in the column's own type; rules carry their values as text."""
    try:
        if isinstance(dtype, T.BooleanType):
            value = str(value).strip().lower()
            if value not in ("true", "false"):
                raise ValueError(value)
            return F.lit(value == "true")
        if isinstance(dtype, T.IntegralType):
            number = float(value) if not isinstance(value, int) else value
            if number != int(number):  # 2.5 against an int column compares as double
                return F.lit(float(number))
            return F.lit(int(value) if isinstance(value, int) else int(number))
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.lit(float(value))
        if isinstance(dtype, T.DecimalType):
            return F.lit(str(value)).cast("decimal(38,18)")
        if isinstance(dtype, T.StringType):
            return F.lit(str(value))
    except (TypeError, ValueError) as e:
        raise ValueError(
            f"value {value!r} does not fit column {field} of type {dtype.simpleString()}"
        ) from e
    return F.lit(str(value)).cast(dtype)


def _text(column: Column) -> Column:
    return column.cast("string")


# operator -> (number of values or None for any, builder)
_OPERATORS = {
    "equal": (1, lambda c, v: c == v[0]),
    "notequal": (1, lambda c, v: c != v[0]),
    "less": (1, lambda c, v: c < v[0]),
    "lessorequal": (1, lambda c, v: c <= v[0]),
    "greater": (1, lambda c, v: c > v[0]),
    "greaterorequal": (1, lambda c, v: c >= v[0]),
    "between": (2, lambda c, v: c.between(v[0], v[1])),
    "notbetween": (2, lambda c, v: ~c.between(v[0], v[1])),
    "in": (None, lambda c, v: c.isin(*v)),
    "notin": (None, lambda c, v: ~c.isin(*v)),
    "isnull": (0, lambda c, v: c.isNull()),
    "isnotnull": (0, lambda c, v: c.isNotNull()),
    "isempty": (0, lambda c, v: _text(c) == ""),
    "isnotempty": (0, lambda c, v: _text(c) != ""),
    "beginswith": (1, lambda c, v: _text(c).startswith(v[0])),
    "notbeginswith": (1, lambda c, v: ~_text(c).startswith(v[0])),
    "contains": (1, lambda c, v: _text(c).contains(v[0])),
    "notcontains": (1, lambda c, v: ~_text(c).contains(v[0])),
    "endswith": (1, lambda c, v: _text(c).endswith(v[0])),
    "notendswith": (1, lambda c, v: ~_text(c).endswith(v[0])),
}
_TEXT_OPERATORS = {
    "beginswith", "notbeginswith", "contains", "notcontains", "endswith", "notendswith",
}


def compile_rule(rule: FilterRule, schema: T.StructType) -> Column:
    """One Column for a rule or a nested AND/OR tree; SQL three-valued logic."""
    if isinstance(rule, RuleGroup):
        parts = [compile_rule(r, schema) for r in rule.rules]
        condition = rule.condition.upper()
        if condition not in ("AND", "OR"):
            raise ValueError(f"unknown condition {rule.condition}")
        if not parts:
            return F.lit(True)
        return reduce(lambda a, b: a & b if condition == "AND" else a | b, parts)
    operator = rule.operator.replace("_", "").lower()
    if operator not in _OPERATORS:
        raise ValueError(f"unknown operator {rule.operator}")
    arity, build = _OPERATORS[operator]
    values = tuple(rule.values)
    if arity is not None and len(values) != arity:
        raise ValueError(f"{rule.operator} on {rule.field} takes {arity} values, got {len(values)}")
    if arity is None and not values:
        raise ValueError(f"{rule.operator} on {rule.field} needs at least one value")
    name = resolve(schema.names, rule.field)
    dtype = T.StringType() if operator in _TEXT_OPERATORS else schema[name].dataType
    return build(F.col(f"`{name}`"), [_literal(v, dtype, name) for v in values])


def apply_filters(df: DataFrame, rule: FilterRule | None = None) -> DataFrame:
    return df if rule is None else df.filter(compile_rule(rule, df.schema))


def select_features(df: DataFrame, variables=(), covariables=(), grouping=(), extra=()) -> DataFrame:
    """Variables, covariables and grouping, each column once, in that order."""
    names = dict.fromkeys(resolve(df.columns, c) for c in [*variables, *covariables, *grouping, *extra])
    return df.select(*[F.col(f"`{n}`") for n in names])


def dependent_only(df: DataFrame, query, key: str | None = None) -> DataFrame:
    """Ground truth: the target variables, with the key that aligns them."""
    return select_features(df, query.variables, extra=[key] if key else ())


def independent_only(df: DataFrame, query, key: str | None = None) -> DataFrame:
    """Model inputs: covariables and grouping, with the key that aligns them."""
    return select_features(df, (), query.covariables, query.grouping, extra=[key] if key else ())


def filter_nulls(
    df: DataFrame, variables=(), covariables=(), grouping=(),
    variables_can_be_null: bool = False, covariables_can_be_null: bool = False,
) -> DataFrame:
    """Keep rows whose targets / covariables / grouping are present, as the algorithm needs."""
    required = []
    if not variables_can_be_null:
        required += variables
    if not covariables_can_be_null:
        required += [*covariables, *grouping]
    names = list(dict.fromkeys(resolve(df.columns, c) for c in required))
    if not names:
        return df
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names]))


def filter_datasets(df: DataFrame, dataset_column: str | None, datasets=()) -> DataFrame:
    """Rows of the named datasets; no-op without a dataset column or without names."""
    if not dataset_column or not datasets:
        return df
    return df.filter(F.col(dataset_column).isin(*datasets))


def experiment_null_policy(definitions: list[AlgorithmDef], strict_nulls: bool = False) -> tuple:
    """One null policy for every algorithm of an experiment, so that all see the same rows.

    Nulls stay when any algorithm allows them; ``strict_nulls`` keeps them only
    when all of them do.
    """
    fold = all if strict_nulls else any
    return (
        fold(d.variables_can_be_null for d in definitions),
        fold(d.covariables_can_be_null for d in definitions),
    )


def order_by(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(resolve(df.columns, column)))
