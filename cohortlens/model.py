"""Query and table descriptions. Plain data, no Spark in here."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Union


@dataclass(frozen=True)
class Rule:
    """One comparison of a column with values, e.g. ``Rule("age", "less", ("30",))``."""

    field: str
    operator: str
    values: tuple = ()


@dataclass(frozen=True)
class RuleGroup:
    """Rules combined with AND or OR, nested to any depth."""

    condition: str
    rules: tuple


FilterRule = Union[Rule, RuleGroup]


def rule_from_json(doc: dict | None) -> FilterRule | None:
    """Read the rule-builder JSON form ``{condition, rules}`` / ``{field, operator, value}``."""
    if not doc:
        return None
    if "condition" in doc:
        rules = tuple(r for r in map(rule_from_json, doc.get("rules", [])) if r is not None)
        return RuleGroup(doc["condition"], rules) if rules else None
    values = doc.get("value", doc.get("values", ()))
    if values is None:
        values = ()
    elif not isinstance(values, (list, tuple)):
        values = (values,)
    return Rule(doc["field"], doc["operator"], tuple(values))


def all_of(*rules: FilterRule | None) -> FilterRule | None:
    """AND of the rules that are given; ``None`` when there are none."""
    present = tuple(r for r in rules if r is not None)
    if not present:
        return None
    return present[0] if len(present) == 1 else RuleGroup("AND", present)


@dataclass(frozen=True)
class FeatureTable:
    """A wide table with one row per subject.

    ``source`` is a path read with ``format`` and ``options``, or a callable that
    takes the session and returns a DataFrame. A JDBC table uses ``format="jdbc"``
    with ``dbtable``, ``partitionColumn`` and bounds in ``options``.
    """

    name: str
    source: Any = None
    primary_key: str | None = None
    dataset_column: str | None = None
    seed: float = 0.67
    format: str = "parquet"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AlgorithmSpec:
    code: str
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ValidationSpec:
    code: str = "kfold"
    parameters: dict = field(default_factory=lambda: {"k": 5})


@dataclass(frozen=True)
class MiningQuery:
    variables: tuple
    target_table: str
    covariables: tuple = ()
    grouping: tuple = ()
    filters: FilterRule | None = None
    datasets: tuple = ()
    algorithm: AlgorithmSpec | None = None
    covariables_must_exist: bool = False
    user: str = "anonymous"

    @property
    def all_columns(self) -> list:
        return list(dict.fromkeys([*self.variables, *self.covariables, *self.grouping]))


@dataclass(frozen=True)
class ExperimentQuery:
    variables: tuple
    target_table: str
    algorithms: tuple
    covariables: tuple = ()
    grouping: tuple = ()
    filters: FilterRule | None = None
    training_datasets: tuple = ()
    testing_datasets: tuple = ()
    validation_datasets: tuple = ()
    validations: tuple = ()
    covariables_must_exist: bool = False
    user: str = "anonymous"

    @property
    def all_columns(self) -> list:
        return list(dict.fromkeys([*self.variables, *self.covariables, *self.grouping]))


@dataclass(frozen=True)
class AlgorithmDef:
    """What the engine must know of an algorithm before it runs it."""

    code: str
    run: Any
    predictive: bool = False
    variables_can_be_null: bool = False
    covariables_can_be_null: bool = False
    mergeable: bool = False
    defaults: dict = field(default_factory=dict)
    all_variables: bool = False
