"""Statistics and data mining over cohort feature tables, as Spark jobs."""

from cohortlens.model import (
    AlgorithmSpec,
    ExperimentQuery,
    FeatureTable,
    MiningQuery,
    Rule,
    RuleGroup,
    ValidationSpec,
    rule_from_json,
)

__all__ = [
    "AlgorithmSpec",
    "ExperimentQuery",
    "FeatureTable",
    "MiningQuery",
    "Rule",
    "RuleGroup",
    "ValidationSpec",
    "rule_from_json",
]
