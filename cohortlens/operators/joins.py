"""Key joins of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.keys import seeded_order, unit_interval
from cohortlens.model import FilterRule
from cohortlens.operators.filters import apply_filters


def key_join(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Equality on every key column; SQL null keys match nothing."""
    return left.join(right, on=list(keys), how=how)


def with_rnd(df: DataFrame, key: str, seed: float = 0.67) -> DataFrame:
    """Add ``_rnd`` in [0, 1), reproducible from the key and the seed."""
    return df.withColumn("_rnd", unit_interval(seeded_order(F.col(key), seed)))


def extend_features(
    df: DataFrame, key: str, rule: FilterRule | None = None,
    new_columns: dict[str, Column] | None = None, side: DataFrame | None = None,
    seed: float = 0.67,
) -> DataFrame:
    """The filtered table with extra feature columns and ``_rnd``.

    Columns given as expressions need no join. ``side`` is a frame with one row
    per key; its inner join keeps only the keys that it holds.
    """
    rows = with_rnd(apply_filters(df, rule), key, seed)
    for name, column in (new_columns or {}).items():
        rows = rows.withColumn(name, column)
    if side is not None:
        rows = key_join(rows, side, [key])
    names = [c for c in rows.columns if c != "_rnd"]
    return rows.select(*names, "_rnd")


def align(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Pair predictions with the ground truth by key, never by position."""
    return key_join(truth, predictions, [key])
