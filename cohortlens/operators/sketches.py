"""Rank sketches: quartiles of states whose rows are elsewhere.

A sketch (Spark's KLL aggregate) keeps a bounded sample of a group's values with their weights. Sketches of
datasets, folds or batches merge into the sketch of all their rows, in any order and number. A
quantile taken from it is a value whose rank lies within ``rank_error`` of the one asked for; up to
``SKETCH_K`` values the sketch holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKETCH_K = 800  # values kept at the top level; a sketch takes at most about 20 kB


def rank_error(k: int = SKETCH_K) -> float:
    """Largest distance of ranks, as a share of the rows, that a sketch of size k exceeds in one case of a hundred."""
    return 2.296 / k**0.9021


def sketch_column(x: Column) -> Column:
    """Aggregate: the sketch of a double column, null without values. NaN, which sorts last, goes in as infinity."""
    value = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)
    return F.when(F.count(x) > 0, F.kll_sketch_agg_double(value, F.lit(SKETCH_K)))


def merged_sketch(sketch: str = "sketch") -> Column:
    """Aggregate: one sketch from many, null when all are null."""
    return F.when(F.count(sketch) > 0, F.kll_merge_agg_double(sketch, F.lit(SKETCH_K)))


def sketch_quantiles(probs: list) -> Column:
    """The values at the given shares of a state's rows, from its ``sketch``, ``n`` and ``nans``."""
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    values = [F.when(F.lit(p) * (F.col("n") - 1) > F.col("n") - F.col("nans") - 1, F.lit(float("nan"))).otherwise(
        F.get(found, F.lit(i))) for i, p in enumerate(probs)]
    return F.when(F.col("sketch").isNotNull(), F.array(*values))
