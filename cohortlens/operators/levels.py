"""Group rows and the overall row side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_levels(df: DataFrame, grouping: list) -> DataFrame:
    """Each row once under its group and once under the overall group, told apart by ``_all``."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in grouping]
    if not grouping:
        return df.select(*others, F.lit(True).alias("_all"))
    own = F.struct(*[F.col(f"`{g}`").alias(g) for g in grouping], F.lit(False).alias("_all"))
    overall = F.struct(*[F.lit(None).cast(df.schema[g].dataType).alias(g) for g in grouping], F.lit(True).alias("_all"))
    return df.select(*others, F.inline(F.array(own, overall)))


def with_overall(states: DataFrame, grouping: list, keys: list, merge: list) -> DataFrame:
    """Group rows plus overall rows from the (small) states; ``_all`` tells them apart."""
    if not grouping:
        return states.groupBy(*keys).agg(*merge).withColumn("_all", F.lit(True))
    sets = [[*grouping, *keys], list(keys)]
    return states.groupingSets(sets, *grouping, *keys).agg(
        *merge, (F.grouping(grouping[0]) == 1).alias("_all")
    )
