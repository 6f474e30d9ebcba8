"""Mean and confidence band of each variable per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dist import normal_quantile
from cohortlens.operators.moments import moment_columns, moment_states


def group_confidence_bands(df: DataFrame, variables: list, grouping, level: float = 0.95) -> DataFrame:
    """(group, variable, n, mean, std, lower, upper); several groupings make one label, none the group ``all``."""
    grouping = [grouping] if isinstance(grouping, str) else list(grouping)
    label = F.lit("all")
    if len(grouping) == 1:
        label = F.col(f"`{grouping[0]}`").cast("string")
    elif grouping:
        label = F.concat_ws(", ", *[F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("null")) for g in grouping])
    m = moment_columns()
    half = F.lit(normal_quantile(0.5 + level / 2)) * F.col("std") / F.sqrt("n")
    return (
        moment_states(df, variables, grouping)
        .select(label.alias("group"), "variable", "n",
                m["mean"].alias("mean"), m["std"].alias("std"))
        .withColumn("lower", F.col("mean") - half)
        .withColumn("upper", F.col("mean") + half)
    )
