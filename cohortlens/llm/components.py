"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every node of the links ``a, b``; the root is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then follows the
    label's own label, so rounds grow with the logarithm of the longest chain.
    Labels are checkpointed every round and only the number of changes reaches the
    driver. Self links, repeated links and an empty table are fine; links with a
    null end are ignored.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    both = checkpoint(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    labels = checkpoint(labels)
    while True:
        near = (both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id"))
                .agg(F.min("root").alias("near")))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = checkpoint(step.join(up, "root").select("id", "old", F.least("root", "up").alias("root")))
        changed = step.where("root <> old").limit(1).count()
        labels = step.select("id", "root")
        if not changed:
            return labels
