"""Personalised PageRank features over the network of subjects and their category values.

Subjects with the same class and the same values are interchangeable, so the walk
runs over one row per such profile. A step goes from subjects to the values
they hold and back, which links subjects that share a value without forming the
pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import is_nominal
from cohortlens.operators.gram import nominal_levels
from cohortlens.operators.histogram import bin_index, numeric_ranges
from cohortlens.session import BROADCAST_ROWS, checkpoint

NUMERIC_BINS = 4
SMALL_ROWS = 10_000


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def network_features(
    df: DataFrame, key: str, target: str, columns: list, damping: float = 0.85, iters: int = 10,
    normalize: bool = True,
) -> DataFrame:
    """(key, ppr_<class>...): visit probability of a walk that restarts at the class's subjects.

    Numeric columns are cut into equal-width bins first. With ``normalize`` a
    subject's values add up to one over the classes.
    """
    classes = nominal_levels(df, [target])[target]
    numeric = [c for c in columns if not is_nominal(df, c)]
    ranges = numeric_ranges(df, numeric) if numeric else {}
    cells = []
    for i, c in enumerate(columns):
        value = bin_index(F.col(f"`{c}`").cast("double"), *ranges[c], NUMERIC_BINS) if c in ranges else F.col(f"`{c}`")
        cells.append(value.cast("string").alias(f"_v{i}"))
    values = [f"_v{i}" for i in range(len(columns))]
    subjects = df.select(F.col(key), F.col(f"`{target}`").cast("string").alias("_class"), *cells)
    counted = subjects.groupBy("_class", *values).agg(F.count(F.lit(1)).alias("m"))
    held = reduce(lambda a, b: a + b, [F.col(v).isNotNull().cast("int") for v in values])
    sizes = {r["_class"]: r["m"] for r in counted.groupBy("_class").agg(F.sum("m").alias("m")).collect()}
    restart = [
        F.when(F.col("_class") == c, F.lit(1.0 / sizes[c])).otherwise(F.lit(0.0)).alias(f"r{j}")
        for j, c in enumerate(classes)
    ]
    mass = [f"s{j}" for j in range(len(classes))]
    base = checkpoint(counted.select("*", held.alias("held"), *restart))

    def step(flows: DataFrame | None, small: bool) -> DataFrame:
        """Mass of every profile, from what its values hand back."""
        out = base
        if flows is None:
            return out.select("*", *[F.col(f"r{j}").alias(s) for j, s in enumerate(mass)])
        side = F.broadcast(flows) if small else flows
        for i, v in enumerate(values):
            part = side.filter(F.col("at") == i).select(
                F.col("value").alias(v), *[F.col(f"f_{s}").alias(f"_g{i}_{s}") for s in mass]
            )
            out = out.join(part, v, "left")
        returned = [
            reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_g{i}_{s}"), F.lit(0.0)) for i in range(len(values))])
            for s in mass
        ]
        return out.select(*base.columns, *[
            ((1 - damping) * F.col(f"r{j}") + damping * back).alias(s)
            for j, (s, back) in enumerate(zip(mass, returned))
        ])

    flows, small = None, False
    pairs = F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(v).alias("value")) for i, v in enumerate(values)
    ]))
    for turn in range(iters):
        spread = step(flows, small).select("m", "held", *mass, pairs).filter(F.col("value").isNotNull())
        summed = spread.groupBy("at", "value").agg(
            F.sum("m").alias("deg"), *[F.sum(F.col("m") * F.col(s) / F.col("held")).alias(f"f_{s}") for s in mass]
        )
        # a row per value: the only thing carried on, so the lineage stays one turn long
        flows = summed.select("at", "value", *[(F.col(f"f_{s}") / F.col("deg")).alias(f"f_{s}") for s in mass])
        if turn == 0:
            found = flows.limit(SMALL_ROWS + 1).collect()
            small = len(found) <= SMALL_ROWS  # the values stay the same in every turn
        elif small:
            found = flows.collect()
        flows = df.sparkSession.createDataFrame(found, flows.schema) if small else checkpoint(flows)
    profiles = checkpoint(step(flows, small).select("_class", *values, *mass))
    right = profiles.select(F.col("_class").alias("_c"), *[F.col(v).alias(f"_p{v}") for v in values], *mass)
    right = F.broadcast(right) if _is_small(profiles) else right
    cond = F.col("_class").eqNullSafe(F.col("_c"))
    for v in values:
        cond = cond & F.col(v).eqNullSafe(F.col(f"_p{v}"))
    total = reduce(lambda a, b: a + b, [F.col(s) for s in mass])
    features = [
        (F.when(total > 0, F.col(s) / total).otherwise(F.lit(0.0)) if normalize else F.col(s)).alias(f"ppr_{c}")
        for s, c in zip(mass, classes)
    ]
    return subjects.join(right, cond).select(key, *features)
