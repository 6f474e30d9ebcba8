"""Personalised PageRank from chosen subjects, by pushing only what is worth pushing.

A walk goes from a subject to one of its values and on to a subject that holds it, and restarts at its seed with chance 1 - damping.
Instead of iterating over all subjects for every seed, each seed carries two sparse lists: estimates, and
residuals that are still to be passed on. A residual waits at a subject or at a value until it is
large enough for its degree, so a value that a third of all subjects share costs nothing until enough
has gathered there. The walk is reversible, so what waits bounds the error of every row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import is_nominal
from cohortlens.operators.histogram import bin_index, numeric_ranges
from cohortlens.session import checkpoint

NUMERIC_BINS = 4
TURNS_A_JOB = 4


def turns_needed(damping: float, error: float) -> int:
    """Turns after which nothing large enough to push can be left."""
    return max(1, math.ceil(math.log(error / 2) / math.log(damping)))


def subject_walks(
    df: DataFrame, key: str, columns: list, seeds: DataFrame, damping: float = 0.85, error: float = 1e-4, totals=(),
) -> DataFrame:
    """(seed, key, score) for the subjects that a seed's walk visits noticeably.

    ``seeds`` has one column of keys. A score is below the exact one by no more than ``error`` times the number of values
    that the subject holds; subjects without a row have at most that. A seed has at most 2 / (error (1 - damping))
    rows, and that also bounds what a turn moves for it, whatever the degrees of the values. Numeric columns are
    cut into equal-width bins; a null value links with nothing, and a seed without any value keeps what it starts with.
    Subjects with equal values are one profile. No turn waits for the driver; their number follows from
    ``damping`` and ``error``.

    With ``totals``, columns of ``df``, the result is (seed, totals..., subjects, score): the rows of ``df`` whose key the
    walk visits, counted and their scores added up. Then no row per seed and subject is made: keys with the same
    profiles are counted first and scored once.
    """
    if not 0 < damping < 1 or not 0 < error < 1:
        raise ValueError("damping and error lie between 0 and 1")
    numeric = [c for c in columns if not is_nominal(df, c)]
    ranges = numeric_ranges(df, numeric) if numeric else {}
    cells = []
    for i, c in enumerate(columns):
        value = bin_index(F.col(f"`{c}`").cast("double"), *ranges[c], NUMERIC_BINS) if c in ranges else F.col(f"`{c}`")
        cells.append(F.when(value.isNotNull(), F.concat(F.lit(f"{i}:"), value.cast("string"))).alias(f"_v{i}"))
    values = F.array_compact(F.array(*[F.col(f"_v{i}") for i in range(len(columns))]))
    kept = [F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(totals)]
    marks = [f"_t{i}" for i in range(len(kept))]
    subjects = df.select(F.col(f"`{key}`").alias("_key"), *kept, *cells).select("_key", *marks, values.alias("_values"))
    subjects = checkpoint(subjects.withColumn("_profile", F.xxhash64("_values")).filter(F.col("_key").isNotNull()))
    profiles = subjects.groupBy("_profile", "_values").agg(F.count(F.lit(1)).alias("_m")).withColumn("_held", F.size("_values"))
    edges = profiles.select("_profile", "_m", "_held", F.explode("_values").alias("_value"))
    degrees = edges.groupBy("_value").agg(F.sum("_m").alias("_deg"))
    edges = checkpoint(edges.join(degrees, "_value"))
    least = error / 2

    start = checkpoint(seeds.select(F.col(seeds.columns[0]).alias("_seed")).distinct().join(subjects, F.col("_seed") == F.col("_key")).select("_seed", "_profile", "_values"))
    own = F.when(F.size("_values") > 0, F.lit(1.0 - damping)).otherwise(F.lit(1.0)).alias("_own")
    # the seed's first step; from then on a profile's subjects are alike
    waiting = start.select("_seed", F.explode("_values").alias("_value"), (F.lit(damping) / F.size("_values")).alias("_rho"))
    reached = start.select("_seed", "_profile", F.lit(0.0).alias("_p"), F.lit(0.0).alias("_r")).filter(F.lit(False))
    for turn in range(turns_needed(damping, error)):
        # what waits at a value goes to the subjects that hold it, an equal share each
        held = waiting.join(degrees, "_value")
        ready = F.col("_rho") > least * F.col("_deg")
        given = held.filter(ready).select("_seed", "_value", "_rho").join(
            edges.select("_value", "_profile", "_deg"), "_value").select(
            "_seed", "_profile", F.lit(0.0).alias("_p"), (F.col("_rho") / F.col("_deg")).alias("_r"))
        reached = reached.unionByName(given).groupBy("_seed", "_profile").agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
        # what waits at a subject is kept in part and goes on to its values
        pushed = reached.join(profiles.select("_profile", "_held"), "_profile")
        moves = F.col("_r") > least * F.col("_held")
        onward = pushed.filter(moves).select("_seed", "_profile", "_r").join(edges.select("_profile", "_m", "_held", "_value"), "_profile").select(
            "_seed", "_value", (damping * F.col("_r") * F.col("_m") / F.col("_held")).alias("_rho"))
        waiting = held.filter(~ready).select("_seed", "_value", "_rho").unionByName(onward).groupBy("_seed", "_value").agg(F.sum("_rho").alias("_rho"))
        reached = pushed.select(
            "_seed", "_profile", F.when(moves, F.col("_p") + (1 - damping) * F.col("_r")).otherwise(F.col("_p")).alias("_p"),
            F.when(moves, F.lit(0.0)).otherwise(F.col("_r")).alias("_r"))
        if turn % TURNS_A_JOB == TURNS_A_JOB - 1:
            reached, waiting = checkpoint(reached), checkpoint(waiting)
    if totals:
        groups = _totals(subjects, marks, reached.filter(F.col("_p") > 0), start.select("_seed", own))
        return groups.select(F.col("_seed").alias("seed"), *[F.col(m).alias(c) for m, c in zip(marks, totals)], "subjects", "score")
    found = reached.filter(F.col("_p") > 0).join(subjects.select("_key", "_profile"), "_profile").select("_seed", "_key", F.col("_p").alias("score"))
    seeded = start.select("_seed", F.col("_seed").alias("_key"), own.alias("score"))
    total = found.unionByName(seeded).groupBy("_seed", "_key").agg(F.sum("score").alias("score"))
    return total.select(F.col("_seed").alias("seed"), F.col("_key").alias(key), "score")


def _totals(subjects: DataFrame, marks: list, reached: DataFrame, own: DataFrame) -> DataFrame:
    """(_seed, marks..., subjects, score) over the rows of the keys that a seed reached, itself included.

    A key scores what its rows' profiles do, and each of its rows counts with the key's score. Keys with the same number of
    rows of each profile are alike, so the walk is joined with one bundle of profiles for all of them.
    """
    def bundled(rows):
        """(_key, _rows, _bundle): per key its rows by marks and profile, and by profile alone, in order."""
        counted = rows.groupBy("_key", *marks, "_profile").agg(F.count(F.lit(1)).alias("_n"))
        each = counted.groupBy("_key").agg(F.collect_list(F.struct(*marks, "_profile", "_n")).alias("_rows"))
        profiles = F.array_sort(F.array_distinct(F.col("_rows._profile")))
        of_profile = F.transform(profiles, lambda p: F.struct(p.alias("_profile"), F.aggregate(
            F.filter("_rows", lambda r: r["_profile"] == p), F.lit(0).cast("bigint"), lambda a, r: a + r["_n"]).alias("_c")))
        return each.select("_key", "_rows", of_profile.alias("_bundle"))

    keys = bundled(subjects)
    classes = checkpoint(keys.select("_bundle", F.inline("_rows")).groupBy("_bundle", *marks).agg(F.sum("_n").alias("_n")))
    holding = classes.select("_bundle").distinct().select("_bundle", F.inline("_bundle"))
    visited = checkpoint(reached.join(holding, "_profile").groupBy("_seed", "_bundle").agg(F.sum(F.col("_p") * F.col("_c")).alias("_score")))
    walked = visited.join(classes, "_bundle").select(
        "_seed", *marks, F.col("_n").alias("subjects"), (F.col("_n") * F.col("_score")).alias("score"))
    # a seed's own share goes to its rows; they are counted here if the walk did not come back to them
    seeds = own.groupBy("_seed").agg(F.sum("_own").alias("_own"))
    at = bundled(subjects.join(seeds, F.col("_key") == F.col("_seed"), "left_semi")).withColumnRenamed("_key", "_seed").join(seeds, "_seed")
    seeded = at.join(visited, ["_seed", "_bundle"], "left").select("_seed", F.col("_score").isNull().alias("_new"), "_own", F.inline("_rows")).select(
        "_seed", *marks, F.when(F.col("_new"), F.col("_n")).otherwise(F.lit(0)).alias("subjects"), (F.col("_n") * F.col("_own")).alias("score"))
    return walked.unionByName(seeded).groupBy("_seed", *marks).agg(F.sum("subjects").alias("subjects"), F.sum("score").alias("score"))
