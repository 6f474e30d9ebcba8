"""Exact percentiles per group and overall, for many variables.

Groups up to ``DIRECT_ROWS`` values use the built-in exact aggregate, whose
buffer holds every distinct value of a group in one task. Larger ones, such as
the whole table, are narrowed down: count rows in equal-width buckets, keep the
buckets that hold the wanted ranks, and go on inside these until few values are
left. Each step is a scan with a map-side aggregate whose size does not depend
on the number of rows; from the second one on only rows of wanted buckets leave
the scan. Infinite values and NaN (which sorts last) have buckets of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.names import finite
from cohortlens.operators.levels import expand_levels, with_overall
from cohortlens.session import BROADCAST_ROWS, checkpoint, small_rows

DIRECT_ROWS = 4_000_000
BUCKETS = 4096


def direct_percentiles(df: DataFrame, variables: list, by: list, probs: list) -> DataFrame:
    """(by..., variable, q) with the built-in aggregate; for groups of bounded size."""
    wide = df.groupBy(*by).agg(*[
        F.percentile(F.col(f"`{v}`").cast("double"), probs).alias(f"_q{i}")
        for i, v in enumerate(variables)
    ])
    rows = [F.struct(F.lit(v).alias("variable"), F.col(f"_q{i}").alias("q")) for i, v in enumerate(variables)]
    return wide.select(*by, F.inline(F.array(*rows)))


def _targets(n: int, probs: list) -> list:
    """Per probability the two neighbouring 0-based ranks and the position between them."""
    positions = [p * (n - 1) for p in probs]
    return [(int(x), min(int(x) + 1, n - 1), x) for x in positions]


def _bucket(value, lo, hi, buckets: int):
    """Bucket 0..buckets-1; never decreasing in the value, which is all that exactness needs."""
    share = (value / 2 - lo / 2) / (hi / 2 - lo / 2)  # halved, so that the widest range stays finite
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int")))


def _locate(counted: DataFrame, wanted: DataFrame, keys: list) -> DataFrame:
    """Entries (keys, at, c) that hold the wanted 0-based ranks (keys, rank), with the rows before them."""
    earlier = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    holds = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
    return ranked.join(F.broadcast(wanted), keys).filter(holds)  # one row per wanted rank


def _first_bucket(value, lo, hi, buckets: int):
    """-1, buckets and buckets + 1 hold minus infinity, infinity and NaN; finite values lie between."""
    return (F.when(F.isnan(value), buckets + 1).when(value == float("inf"), buckets).when(value == float("-inf"), -1)
            .when(hi > lo, _bucket(value, lo, hi, buckets)).otherwise(0))


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _finite_edges(df: DataFrame, variables: list) -> dict:
    """variable -> least and greatest finite value."""
    x = [finite(F.col(f"`{v}`").cast("double")) for v in variables]
    r = df.agg(*[f(c) for c in x for f in (F.min, F.max)]).first()
    return {v: (r[2 * i], r[2 * i + 1]) for i, v in enumerate(variables) if r[2 * i] is not None}


@dataclass(frozen=True)
class _Span:
    """Where a wanted rank lies: first-pass bucket, least and greatest value, rows below and inside."""

    at: int
    low: float
    high: float
    below: int
    inside: int


def _result_schema(by_fields: list) -> T.StructType:
    return T.StructType([
        *by_fields, T.StructField("_all", T.BooleanType()), T.StructField("variable", T.StringType()),
        T.StructField("q", T.ArrayType(T.DoubleType())),
    ])


def narrowed_percentiles(
    df: DataFrame, variables: list, grouping: list, probs: list, states: DataFrame,
    leaf_rows: int = DIRECT_ROWS, buckets: int = BUCKETS,
) -> DataFrame:
    """(grouping..., _all, variable, q) for the groups in ``states`` (grouping, _all, variable, n, min, max).

    ``states`` holds large groups only, so it is small; this is checked.
    """
    spark = df.sparkSession
    by_fields = [df.schema[g] for g in grouping]
    groups = small_rows(states.filter("n > 0"), BROADCAST_ROWS, "groups for exact percentiles")
    if not groups:
        return spark.createDataFrame([], _result_schema(by_fields))
    at_of = {v: i for i, v in enumerate(variables)}
    edges = {}  # one pair of edges per variable, shared by its groups
    for r in groups:
        v = r["variable"]
        lo, hi = edges.get(v, (r["min"], r["max"]))
        edges[v] = (min(lo, r["min"]), max(hi, r["max"]))
    if odd := [v for v, e in edges.items() if not all(map(math.isfinite, e))]:
        found = _finite_edges(df, odd)
        edges |= {v: found.get(v, (0.0, 0.0)) for v in odd}
    group_schema = T.StructType([
        *by_fields, T.StructField("_all", T.BooleanType()), T.StructField("variable", T.IntegerType()),
        T.StructField("id", T.IntegerType()),
    ])
    ids = spark.createDataFrame(
        [(*[r[g] for g in grouping], r["_all"], at_of[r["variable"]], i) for i, r in enumerate(groups)], group_schema
    )

    def identified(rows: DataFrame) -> DataFrame:
        """Rows (grouping, variable, ...) under the id of each large group they belong to."""
        same = (rows["variable"] == ids["variable"]) & (ids["_all"] == rows["_all"])
        for g in grouping:
            same = same & rows[g].eqNullSafe(ids[g])
        others = [rows[c] for c in rows.columns if c not in (*grouping, "variable", "_all")]
        return rows.join(F.broadcast(ids), same).select("id", *others)  # size checked above

    bounds = [edges.get(v, (0.0, 0.0)) for v in variables]
    lo, hi = (F.get(F.array(*[F.lit(float(b[side])) for b in bounds]), F.col("variable")) for side in (0, 1))
    each = F.array(*[F.col(f"`{v}`").cast("double") for v in variables])
    long = df.select(*grouping, F.posexplode(each).alias("variable", "value")).filter(F.col("value").isNotNull())
    long = long.withColumn("at", _first_bucket(F.col("value"), lo, hi, buckets))
    extremes = [F.min("value").alias("min"), F.max("value").alias("max")]
    counts = long.groupBy(*grouping, "variable", "at").agg(F.count(F.lit(1)).alias("c"), *extremes)
    merge = [F.sum("c").alias("c"), F.min("min").alias("min"), F.max("max").alias("max")]
    counts = identified(with_overall(counts, grouping, ["variable", "at"], merge))
    targets = {i: _targets(r["n"], probs) for i, r in enumerate(groups)}
    wanted = [(i, rank) for i, ts in targets.items() for rank in {t for low, high, _ in ts for t in (low, high)}]
    found = _locate(counts, spark.createDataFrame(wanted, "id int, rank long"), ["id"]).collect()
    values, spans = {}, {}
    for r in found:
        if _same(r["min"], r["max"]):
            values[r["id"], r["rank"]] = r["min"]
        else:
            spans[r["id"], r["rank"]] = _Span(r["at"], r["min"], r["max"], r["before"], r["c"])
    kept = sorted({(at_of[groups[i]["variable"]], s.at) for (i, _), s in spans.items()})
    kept = spark.createDataFrame(kept, "variable int, at int")  # a few buckets per large group
    near = identified(expand_levels(long.join(F.broadcast(kept), ["variable", "at"], "left_semi"), grouping))
    while spans:
        parts: dict = {}
        for (i, _), s in spans.items():
            parts.setdefault((i, s.at, s.low, s.high), len(parts))
        table = spark.createDataFrame(
            [(*part, p) for part, p in parts.items()], "id int, at int, low double, high double, part int")
        part_of = {at: parts[at[0], s.at, s.low, s.high] for at, s in spans.items()}
        wanted = spark.createDataFrame(
            sorted({(part_of[at], at[1] - s.below) for at, s in spans.items()}), "part int, rank long")
        rows = near.join(F.broadcast(table), ["id", "at"])  # a few per large group
        rows = rows.filter(F.col("value").between(F.col("low"), F.col("high")))
        if max(s.inside for s in spans.values()) <= leaf_rows:
            counted = rows.groupBy("part", F.col("value").alias("at")).agg(F.count(F.lit(1)).alias("c"))
            counted = counted.withColumn("min", F.col("at")).withColumn("max", F.col("at"))
        else:
            inner = _bucket(F.col("value"), F.col("low"), F.col("high"), buckets)
            counted = rows.groupBy("part", inner.alias("at")).agg(F.count(F.lit(1)).alias("c"), *extremes)
        located = {(r["part"], r["rank"]): r for r in _locate(counted, wanted, ["part"]).collect()}
        for at, s in list(spans.items()):
            r = located[part_of[at], at[1] - s.below]
            if r["min"] == r["max"]:
                values[at] = r["min"]
                del spans[at]
            else:
                spans[at] = _Span(s.at, r["min"], r["max"], s.below + r["before"], r["c"])
    out = []
    for i, r in enumerate(groups):
        q = []
        for low, high, position in targets[i]:
            a, b = values[i, low], values[i, high]
            q.append(a if _same(a, b) or position == low else (low + 1 - position) * a + (position - low) * b)
        out.append((*[r[g] for g in grouping], r["_all"], r["variable"], q))
    return spark.createDataFrame(out, _result_schema(by_fields))


def exact_percentiles(
    df: DataFrame, variables: list, grouping: list, probs: list, states: DataFrame,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Exact percentiles of every group and overall: (grouping..., _all, variable, q).

    ``states`` gives n, min and max of each and must be cheap to read again
    (made from checkpointed rows). The limit holds for all variables of a group
    together, as one task buffers them all.
    """
    by, limit = [*grouping, "_all"], max(direct_rows // len(variables), 1)
    expanded = expand_levels(df, grouping)
    largest = states.agg(F.max("n")).first()[0] or 0
    if largest <= limit:
        return direct_percentiles(expanded, variables, by, probs)
    big = checkpoint(states.filter(F.col("n") > limit).select(*by, "variable", "n", "min", "max"))
    narrowed = narrowed_percentiles(df, variables, grouping, probs, big, limit)
    if states.filter(F.col("n") <= limit).isEmpty():
        return narrowed
    # rows of large groups leave before the built-in aggregate sees them
    flags = big.groupBy(*by).agg(*[
        F.max(F.col("variable") == v).alias(f"_big{i}") for i, v in enumerate(variables)
    ]).withColumnsRenamed({c: f"_k_{c}" for c in by})  # few: narrowed_percentiles has checked
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    rest = expanded.join(F.broadcast(flags), same, "left").select(*by, *[
        F.when(~F.coalesce(F.col(f"_big{i}"), F.lit(False)), F.col(f"`{v}`")).alias(v)
        for i, v in enumerate(variables)
    ])
    rest = rest.filter(reduce(lambda a, b: a | b, [F.col(f"`{v}`").isNotNull() for v in variables]))
    direct = direct_percentiles(rest, variables, by, probs).filter(F.get("q", F.lit(0)).isNotNull())
    return direct.unionByName(narrowed)
