"""Running statistics of a stream in Spark's keyed state store.

Per group and variable the store holds moments, a grid of bins and nothing else, so neither
memory nor what a reader sees grows with the number of micro-batches. The bins lie on a grid of width 2**e, the
smallest on which the values seen span at most ``GRID_BINS`` bins; when the range outgrows it, neighbouring bins
are added up and the width doubles. The grid follows from the least and greatest value alone,
so the result does not depend on how the rows came in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cohortlens.operators.moments import moment_columns

GRID_BINS = 64
FINEST = -20  # widths go down to 2**-20
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"

STATE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("nulls", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("m2", T.DoubleType()), T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("width", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("bins", T.ArrayType(T.LongType())),
])
EMPTY = (0, 0, None, 0.0, None, None, FINEST, 0, [])


def grid_place(x: np.ndarray, width: int) -> np.ndarray:
    """Number of the bin of width 2**width that holds each value."""
    scaled = np.ldexp(x, -width)
    return np.where((scaled == 0) & (x < 0), -1, np.floor(scaled)).astype(np.int64)  # next to 0 from below may round to 0


def grid_width(low: float, high: float, width: int = FINEST) -> int:
    """Exponent of the smallest grid, from ``width`` on, that holds both values in ``GRID_BINS`` bins."""
    width = max(width, math.frexp(max(abs(low), abs(high)))[1] - 52)  # places stay whole numbers of 53 bits
    if high > low:
        width = max(width, math.frexp(high - low)[1] - GRID_BINS.bit_length() - 1)
    while np.subtract(*grid_place(np.array([high, low]), width)) >= GRID_BINS:
        width += 1
    return width


def _widened(width: int, first: int, bins: list, to: int) -> tuple[int, list]:
    """The bins on the grid of width 2**to."""
    if not len(bins) or to == width:
        return first, list(bins)
    at = (first + np.arange(len(bins))) >> (to - width)
    return int(at[0]), np.bincount(at - at[0], weights=bins).astype(np.int64).tolist()


def state_of(values: np.ndarray) -> tuple:
    """State of some values; None is a null, NaN a value that no bin holds."""
    known = np.array([x for x in values if x is not None], float)
    if not len(known):
        return (0, len(values), *EMPTY[2:])
    mean = float(known.mean())
    finite = known[np.isfinite(known)]
    width, first, bins = FINEST, 0, []
    if len(finite):
        width = grid_width(float(finite.min()), float(finite.max()))
        at = grid_place(finite, width)
        first, bins = int(at.min()), np.bincount(at - at.min()).tolist()
    return (len(known), len(values) - len(known), mean, float(((known - mean) ** 2).sum()), float(known.min()), float(known.max()),
            width, first, bins)


def add_states(a: tuple, b: tuple) -> tuple:
    """State of the rows of both, whatever came first."""
    if not a[0] or not b[0]:
        some = a if a[0] else b
        return (some[0], a[1] + b[1], *some[2:])
    n, apart = a[0] + b[0], b[2] - a[2]
    low, high = min(a[4], b[4]), max(a[5], b[5])
    width, first, bins = FINEST, 0, []
    sides = [s for s in (a, b) if len(s[8])]
    if sides:
        width = max(s[6] for s in sides)
        while True:
            grids = [_widened(*s[6:], width) for s in sides]
            first = min(f for f, _ in grids)
            if max(f + len(g) for f, g in grids) - first <= GRID_BINS:
                break
            width += 1
        total = np.zeros(max(f + len(g) for f, g in grids) - first, np.int64)
        for f, g in grids:
            total[f - first:f - first + len(g)] += np.asarray(g, np.int64)
        bins = total.tolist()
    return (n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + apart * apart * (a[0] * b[0] / n), low, high, width, first, bins)


class _Running(StatefulProcessor):
    """Adds the batch's partial states of a key to what the store holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("statistics", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = tuple(self.kept.get()) if self.kept.exists() else EMPTY
        for part in rows:
            for row in part[STATE.names].itertuples(index=False, name=None):
                total = add_states(total, _plain(row))
        self.kept.update(total)
        yield pd.DataFrame({"n": [total[0]]})

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """A state as pandas hands it over, in Python's own types."""
    n, nulls, mean, m2, low, high, width, first, bins = row
    return (int(n), int(nulls), *((float(mean), float(m2), float(low), float(high)) if n else (None, 0.0, None, None)),
            int(width), int(first), [int(x) for x in bins] if bins is not None else [])


def running_statistics(
    stream: DataFrame, checkpoint_location: str, variables: list, by=(), once: bool = True, stores: int | None = None,
) -> StreamingQuery:
    """Keep the statistics of numeric ``variables`` per group up to date from a stream.

    Each task first sums up its part of a micro-batch, one row per group and variable, so a group that
    holds a third of all rows is one row per task. The store commits with the batch: after a restart from the same
    ``checkpoint_location`` no row is missed or counted twice. ``read_statistics`` reads the store.

    Every micro-batch opens and commits each part of the store, with rows or without, so there are ``stores`` parts:
    as many as the cluster has cores, at most the session's shuffle partitions. Their number stays with the checkpoint.
    """
    by, spark = list(by), stream.sparkSession
    keys = T.StructType([stream.schema[c] for c in by] + [T.StructField("variable", T.StringType())])
    schema = T.StructType([*keys.fields, *STATE.fields])
    if clash := sorted(set(by) & {"variable", *STATE.names}):
        raise ValueError(f"rename the grouping columns {', '.join(clash)}: states use these names themselves")

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            columns = [np.where(pdf[f"{v}?"], None, pdf[v]) for v in variables]
            places = pdf.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(pdf))}
            for key, at in places.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                for v, values in zip(variables, columns):
                    sums[key, v] = add_states(sums.get((key, v), EMPTY), state_of(values[at]))
        if sums:
            yield pd.DataFrame([(*key, v, *state) for (key, v), state in sums.items()], columns=schema.names)

    # pandas does not tell null from NaN, so a flag goes along
    each = stream.select(*by, *[c for v in variables for c in (
        F.col(f"`{v}`").cast("double").alias(v), F.col(f"`{v}`").isNull().alias(f"{v}?"))])
    running = each.mapInPandas(partial, schema).groupBy(*keys.names).transformWithStateInPandas(
        statefulProcessor=_Running(), outputStructType=T.StructType([T.StructField("n", T.LongType())]),
        outputMode="Update", timeMode="None")
    parts = stores or min(spark.sparkContext.defaultParallelism, int(spark.conf.get(_PARTITIONS)))
    settings = {_SETTING: STORE, _PARTITIONS: str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)  # the query keeps the settings it starts with
    try:
        writer = running.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint_location)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_states(spark: SparkSession, checkpoint_location: str, by=()) -> DataFrame:
    """(by..., variable, state) as the last finished micro-batch left them."""
    kept = spark.read.format("statestore").option("stateVarName", "statistics").load(checkpoint_location)
    return kept.select(*[F.col(f"key.{c}").alias(c) for c in (*by, "variable")], "value.*")


def read_statistics(spark: SparkSession, checkpoint_location: str, by=()) -> DataFrame:
    """(by..., variable, count, null_count, mean, std, EX^2, min, max) over all that the stream has delivered."""
    m = moment_columns()
    return read_states(spark, checkpoint_location, by).select(
        *by, "variable", F.col("n").alias("count"), F.col("nulls").alias("null_count"),
        m["mean"].alias("mean"), m["std"].alias("std"), m["EX^2"].alias("EX^2"), "min", "max")


def read_bins(spark: SparkSession, checkpoint_location: str, by=()) -> DataFrame:
    """(by..., variable, low, high, count): the bins from the first to the last with a value; low <= value < high."""
    size = F.pow(F.lit(2.0), F.col("width"))
    found = read_states(spark, checkpoint_location, by).select(*by, "variable", "width", "first", F.posexplode("bins").alias("at", "count"))
    place = F.col("first") + F.col("at")
    return found.select(*by, "variable", (place * size).alias("low"), ((place + 1) * size).alias("high"), "count")
