"""Exact k nearest neighbours in many columns, by distances to pivots.

Every training row lies in the cell of its nearest pivot and knows its distance to it. By the triangle inequality
the distances of a query row to the pivots bound its distance to every cell and, inside a cell, to every
row: only rows whose own pivot distance differs by no more than the k-th distance so far are compared, column
block by column block until they are too far. Bounding boxes, which ``knn`` uses, say little in many
columns; distances go on to tell clusters apart.

A group column (the dataset) is part of a cell's name, so the neighbours in each of many datasets are found
in one run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.names import complete_rows
from cohortlens.session import BROADCAST_ROWS, checkpoint, small_rows

SAMPLE_ROWS = 50_000
MAX_GROUPS = 1000
PART_ROWS = 200_000
CHUNK_ROWS = 50_000
AHEAD = 4  # nearest further cells that are searched before the others
HELD = 2_000_000  # distances held at a time
FIRST_COLUMNS = 8  # columns summed before rows beyond the bound are dropped
SLACK = 1e-9  # relative; bounds are rounded, results are not


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column so that they equal those of any other plan."""
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - y[None, :, j]) ** 2
    return d


@dataclass
class Pivots:
    """Pivot points, and per cell (group and pivot) its rows and their least and greatest distance to the pivot."""

    points: np.ndarray
    cells: np.ndarray | None = None
    sizes: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None

    def blocks(self, x: np.ndarray):
        """(first row, distances to all pivots) of a block of rows at a time."""
        step = max(1, HELD // max(len(self.points), 1))
        for at in range(0, len(x), step):
            yield at, np.sqrt(_squares(x[at:at + step], self.points))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, d in self.blocks(x):
            at[i:i + len(d)] = d.argmin(axis=1)
            away[i:i + len(d)] = d.min(axis=1)
        return at, away

    def home(self, x: np.ndarray, groups: int) -> list:
        """Per row the cell of the nearest pivot in each group, of those that hold rows."""
        m, out = len(self.points), []
        for _, d in self.blocks(x):
            found = []
            for g in range(groups):
                mine = self.cells[self.cells // m == g]
                if len(mine):
                    found.append(mine[d[:, mine % m].argmin(axis=1)])
            out += np.stack(found, axis=1).tolist() if found else [[]] * len(d)
        return out

    def within(self, x: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, first: int, last: int | None) -> list:
        """Per row (one group each) the other cells of its group that may hold one of its k nearest rows, nearest first."""
        m, out = len(self.points), []
        apart = None
        for at, d in self.blocks(x):
            near = d.argmin(axis=1)
            for i in range(len(d)):
                g = own[at + i] // m
                lo, hi = np.searchsorted(self.cells, [g * m, (g + 1) * m])
                cells, pivot = self.cells[lo:hi], self.cells[lo:hi] % m
                away, bound = d[i, pivot], limit[at + i]
                if math.isinf(bound):  # fewer than k rows so far: a radius that is sure to hold k
                    far = away + self.most[lo:hi]
                    order = np.argsort(far)
                    enough = np.searchsorted(np.cumsum(self.sizes[lo:hi][order]), k)
                    bound = far[order[enough]] if enough < len(order) else math.inf
                least = np.maximum(away - self.most[lo:hi], self.least[lo:hi] - away)
                # rows of a cell are no nearer to the row's own pivot than to theirs
                apart = np.sqrt(((self.points[pivot] - self.points[near[i]]) ** 2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (away**2 - d[i, near[i]] ** 2) / (2 * apart)
                least = np.maximum(least, np.where(apart > 0, plane, 0.0))
                least[cells == own[at + i]] = math.inf
                reach = np.flatnonzero(least * (1 - SLACK) <= bound + SLACK * (1 + abs(bound)) if not math.isinf(bound) else np.isfinite(least))
                out.append(cells[reach[np.argsort(least[reach], kind="stable")]][first:last].tolist())
        return out


def _columns(table: pa.Table, names: list) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in names]).reshape(len(table), len(names))


def _and_nulls(column: pa.ChunkedArray, at: np.ndarray, n: int) -> pa.ChunkedArray:
    """The values at some places, then n nulls."""
    return pa.chunked_array([*column.take(pa.array(at, pa.int64())).chunks, pa.nulls(n, column.type)], column.type)


def _top(query: np.ndarray, bound: float, train: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the k nearest within the squared bound, ties by rank."""
    place = np.arange(len(train))
    d = np.zeros(len(train))
    for j in range(query.shape[0]):
        d += (train[:, j] - query[j]) ** 2
        if j + 1 == FIRST_COLUMNS and query.shape[0] > FIRST_COLUMNS:
            keep = d <= bound
            place, d, train = place[keep], d[keep], train[keep]
    keep = np.flatnonzero(d <= bound)
    if len(keep) > k:
        keep = keep[d[keep] <= np.partition(d[keep], k - 1)[k - 1]]
    keep = keep[np.lexsort((rank[place[keep]], d[keep]))][:k]
    return place[keep], d[keep]


def pivot_neighbours(
    train: DataFrame, queries: DataFrame, dims: int, k: int = 5, groups: list | None = None, pivots: int | None = None, seed: int = 17,
) -> DataFrame:
    """(_q, [_by,] near, compared): per query row, and group, its k nearest training rows, nearest first, ties by key.

    ``train`` has ``_key, _y, _x0..`` and, with ``groups``, ``_by``; ``queries`` has ``_q, _x0..``. ``compared`` counts
    the rows a query row's distance was computed to. The number of pivots is the square root of the rows, so
    neither cells nor the list of pivots grow with the table as such.
    """
    if k < 1:
        raise ValueError("k must be positive")
    xs = [f"_x{i}" for i in range(dims)]
    groups = [None] if groups is None else list(groups)
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups in one run")
    by = F.lit(0)
    if groups != [None]:
        train = train.filter(F.col("_by").isin(groups))
        by = (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("_by")) - 1).cast("int")
    # of rows at one place only the k smallest keys can ever be neighbours
    same = Window.partitionBy("_group", "_point", *xs).orderBy("_key")
    train = train.select("_key", "_y", *xs, by.alias("_group"), F.xxhash64(*xs).alias("_point")).withColumn("_rank", F.row_number().over(same))
    train = checkpoint(train.filter(F.col("_rank") <= k).drop("_rank", "_point"))
    total = train.count()
    if not total:
        raise ValueError("kNN needs training rows")
    sample = train.select(*xs)
    if total > SAMPLE_ROWS:
        sample = sample.sample(SAMPLE_ROWS / total, seed=seed).limit(2 * SAMPLE_ROWS)
    points = np.unique(sample.toPandas().to_numpy(float), axis=0)  # steers which rows meet, not the result
    wanted = min(pivots or math.isqrt(total) + 1, max(BROADCAST_ROWS // len(groups), 1), len(points))
    points = points[np.random.default_rng(seed).choice(len(points), wanted, replace=False)]
    sc, m = train.sparkSession.sparkContext, wanted
    shared = sc.broadcast(Pivots(points))  # at most BROADCAST_ROWS points

    @F.pandas_udf("struct<cell:long,away:double>")
    def place(*columns: pd.Series) -> pd.DataFrame:
        at, away = shared.value.nearest(np.column_stack([c.to_numpy(float) for c in columns]))
        return pd.DataFrame({"cell": at, "away": away})

    placed = train.withColumn("_at", place(*xs))
    placed = checkpoint(placed.select("_key", "_y", *xs, (F.col("_group") * m + F.col("_at.cell")).alias("_cell"), F.col("_at.away").alias("_away")))
    stats = small_rows(placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_away").alias("lo"), F.max("_away").alias("hi"))
                       .orderBy("_cell"), BROADCAST_ROWS, "cells of groups and pivots")
    index = sc.broadcast(Pivots(points, *[np.array([s[c] for s in stats]) for c in ("_cell", "n", "lo", "hi")]))
    parts = {s["_cell"]: -(-s["n"] // PART_ROWS) for s in stats if s["n"] > PART_ROWS}

    @F.pandas_udf("array<long>")
    def home(*columns: pd.Series) -> pd.Series:
        return pd.Series(index.value.home(np.column_stack([c.to_numpy(float) for c in columns]), len(groups)))

    home = home.asNondeterministic()
    fields = {f.name: f.dataType for f in (*placed.schema, *queries.schema)}
    schema = T.StructType([
        T.StructField("_q", fields["_q"]), T.StructField("_home", T.LongType()), T.StructField("d2", T.DoubleType()),
        T.StructField("neighbour", fields["_key"]), T.StructField("y", fields["_y"]), T.StructField("compared", T.LongType())])

    def search(asked: DataFrame) -> DataFrame:
        """asked (_q, _home, _limit, _x.., _cell) -> its nearest rows of that cell, and one row without a neighbour that counts."""
        counts = {r["_cell"]: r["n"] for r in asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
        salts = {c: -(-n // CHUNK_ROWS) for c, n in counts.items() if n > CHUNK_ROWS}
        q = asked.withColumn("_salt", F.pmod(F.xxhash64("_q"), _pieces(salts)).cast("int")).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), _pieces(parts) - 1)))
        t = placed.withColumn("_part", F.pmod(F.xxhash64("_key"), _pieces(parts)).cast("int")).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), _pieces(salts) - 1)))

        def of_cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
            """The nearest rows of a cell; each query row's count of compared rows is a row without a neighbour."""
            right = right.sort_by("_away")
            rank = np.empty(len(right), np.int64)
            rank[pc.array_sort_indices(right.column("_key")).to_numpy()] = np.arange(len(right))
            x, away = _columns(right, xs), right.column("_away").to_numpy()
            asked, limits = _columns(left, xs), left.column("_limit").to_numpy()
            centre = np.sqrt(_squares(asked, points[key[0].as_py() % m][None, :]))[:, 0]
            reach = np.sqrt(limits) * (1 + SLACK) + SLACK * (1 + centre)
            first, last = np.searchsorted(away, centre - reach), np.searchsorted(away, centre + reach, "right")
            places, distances = [], []
            for i, (s, e) in enumerate(zip(first.tolist(), last.tolist())):
                at, d2 = _top(asked[i], limits[i], x[s:e], rank[s:e], k)
                places.append(at + s)
                distances.append(d2)
            who = np.repeat(np.arange(len(left)), [len(p) for p in places])
            at = np.concatenate([*places, np.zeros(0, np.int64)])
            n = len(left)
            columns = {
                "_q": left.column("_q").take(pa.array(np.r_[who, np.arange(n)])),
                "_home": left.column("_home").take(pa.array(np.r_[who, np.arange(n)])),
                "d2": pa.concat_arrays([pa.array(np.concatenate([*distances, np.zeros(0)])), pa.nulls(n, pa.float64())]),
                "neighbour": _and_nulls(right.column("_key"), at, n), "y": _and_nulls(right.column("_y"), at, n),
                "compared": pa.array(np.r_[np.zeros(len(who), np.int64), last - first]),
            }
            return pa.table([columns[c] for c in schema.names], names=schema.names)

        cells = ["_cell", "_salt", "_part"]
        return q.groupBy(*cells).cogroup(t.groupBy(*cells)).applyInArrow(of_cell, schema)

    def best(found: DataFrame) -> DataFrame:
        near = F.collect_list(F.when(F.col("d2").isNotNull(), F.struct("d2", "neighbour", "y")))
        return found.groupBy("_q", "_home").agg(F.slice(F.array_sort(near), 1, k).alias("near"), F.sum("compared").alias("compared"))

    queries = complete_rows(queries.select("_q", *xs))
    asked = queries.withColumn("_home", F.explode(home(*xs)))
    asked = checkpoint(asked)
    found = best(search(asked.withColumn("_cell", F.col("_home")).withColumn("_limit", F.lit(math.inf))))
    for first, last in ((0, AHEAD), (AHEAD, None)):
        found = checkpoint(found)

        @F.pandas_udf("array<long>")
        def others(own: pd.Series, limit: pd.Series, *columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            return pd.Series(index.value.within(x, own.to_numpy(), np.sqrt(limit.to_numpy(float)), k, first, last))

        others = others.asNondeterministic()
        limit = F.coalesce(F.when(F.size("near") >= k, F.element_at("near", k)["d2"]), F.lit(math.inf))
        next_ = asked.join(found, ["_q", "_home"]).withColumn("_limit", limit)
        next_ = next_.withColumn("_cell", F.explode(others("_home", "_limit", *xs))).select("_q", "_home", "_limit", *xs, "_cell")
        nobody = F.lit(None)
        so_far = found.select("_q", "_home", F.inline("near"), F.lit(0).cast("long").alias("compared")).unionByName(
            found.select("_q", "_home", nobody.cast("double").alias("d2"), nobody.cast(fields["_key"]).alias("neighbour"),
                         nobody.cast(fields["_y"]).alias("y"), "compared"))
        found = best(so_far.unionByName(search(checkpoint(next_))))
    group = F.get(F.array(*[F.lit(g) for g in groups]), (F.col("_home") / m).cast("int")).alias("_by")
    return found.select("_q", *([] if groups == [None] else [group]), "near", "compared")


def _pieces(per_cell: dict):
    """Number of pieces that the cell of a row is cut into; 1 unless it is among the (few) crowded ones."""
    if not per_cell:
        return F.lit(1)
    mapping = F.create_map(*[F.lit(int(x)) for kv in per_cell.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.col("_cell").cast("int")), F.lit(1))
