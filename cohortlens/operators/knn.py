"""Exact k nearest neighbours without comparing every pair.

The training rows are cut into cells by a small tree of median splits. A query
row first searches its own cell; its k-th distance there bounds the search. The few
nearest cells within the bound come next and tighten it; only then the others that
still lie within it. Crowded
cells are cut into parts on the training side and into salted chunks on the
query side, so no task holds more than a fixed number of rows of either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators.gram import nominal_levels
from cohortlens.operators.knn_pivots import pivot_neighbours
from cohortlens.session import checkpoint

LEAF_ROWS = 4096
MAX_LEAVES = 4096
SAMPLE_ROWS = 50_000
PART_ROWS = 200_000
CHUNK_ROWS = 50_000
AHEAD = 4  # nearest further cells that are searched before the others
PIVOT_DIMS = 8
DISTANCE_CELLS = 100_000  # distances held at a time, so that they stay in the cache


@dataclass
class KnnModel:
    """The training rows as (_key, _y, _x0, _x1, ...) plus how to make them from a table."""

    train: DataFrame
    columns: list
    classification: bool
    levels: dict
    key: str = ""
    k: int = 5
    leaf_rows: int = LEAF_ROWS

    def features(self, df: DataFrame) -> list:
        """Numeric columns as they are, nominal ones as one 0/1 column per category."""
        out = []
        for c in self.columns:
            if c in self.levels:
                out += [(F.col(f"`{c}`").cast("string") == v).cast("double") for v in self.levels[c]]
            else:
                out.append(F.col(f"`{c}`").cast("double"))
        return [x.alias(f"_x{i}") for i, x in enumerate(out)]

    @property
    def dims(self) -> int:
        return sum(len(self.levels.get(c, [None])) for c in self.columns)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Predictions for a table with the same key column as the training table."""
        return knn_predict(self, df, self.key, self.k, output)


def knn_fit(
    df: DataFrame, key: str, target: str, columns: list, k: int = 5, levels: dict | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> KnnModel:
    nominal = [c for c in columns if is_nominal(df, c)]
    levels = levels if levels is not None else nominal_levels(df, nominal)
    classification = is_nominal(df, target)
    model = KnnModel(df, list(columns), classification, levels, key, k, leaf_rows)
    y = F.col(f"`{target}`").cast("string" if classification else "double")
    model.train = complete_rows(df.select(F.col(key).alias("_key"), y.alias("_y"), *model.features(df)))
    return model


@dataclass
class _Cells:
    """Median-split tree: children 2i+1 / 2i+2 of node i, leaves numbered from the left."""

    dim: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.dim[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return (node - (2 ** self.depth - 1)).astype(np.int32)


@dataclass
class _Boxes:
    """Bounding boxes and row counts of the cells."""

    ids: np.ndarray
    sizes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def within(
        self, x: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, first: int = 0, last: int | None = None
    ) -> list:
        """Per point the other cells that may hold one of its k nearest rows, from the ``first``-nearest cell to the ``last``."""
        out, block = [], max(1, DISTANCE_CELLS // len(self.ids))
        for at in range(0, len(x), block):
            q, bound = x[at:at + block], limit[at:at + block].copy()
            near, far = np.zeros((len(q), len(self.ids))), np.zeros((len(q), len(self.ids)))
            for j in range(q.shape[1]):
                below, above = self.lo[None, :, j] - q[:, j, None], q[:, j, None] - self.hi[None, :, j]
                near += np.maximum(np.maximum(below, above), 0.0) ** 2
                far += np.maximum(np.abs(below), np.abs(above)) ** 2
            # own cell holds fewer than k rows: a radius that is sure to hold k
            for i in np.flatnonzero(np.isinf(bound)):
                order = np.argsort(far[i])
                enough = np.searchsorted(np.cumsum(self.sizes[order]), k)
                if enough < len(order):
                    bound[i] = far[i][order[enough]]
            near[self.ids[None, :] == own[at:at + block, None]] = np.inf
            reach = np.isfinite(near) & (near <= bound[:, None])
            if first or last is not None:
                place = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
                reach &= (place >= first) & (place < (len(self.ids) if last is None else last))
            out += [self.ids[r] for r in reach]
        return out


def _build_cells(sample: np.ndarray, leaves: int) -> _Cells:
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    inner = max(2 ** depth - 1, 1)
    dim, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    spread = sample.std(axis=0) if len(sample) else np.ones(1)
    spread[spread == 0] = 1.0
    parts = {0: sample}
    for node in range(2 ** depth - 1):
        x = parts.pop(node)
        if len(x) > 1:
            # the dimension and cut that halve the part best, so that equal values do not pile up
            wide = int(np.argmax((x.max(axis=0) - x.min(axis=0)) / spread))
            dim[node], cut[node] = wide, float(np.median(x[:, wide]))
            if cut[node] == x[:, wide].max():
                below = x[:, wide][x[:, wide] < cut[node]]
                cut[node] = below.max() if len(below) else cut[node]
        right = x[:, dim[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]
    return _Cells(dim, cut, depth)


def _top_k(query: np.ndarray, train: np.ndarray, k: int):
    """(query index, train index, squared distance) of the k nearest, ties by train order."""
    block = max(1, DISTANCE_CELLS // max(len(train), 1))
    for at in range(0, len(query), block):
        q = query[at:at + block]
        d = np.zeros((len(q), len(train)))
        for j in range(q.shape[1]):
            d += (q[:, j, None] - train[None, :, j]) ** 2
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(q), np.inf)
        row, col = np.nonzero(d <= bound[:, None])
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        start = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - start[row] < k
        yield at + row[keep], col[keep], dist[keep]


def _per_cell(counts: dict, size: int) -> dict:
    return {cell: -(-n // size) for cell, n in counts.items() if n > size}


def _pieces(per_cell: dict, cell):
    """Number of pieces of a cell; 1 unless it is in the (leaf-sized) map."""
    if not per_cell:
        return F.lit(1)
    mapping = F.create_map(*[F.lit(int(x)) for kv in per_cell.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, cell), F.lit(1))


def _search(queries: DataFrame, train: DataFrame, parts: dict, dims: int, k: int, qtype, ktype, ytype):
    """queries (_q, _x..., _cell) against train (_key, _y, _x..., _cell, _part) -> (_q, d2, neighbour, y)."""
    xs = [f"_x{i}" for i in range(dims)]
    counts = {r["_cell"]: r["n"] for r in
              queries.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    salts = _per_cell(counts, CHUNK_ROWS)
    q = queries.withColumn("_salt", F.pmod(F.xxhash64("_q"), _pieces(salts, F.col("_cell"))).cast("int"))
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), _pieces(parts, F.col("_cell")) - 1)))
    t = train.withColumn("_salt", F.explode(F.sequence(F.lit(0), _pieces(salts, F.col("_cell")) - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_q": left["_q"].head(0), "d2": [], "neighbour": right["_key"].head(0),
                                 "y": right["_y"].head(0)})
        right = right.sort_values("_key", kind="stable")
        ids, keys, ys = left["_q"].to_numpy(), right["_key"].to_numpy(), right["_y"].to_numpy()
        found = _top_k(left[xs].to_numpy(float), right[xs].to_numpy(float), k)
        return pd.concat([
            pd.DataFrame({"_q": ids[rows], "d2": dist, "neighbour": keys[cols], "y": ys[cols]})
            for rows, cols, dist in found
        ])

    cells = ["_cell", "_salt", "_part"]
    schema = T.StructType([
        T.StructField("_q", qtype), T.StructField("d2", T.DoubleType()),
        T.StructField("neighbour", ktype), T.StructField("y", ytype),
    ])
    return q.groupBy(*cells).cogroup(t.groupBy(*cells)).applyInPandas(search, schema)


def merge_near(parts: DataFrame, k: int, by: str = "_q") -> DataFrame:
    """Top k of partial neighbours (by, d2, neighbour, y): at most k rows per cell, part or dataset."""
    near = F.slice(F.array_sort(F.collect_list(F.struct("d2", "neighbour", "y"))), 1, k)
    return parts.groupBy(by).agg(near.alias("near"))


def neighbours(model: KnnModel, df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, near) with ``near`` the k nearest training rows, nearest first, ties by key.

    From ``PIVOT_DIMS`` columns on by distances to pivots, since boxes then hardly tell cells apart.
    """
    if k < 1:
        raise ValueError("k must be positive")
    dims = model.dims
    if dims >= PIVOT_DIMS:
        found = pivot_neighbours(model.train, df.select(F.col(key).alias("_q"), *model.features(df)), dims, k)
        return found.select(F.col("_q").alias(key), "near")
    xs = [f"_x{i}" for i in range(dims)]
    # of rows at the same point only the k smallest keys can ever be neighbours
    same = Window.partitionBy("_point", *xs).orderBy("_key")  # the hash decides nearly every comparison
    ranked = model.train.withColumn("_point", F.xxhash64(*xs)).withColumn("_rank", F.row_number().over(same))
    train = checkpoint(ranked.filter(F.col("_rank") <= k).drop("_rank", "_point"))
    total = train.count()
    if total == 0:
        raise ValueError("kNN needs training rows")
    sample = train.select(*xs)
    if total > SAMPLE_ROWS:
        sample = sample.sample(SAMPLE_ROWS / total, seed=17).limit(2 * SAMPLE_ROWS)
    cells = _build_cells(  # steers which rows meet first, not the result
        sample.toPandas().to_numpy(float), min(-(-total // model.leaf_rows), MAX_LEAVES)
    )
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(cells)  # at most MAX_LEAVES cuts

    @F.pandas_udf("int")
    def leaf(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf(np.column_stack([c.to_numpy(float) for c in columns])))

    train = train.withColumn("_cell", leaf(*xs))
    boxes = train.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(x).alias(f"{tag}{x}") for x in xs for f, tag in ((F.min, "lo"), (F.max, "hi"))],
    ).collect()  # one row per cell
    parts = _per_cell({b["_cell"]: b["n"] for b in boxes}, PART_ROWS)
    train = train.withColumn("_part", F.pmod(F.xxhash64("_key"), _pieces(parts, F.col("_cell"))).cast("int"))
    ktype, ytype, qtype = train.schema["_key"].dataType, train.schema["_y"].dataType, df.schema[key].dataType

    queries = complete_rows(df.select(F.col(key).alias("_q"), *model.features(df))).withColumn("_cell", leaf(*xs))
    home = _search(queries, train, parts, dims, k, qtype, ktype, ytype)
    if len(boxes) == 1:
        return merge_near(home, k).withColumnRenamed("_q", key)
    home = checkpoint(queries.join(merge_near(home, k), "_q", "left"))
    bounds = sc.broadcast(_Boxes(  # one row per cell
        np.array([b["_cell"] for b in boxes]), np.array([b["n"] for b in boxes]),
        np.array([[b[f"lo{x}"] for x in xs] for b in boxes], dtype=float),
        np.array([[b[f"hi{x}"] for x in xs] for b in boxes], dtype=float),
    ))

    def further(found: DataFrame, first: int, last: int | None) -> DataFrame:
        """The neighbours so far and those of the next cells within reach, best k of both."""
        @F.pandas_udf("array<int>")
        def other_cells(own: pd.Series, limit: pd.Series, *columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            return pd.Series(bounds.value.within(x, own.to_numpy(), limit.to_numpy(float), k, first, last))

        other_cells = other_cells.asNondeterministic()  # else the optimizer runs it again to drop empty lists
        limit = F.when(F.size("near") >= k, F.element_at("near", k)["d2"]).otherwise(F.lit(float("inf")))
        next_ = (
            found.withColumn("_cells", other_cells("_cell", F.coalesce(limit, F.lit(float("inf"))), *xs))
            .select("_q", *xs, F.explode("_cells").alias("_cell"))
        )
        more = _search(next_, train, parts, dims, k, qtype, ktype, ytype)
        return merge_near(found.select("_q", F.inline("near")).unionByName(more), k)

    if len(boxes) <= AHEAD + 1:
        return further(home, 0, None).withColumnRenamed("_q", key)
    home = checkpoint(queries.join(further(home, 0, AHEAD), "_q", "left"))
    return further(home, AHEAD, None).withColumnRenamed("_q", key)


def vote(near, classification: bool):
    """Mean of the neighbours' values, or their most frequent class (ties: the smallest)."""
    ys = F.transform(near, lambda n: n["y"])
    if not classification:
        return F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)
    ranked = F.transform(
        F.array_distinct(ys),
        lambda c: F.struct((-F.size(F.filter(ys, lambda y: y == c))).alias("votes"), c.alias("label")),
    )
    return F.array_min(ranked)["label"]


def knn_predict(model: KnnModel, df: DataFrame, key: str, k: int = 5, output: str = "prediction") -> DataFrame:
    """Rows are told apart by ``key``; a key that repeats is an error, a row without one has no prediction."""
    if not df.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        raise ValueError(f"values of {key} repeat: neighbours of different rows would mix")
    near = neighbours(model, df, key, k)
    found = near.select(F.col(key), vote(F.col("near"), model.classification).alias(output))
    return df.join(found, key, "left")
