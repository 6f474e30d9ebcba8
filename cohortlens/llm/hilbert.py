"""Approximate nearest neighbours by several shifted Hilbert orderings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored
from cohortlens.llm.vectors import matrix, rotation, usable

CURVES, DIMS, BITS, SHARE = 6, 3, 18, 0.15
EDGES = 256  # quantiles of a projection that span the grid
BLOCK_ROWS = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid cells (rows x dims, below 2**bits); dims * bits <= 62.

    The grid is unfolded level by level: each level swaps or flips the lower bits of
    the axes, a Gray code over the axes gives the order within a level.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            up = (x[:, i] & level) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, -1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def directions(dim: int, curves: int = CURVES, dims: int = DIMS, seed: int = 23) -> np.ndarray:
    """The random directions of all curves, side by side."""
    return np.concatenate([rotation(dim, dims, seed + c) for c in range(curves)], axis=1)


def project(x: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Projections that are finite for all finite vectors."""
    top = np.abs(x).max(axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        y = (x / top) @ along * top
    return np.clip(y, -np.finfo(float).max, np.finfo(float).max)


def by_dim(batch: pa.RecordBatch):
    """The rows of a batch by the length of their vector, the first column."""
    sizes = batch.column(0).value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


def curve_key(y: np.ndarray, edges: np.ndarray, curve: int, bits: int = BITS, seed: int = 23) -> np.ndarray:
    """Key of each vector on one curve from its projections: their quantiles as a grid, moved by an own shift."""
    dims = y.shape[1]
    unit = np.empty(y.shape)
    for i in range(dims):
        at, first = np.unique(edges[i], return_index=True)
        unit[:, i] = np.interp(y[:, i] / 2, at / 2, (first + 0.5) / edges.shape[1])  # halves: differences stay finite
    unit = unit * 0.5 + np.random.default_rng(seed * 1000 + curve).uniform(0, 0.5, dims)
    return hilbert(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def closest(queries: np.ndarray, rows: np.ndarray, row_ids: list[np.ndarray], allowed: np.ndarray, k: int):
    """For each query the k nearest ids among the allowed rows: query index, id, distance; ties go to the smaller id.

    A row is one vector with the sorted ids that hold it; an id of several rows counts at
    the nearest. A fast product finds a bound that the k-th distance cannot exceed, the
    distance itself is the root of the summed squared differences.
    """
    rough = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T
    rough[~allowed] = np.inf
    first, held = np.array([ids[0] for ids in row_ids]), np.array([len(ids) for ids in row_ids])
    single = (held == 1).all() and len(np.unique(first)) == len(first)
    out_q, out_r, out_d = [], [], []
    for q in range(len(queries)):
        fit = np.isfinite(rough[q])
        have = int(fit.sum())
        if not have:
            continue
        take = k
        while True:
            bound = np.partition(rough[q], take - 1)[take - 1] if have > take else np.inf
            slack = 1e-9 * (1 + (queries[q] ** 2).sum() + np.abs(bound if np.isfinite(bound) else 0))
            near = np.flatnonzero(fit & (rough[q] <= bound + slack))
            d = np.sqrt(((rows[near] - queries[q]) ** 2).sum(1))
            best = np.lexsort((first[near], d))[:take]
            near, d = near[best], d[best]
            if single:
                ids = first[near]
                break
            ids, d = np.concatenate([row_ids[i] for i in near.tolist()]), np.repeat(d, held[near])
            order = np.lexsort((ids, d))
            ids, d = ids[order], d[order]
            once = np.sort(np.unique(ids, return_index=True)[1])[:k]
            ids, d = ids[once], d[once]
            if len(ids) == k or have <= take:
                break
            take *= 2  # rows that repeat ids
        out_q.append(np.full(len(ids), q))
        out_r.append(ids)
        out_d.append(d)
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def neighbours(rows: DataFrame, queries, k: int = 10, curves: int = CURVES, share: float = SHARE, dims: int = DIMS,
               bits: int = BITS, block_rows: int = BLOCK_ROWS, vector_column: str = "embedding",
               id_column: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row where ``queries`` holds.

    ``queries`` is a condition on ``vec_id``. Equal vectors are one place with its k + 1
    smallest ids, so copies fill no window and none of the smallest is missed. Every
    distinct vector is placed on each curve; a range sort gives its rank there, and the
    window of a vector that is asked for is ``share`` of all distinct vectors to each
    side. The grid of a curve follows the quantiles of the projections, so it holds about
    as many vectors everywhere whatever the few largest are. A window's blocks of ``block_rows`` ranks meet it one at a time and return their
    k + 1 best ids, which merge into the answer for all its queries; each leaves itself
    out. Distances are Euclidean, in double precision on the original vectors.

    On vectors without structure windows must hold a fixed share of the table for a
    given recall, so work grows with queries times rows; with structure a smaller
    ``share`` will do. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without an id; of rows that repeat an id the
    nearest counts. Vectors compare within their dimension, each with curves, ranks and
    windows of its own. Fewer rows than k: all of them.
    """
    fine = usable(rows, vector_column, id_column)
    spark = rows.sparkSession
    smallest = Window.partitionBy("vec").orderBy("vec_id")  # the limit also cuts before the shuffle
    held = (fine.distinct().withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
            .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = fine.where(queries).select("vec").distinct().withColumn("asked", F.lit(True))
    nodes = stored(held.join(asking, "vec", "left").select(
        "vec", "ids", F.col("asked").isNotNull().alias("asked"), F.monotonically_increasing_id().alias("node")), "vectors")

    def projected(batches):
        along = {}
        for b in batches:
            for dim, part in by_dim(b):
                if dim not in along:
                    along[dim] = directions(dim, curves, dims)
                y = project(matrix(part.column(0)), along[dim])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), dim, np.int32)), pa.array(list(y), pa.list_(pa.float64()))], names=["dim", "y"])

    steps = F.array(*[F.lit(i / (EDGES - 1)) for i in range(EDGES)])
    grid = (nodes.select("vec").mapInArrow(projected, "dim int, y array<double>").groupBy("dim").agg(F.count("*"), *[
        F.percentile_approx(F.col("y")[i], steps, 10_000) for i in range(curves * dims)]).orderBy("dim").collect())
    out_ddl = "query_id long, rank int, vec_id long, score double"
    if not grid:
        return spark.createDataFrame([], out_ddl)
    grid = {row[0]: (nth * curves, row[1], np.array(row[2:])) for nth, row in enumerate(grid)}  # first curve, vectors, edges
    ddl = "curve int, n long, key long, vec array<double>, ids array<long>, asked boolean, node long"
    placed = pa.schema([("curve", pa.int32()), ("n", pa.int64()), ("key", pa.int64()), ("vec", pa.list_(pa.float64())),
                        ("ids", pa.list_(pa.int64())), ("asked", pa.bool_()), ("node", pa.int64())])

    def place(batches):
        along = {}
        for b in batches:
            for dim, part in by_dim(b):
                if dim not in along:
                    along[dim] = directions(dim, curves, dims)
                y = project(matrix(part.column(0)), along[dim])
                first, n, edges = grid[dim]
                for c in range(curves):
                    own = slice(c * dims, (c + 1) * dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(y), first + c, np.int32)), pa.array(np.full(len(y), n)),
                         pa.array(curve_key(y[:, own], edges[own], c, bits)), *part.columns], schema=placed)

    on_curves = nodes.mapInArrow(place, ddl)
    total = sum(n for _, n, _ in grid.values())
    parts = max(curves, math.ceil(curves * total / (4 * block_rows)))
    ordered = on_curves.repartitionByRange(parts, "curve", "key", "node").sortWithinPartitions("curve", "key", "node")

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            curve = b.column(0).to_numpy()
            nth = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                here = curve == c
                start = seen.get(c, 0)
                nth[here] = np.arange(start, start + here.sum())
                seen[c] = start + int(here.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(curve), part, np.int32)), pa.array(nth)],
                names=[*b.schema.names, "part", "nth"])

    numbered = stored(ordered.mapInArrow(number, f"{ddl}, part int, nth long"), "curves")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (numbered.groupBy("curve", "part").agg(F.count("*").alias("here"))
            .select("curve", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base")))
    ranked = (numbered.join(base, ["curve", "part"])
              .select("curve", (F.col("base") + F.col("nth")).alias("place"), "n", "vec", "ids", "asked", "node"))
    ranked = ranked.withColumn("block", F.floor(F.col("place") / block_rows))
    window = F.greatest(F.lit(k), F.ceil(F.lit(share) * F.col("n")))
    asked = ranked.where("asked").select(
        "curve", "place", window.alias("window"), "node", "vec",
        F.explode(F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block_rows),
                             F.floor(F.least(F.col("place") + window, F.col("n") - 1) / block_rows)))).toDF("on", "query_place", "window", "query_node", "query", "at")

    def meet(key, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asked.empty:
            return pd.DataFrame({"node": [], "vec_id": [], "score": []})
        allowed = np.abs(asked["query_place"].to_numpy()[:, None] - block["place"].to_numpy()[None, :])
        allowed = allowed <= asked["window"].to_numpy()[:, None]
        q, ids, d = closest(np.stack(asked["query"].to_numpy()), np.stack(block["vec"].to_numpy()), block["ids"].to_list(),
                            allowed, k + 1)
        return pd.DataFrame({"node": asked["query_node"].to_numpy()[q], "vec_id": ids, "score": d})

    near = (ranked.select("curve", "place", "block", "vec", "ids").groupBy("curve", "block").cogroup(asked.groupBy("on", "at"))
            .applyInPandas(meet, "node long, vec_id long, score double"))
    near = near.groupBy("node", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("node").orderBy("score", "vec_id")
    near = (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
            .groupBy("node").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")))
    near = near.join(nodes.where("asked").select("node", "vec"), "node").select("vec", "found")
    out = (fine.where(queries).select(F.col("vec_id").alias("query_id"), "vec").join(near, "vec")
           .select("query_id", F.inline("found")).where("vec_id <> query_id")
           .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
