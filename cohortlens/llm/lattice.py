"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, several tables."""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored
from cohortlens.llm.components import components
from cohortlens.llm.vectors import matrix, rotation, usable

TABLES, BLOCKS, PROBES, SCALE = 4, 2, 2, 2.5
_ROWS = 2048  # rows of one side of a comparison held at a time
HOT_CELLS = 100_000  # crowded cells whose list is small enough to go to every task
PART_ROWS = 8192  # vectors of a cell that one task compares with each other


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest E8 vectors: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the worst entry the other way."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(e[odd]).argmax(axis=1)
    r[odd, worst] += np.where(e[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is the even-sum integers and the same moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of lattice points, whose doubled entries are whole numbers."""
    h = np.full(len(points), 0x9E3779B97F4A7C15 * (table + 1) % (1 << 64), np.uint64)
    for column in (points * 2).astype(np.int64).view(np.uint64).T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE,
          seed: int = 11) -> np.ndarray:
    """Keys, rows x tables x (1 + probes): the own cell first, then the neighbouring cells nearest to the point."""
    n, dim = x.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    steps = neighbours()
    shift = np.random.default_rng(seed).uniform(0, 1, (tables, 8 * blocks))
    for t in range(tables):
        y = x @ rotation(dim, 8 * blocks, seed + 1 + t) * (scale * (dim / 64) ** 0.5) + shift[t]
        parts = y.reshape(n, blocks, 8)
        own = np.stack([nearest(parts[:, b]) for b in range(blocks)], axis=1)
        out[:, t, 0] = _key(own.reshape(n, -1), t)
        away = np.concatenate([2 - 2 * ((parts[:, b] - own[:, b]) @ steps.T) for b in range(blocks)], axis=1)
        order = np.argpartition(away, min(probes, away.shape[1] - 1), axis=1)[:, :probes]
        for p in range(probes):
            moved = own.copy()
            moved[np.arange(n), order[:, p] // 240] += steps[order[:, p] % 240]
            out[:, t, 1 + p] = _key(moved.reshape(n, -1), t)
    return out


def _pair_bucket(a_cells, a_id, b_cells, b_id) -> np.ndarray:
    """The key of the one bucket that judges each pair.

    Two vectors meet in a table where the own cell of one is among the cells of the
    other. The lowest such table decides; there it is the own cell of the vector with
    the smaller id if that meets, else the own cell of the other.
    """
    key, open_ = np.zeros(len(a_id), np.int64), np.ones(len(a_id), bool)
    first = a_id < b_id
    for t in range(a_cells.shape[1]):
        own_a, own_b = a_cells[:, t, 0], b_cells[:, t, 0]
        in_b = (own_a[:, None] == b_cells[:, t]).any(axis=1)
        in_a = (own_b[:, None] == a_cells[:, t]).any(axis=1)
        new = open_ & (in_a | in_b)
        key[new] = np.where(np.where(first, in_b, ~in_a), own_a, own_b)[new]
        open_ &= ~new
    return key


def near_duplicates(rows: DataFrame, cosine: float = 0.95, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES,
                    scale: float = SCALE, vector_column: str = "embedding", id_column: str = "vec_id",
                    seed: int = 11, part_rows: int = PART_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row with an id.

    Vectors are scaled to length 1. Each table projects them to ``blocks`` times eight
    random directions and files them under the E8 cell of each block, and under the
    ``probes`` neighbouring cells that are nearest. Vectors that meet in a cell, one of
    them by its own, are compared in double precision. A pair that meets several times is
    counted in one bucket that both can name, so counts are exact without listing pairs:
    a bucket sends one count per vector and a spanning tree of its links. A cell of more than ``part_rows``
    vectors, such as a tight cluster, is cut into parts, and every two parts meet in a task of their own.

    Equal vectors are one node with a number of copies. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and are their own
    component. Vectors of different dimension never meet. Rows that repeat an id are one
    vector each, and the id gets the sum of links other than to itself; rows without an
    id are left out.
    """
    every = rows.select(F.col(id_column).cast("long").alias("vec_id")).where("vec_id is not null")
    fine = usable(rows, vector_column, id_column)
    nodes = stored(fine.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("own", pa.bool_()), ("copies", pa.int64()),
                        ("unit", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])
    ddl = "key long, node long, own boolean, copies long, unit array<double>, cells array<long>"

    def keys_of(batches):
        """(batch of one dimension, its unit vectors, its cells) for every batch."""
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                x = matrix(part.column(0))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                yield part, x, cells(x, tables, blocks, probes, scale, seed) ^ np.int64(int(dim) * 0x5851F42D4C957F2D % (1 << 62))

    def file(batches):
        for part, x, k in keys_of(batches):
            flat = pa.array(k.reshape(len(k), -1).tolist(), pa.list_(pa.int64()))
            unit = pa.array(list(x), pa.list_(pa.float64()))
            for t in range(tables):
                for p in range(1 + probes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[:, t, p]), part.column(1), pa.array(np.full(len(k), p == 0)), part.column(2),
                         unit, flat], schema=schema)

    def count(batches):
        for _, _, k in keys_of(batches):
            key, n = np.unique(k, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["hot", "n"])

    source = nodes.select("vec", "node", "copies")
    crowded = source.mapInArrow(count, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n")).where(F.col("n") > part_rows)
    crowded = stored(crowded.select("hot", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "crowded")
    few = crowded.limit(HOT_CELLS + 1).count()
    filed, parts = source.mapInArrow(file, ddl), F.lit(1)
    if few:
        side = F.broadcast(crowded) if few <= HOT_CELLS else crowded  # size checked
        filed, parts = filed.join(side, F.col("key") == F.col("hot"), "left"), F.coalesce("parts", F.lit(1))
    filed = filed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    filed = filed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    filed = filed.select(*schema.names, "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    filed = filed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            keys, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            end = np.r_[begin[1:], len(keys)]
            if b is not None:  # the last run may go on
                begin, end, rest = begin[:-1], end[:-1], held.slice(int(begin[-1]))
            else:
                rest = None
            out = ([], [], [])
            for s, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
                run = held.slice(s, e - s)
                own = run.column("own").to_numpy()
                if not own.any():
                    continue
                ids, copies = run.column("node").to_numpy(), run.column("copies").to_numpy()
                vecs = matrix(run.column("unit").combine_chunks())
                grid = matrix(run.column("cells").combine_chunks()).reshape(e - s, tables, 1 + probes)
                part = run.column("part").to_numpy() if i[s] != j[s] else None
                for a, other, n in _bucket_links(int(keys[s]), ids, own, copies, vecs, grid, cosine, part):
                    out[0].append(a)
                    out[1].append(other)
                    out[2].append(n)
            held = rest
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=found)

    links = stored(filed.mapInArrow(compare, "a long, b long, n long"), "links")
    roots = components(links.where("n = 0").select("a", "b")).withColumnRenamed("id", "node")
    counts = links.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    judged = (nodes.select("vec", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
              .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
                      F.coalesce("root", "node").alias("root")))
    by_id = (fine.join(judged, "vec").groupBy("vec_id")
             .agg(F.sum("n").alias("n"), F.min("root").alias("root"), F.count("*").alias("own")))
    out = every.distinct().join(by_id, "vec_id", "left")
    out = out.select("vec_id", F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _bucket_links(key, ids, own, copies, vecs, grid, cosine, part=None):
    """Rows ``a, b, n`` of one bucket: counts (b = a, n > 0) and edges of a spanning forest (n = 0).

    Where two parts of a cell meet, only pairs across them count; pairs within a part have a task of their own.
    """
    n = len(ids)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    edge_a, edge_b = [], []

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for s in range(0, n, _ROWS):
        for e in range(s, n, _ROWS):
            a, b = slice(s, s + _ROWS), slice(e, e + _ROWS)
            near = vecs[a] @ vecs[b].T >= cosine - 1e-12
            near &= (own[a][:, None] | own[b][None, :]) & (ids[a][:, None] != ids[b][None, :])
            if part is not None:
                near &= part[a][:, None] != part[b][None, :]
            if s == e:
                near &= np.tri(*near.shape, k=-1, dtype=bool).T
            i, j = np.nonzero(near)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at:at + (1 << 16)] + s, j[at:at + (1 << 16)] + e
                # one rounding for both ways round a pair and for every bucket
                fine = (np.einsum("ij,ij->i", vecs[x], vecs[y]) >= cosine) & (_pair_bucket(grid[x], ids[x], grid[y], ids[y]) == key)
                x, y = x[fine], y[fine]
                np.add.at(counts, x, copies[y])
                np.add.at(counts, y, copies[x])
                for u, v in zip(x.tolist(), y.tolist()):
                    u, v = top(u), top(v)
                    if u != v:
                        label[max(u, v)] = min(u, v)
                        edge_a.append(ids[u])
                        edge_b.append(ids[v])
    some = counts > 0
    if some.any():
        yield ids[some], ids[some], counts[some]
    if edge_a:
        yield np.array(edge_a), np.array(edge_b), np.zeros(len(edge_a), np.int64)
