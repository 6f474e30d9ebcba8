"""Gradient boosting on histograms, all classes of a round in one pass per level.

Inputs are cut into at most ``BINS`` bins, and rows with equal bins and equal target counts are one weighted
profile: residuals only depend on the profile, so nothing is lost. A level of all trees of a round takes one pass
over the profiles, which adds up residual sums per tree, node, input and bin; the best cut of every node
follows from these on the driver. Profiles lie in blocks with the scores so far, so that a pass walks
only the trees since these were last written.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G
from cohortlens.session import checkpoint, small_rows

BINS = 64
BLOCK_ROWS = 1 << 16
LOCAL_CELLS = 4_000_000  # profiles times inputs up to which one process adds up the blocks
MAX_CELLS = 20_000_000  # histogram cells of a level
SCORE_EVERY = 10  # rounds after which the blocks' scores are written anew
MAX_CLASSES = 200


@dataclass
class Tree:
    """Nodes of a complete binary tree; 2i+1 and 2i+2 are the children of i, an input of -1 makes a leaf."""

    inputs: np.ndarray
    cuts: np.ndarray  # rows whose bin is at most this go left
    values: np.ndarray

    def leaf(self, bins: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            at = self.inputs[node]
            right = bins[np.arange(len(bins)), np.maximum(at, 0)] > self.cuts[node]
            node = np.where(at < 0, node, 2 * node + 1 + right)
        return node

    def score(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.values[self.leaf(bins, depth)]


@dataclass
class HistModel:
    """Boosted trees: per round one tree, or one per class where there are more than two."""

    terms: list
    edges: list
    classes: list
    start: np.ndarray
    rate: float
    depth: int
    rounds: list = field(default_factory=list)

    def scores(self, bins: np.ndarray, first: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.score(bins, self.depth)
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)]).astype(np.uint8)

    def score_frame(self, df: DataFrame, output: str = "scores") -> DataFrame:
        """The trees' scores as an array: the value, the log odds of the second class, or one per class."""
        model = df.sparkSession.sparkContext.broadcast(HistModel([], self.edges, [], self.start, self.rate, self.depth, self.rounds))

        @F.pandas_udf("array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            known = ~np.isnan(x).any(axis=1)
            out = pd.Series([None] * len(x), dtype=object)
            if known.any():
                found = model.value.scores(model.value.binned(x[known]))
                out[known] = pd.Series(list(found), index=np.flatnonzero(known))
            return out

        return df.withColumn(output, score(*[t.column for t in self.terms]))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """All rows come back; one with a null or NaN input has a null prediction."""
        scored = self.score_frame(df, "_scores")
        if not self.classes:
            value = F.get("_scores", F.lit(0))
        else:
            names = F.array(*[F.lit(c) for c in self.classes])
            if len(self.classes) == 2:
                at = (F.get("_scores", F.lit(0)) > 0).cast("int")
            else:
                at = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int")
            value = F.get(names, at)
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(output))

    def rows(self, spark) -> DataFrame:
        """(class, tree, weight, nodes, depth, rules) of every tree; the class is null for a regression."""
        out = []
        for i, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                name = None if not self.classes else self.classes[1 if len(trees) == 1 else k]
                nodes, deep, rules = self._written(t, 0, "")
                out.append((name, i, float(self.rate), nodes, deep, rules))
        return spark.createDataFrame(out, "class string, tree int, weight double, nodes int, depth int, rules string")

    def _written(self, t: Tree, node: int, lead: str) -> tuple:
        if t.inputs[node] < 0:
            return 1, 0, f"{lead}predict {t.values[node]:g}\n"
        i = int(t.inputs[node])
        name, edge = self.terms[i].name, self.edges[i][t.cuts[node]]
        left, right = self._written(t, 2 * node + 1, lead + "  "), self._written(t, 2 * node + 2, lead + "  ")
        return (1 + left[0] + right[0], 1 + max(left[1], right[1]),
                f"{lead}if {name} <= {edge:g}\n{left[2]}{lead}else\n{right[2]}")


def bin_edges(rows: DataFrame, names: list, bins: int) -> list:
    """Per column the values that cut it into bins: between neighbours where there are few, else at its percentiles."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("v")) for i, n in enumerate(names)]))
    few = rows.select(each).groupBy("i").agg(F.approx_count_distinct("v").alias("n"))
    many = [r["i"] for r in few.filter(F.col("n") > 2 * bins).collect()]  # one row per column
    values: dict = {i: [] for i in range(len(names))}
    if len(many) < len(names):
        seen = rows.select(each).filter(~F.col("i").isin(many)).distinct()
        for r in small_rows(seen, 10 * bins * len(names), "distinct values"):
            values[r["i"]].append(r["v"])
    cut = [j / bins for j in range(1, bins)]
    if many:
        found = rows.agg(*[F.percentile_approx(names[i], cut, 10_000).alias(f"q{i}") for i in many]).first()
    out = []
    for i in range(len(names)):
        v = np.unique(values[i])
        if i in many:
            out.append(np.unique(found[f"q{i}"]))
        elif len(v) > bins:
            out.append(np.unique(np.quantile(v, cut, method="lower")))
        else:
            out.append((v[1:] + v[:-1]) / 2)
    return out


def _profiles(rows: DataFrame, names: list, edges: list, classes: int) -> DataFrame:
    """(profile, n, s): distinct bins, their rows, and the target's sum or its count per class."""
    width = max(classes, 1)
    model = HistModel([], edges, [], np.zeros(1), 0.0, 0)

    def local(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bins = model.binned(np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]))
            y = b.column("_y").to_numpy(zero_copy_only=False)
            found, at = np.unique(bins, axis=0, return_inverse=True)
            at = at.ravel()
            if classes:
                s = np.zeros((len(found), width))
                np.add.at(s, (at, y.astype(int)), 1.0)
            else:
                s = np.bincount(at, y, minlength=len(found))[:, None]
            yield pa.RecordBatch.from_arrays([
                pa.array([p.tobytes() for p in found], pa.binary()), pa.array(np.bincount(at, minlength=len(found)).astype(float)),
                *[pa.array(np.ascontiguousarray(s[:, k])) for k in range(width)]], names=["profile", "n", *[f"s{k}" for k in range(width)]])

    sums = [f"s{k}" for k in range(width)]
    found = rows.mapInArrow(local, "profile binary, n double, " + ", ".join(f"{c} double" for c in sums))
    return found.groupBy("profile").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


_BLOCK = "bins binary, n binary, s binary, scores binary"


def _packed(bins, n, s, scores) -> list:
    return [zlib.compress(np.ascontiguousarray(a).tobytes(), 1) for a in (bins, n, s, scores)]


def _unpacked(row, inputs: int, width: int, trees: int) -> tuple:
    raw = [zlib.decompress(c) for c in row]
    return (np.frombuffer(raw[0], np.uint8).reshape(-1, inputs), np.frombuffer(raw[1]), np.frombuffer(raw[2]).reshape(-1, width),
            np.frombuffer(raw[3]).reshape(-1, trees))


def _blocks(profiles: DataFrame, inputs: int, width: int, start: np.ndarray) -> DataFrame:
    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                bins = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, inputs)
                s = np.column_stack([part.column(2 + k).to_numpy() for k in range(width)])
                row = _packed(bins, part.column(1).to_numpy(), s, np.tile(start, (len(bins), 1)))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], names=["bins", "n", "s", "scores"])

    return profiles.mapInArrow(pack, _BLOCK)


def _residuals(n: np.ndarray, s: np.ndarray, scores: np.ndarray, classes: int) -> tuple:
    """Per profile and tree the sum of residuals, and the weight that a leaf's value divides by."""
    if not classes:
        return s - n[:, None] * scores, np.tile(n[:, None], (1, 1))
    if classes == 2:
        p = 1 / (1 + np.exp(-scores))
        return s[:, 1:] - n[:, None] * p, n[:, None] * p * (1 - p)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return s - n[:, None] * p, n[:, None] * p * (1 - p)


def _histograms(block: tuple, model: HistModel, scored: int, growing: list, level: int, classes: int, bins: int) -> np.ndarray:
    """trees x nodes of the level x inputs x bins x (residuals, rows, weight) of one block."""
    x, n, s, scores = block
    r, h = _residuals(n, s, model.scores(x, scored, scores), classes)
    nodes, base, p = 2**level, 2**level - 1, x.shape[1]
    out = np.zeros((len(growing), nodes, p, bins, 3))
    for k, tree in enumerate(growing):
        at = tree.leaf(x, level) - base
        here = at >= 0  # rows that came to rest higher up take no part
        for i in range(p):
            cell = at[here] * bins + x[here, i]
            for j, w in enumerate((r[here, k], n[here], h[here, k])):
                out[k, :, i, :, j] = np.bincount(cell, w, minlength=nodes * bins).reshape(nodes, bins)
    return out


def histogram_boosting(
    df: DataFrame, y: str, xs: list, learning_rate: float = 0.1, n_estimators: int = 100, max_depth: int = 3,
    min_samples_split: int = 2, min_samples_leaf: int = 1, min_weight_fraction_leaf: float = 0.0,
    min_impurity_decrease: float = 0.0, bins: int = BINS,
) -> HistModel:
    """Boosted regression trees on residuals: squared error, logistic, or one tree per class and round.

    The model starts from the mean, the log odds or the log shares. A node is cut where that lowers the squared
    error of the residuals most, and only if it has ``min_samples_split`` rows, both sides have
    ``min_samples_leaf`` rows and the given share of all, and the error falls by ``min_impurity_decrease``
    of the whole; ties go to the first input and the lowest cut. Leaves take a Newton step.
    """
    if not 1 <= max_depth <= 12:
        raise ValueError("max_depth lies between 1 and 12")
    if not 2 <= bins <= 256:
        raise ValueError("bins lie between 2 and 256")
    rows = complete_rows(df.select(*dict.fromkeys([y, *xs])), [y, *xs])
    d = G.design(rows, xs)
    terms = [t for x in xs for t in d[x]]
    classes = []
    if is_nominal(df, y):
        classes = sorted(r[0] for r in small_rows(rows.select(F.col(f"`{y}`").cast("string")).distinct(), MAX_CLASSES, "target classes"))
        target = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{y}`").cast("string")) - 1).cast("double")
    else:
        target = F.col(f"`{y}`").cast("double")
    names = [f"_t{i}" for i in range(len(terms))]
    wide = rows.select(target.alias("_y"), *[t.column.alias(n) for t, n in zip(terms, names)])
    edges = bin_edges(wide, names, bins)
    kinds, width = len(classes), max(len(classes), 1)
    profiles = checkpoint(_profiles(wide, names, edges, kinds))
    total = profiles.agg(F.sum("n"), F.count(F.lit(1)), *[F.sum(f"s{k}") for k in range(width)]).first()
    n, size, sums = total[0], total[1], np.array(total[2:], float)
    if not n:
        raise ValueError("no complete rows")
    if kinds == 1:
        start, trees = np.zeros(1), 0
    elif kinds == 2:
        start, trees = np.log(sums[1:] / sums[:1]), 1
    else:
        start, trees = (np.log(sums / n), kinds) if kinds else (sums / n, 1)
    model = HistModel(terms, edges, classes, start, learning_rate, max_depth)
    if not trees or not terms:
        return model
    most = max(len(e) for e in edges) + 1
    if trees * 2 ** (max_depth - 1) * len(terms) * most * 3 > MAX_CELLS:
        raise ValueError(f"classes x nodes x inputs x bins: more than {MAX_CELLS} histogram cells")
    blocks = checkpoint(_blocks(profiles, len(terms), width, start))
    here = None
    if size * len(terms) <= LOCAL_CELLS:  # checked: so few profiles that a job a level would cost more than the sums
        here = [_unpacked(r, len(terms), width, trees) for r in blocks.collect()]
    scored = 0
    limits = (max(min_samples_split, 2), max(min_samples_leaf, min_weight_fraction_leaf * n, 1), min_impurity_decrease * n)
    for round_ in range(n_estimators):
        growing = [Tree(np.full(2 ** (max_depth + 1) - 1, -1), np.zeros(2 ** (max_depth + 1) - 1, np.int64), np.zeros(2 ** (max_depth + 1) - 1))
                   for _ in range(trees)]
        for level in range(max_depth):
            if level and not any((t.inputs[2 ** (level - 1) - 1:2**level - 1] >= 0).any() for t in growing):
                break
            if here is not None:
                found = reduce(np.add, [_histograms(b, model, scored, growing, level, kinds, most) for b in here])
            else:
                found = _distributed(blocks, model, scored, growing, level, kinds, most, width)
            for k, tree in enumerate(growing):
                _cut(tree, found[k], level, limits, kinds)
        model.rounds.append(growing)
        if here is not None:
            here = [(x, c, s, model.scores(x, round_, scores)) for x, c, s, scores in here]
            scored = round_ + 1
        elif len(model.rounds) - scored >= SCORE_EVERY:
            blocks, scored = checkpoint(_rescored(blocks, model, scored, width)), len(model.rounds)
    return model


def _cut(tree: Tree, found: np.ndarray, level: int, limits: tuple, classes: int) -> None:
    """Leaf values of a level's nodes and, where one pays, the best cut with the values of both sides."""
    split, leaf, decrease = limits
    share = (classes - 1) / classes if classes > 2 else 1.0

    def value(r, h):
        return share * r / h if abs(h) > 1e-150 else 0.0

    base = 2**level - 1
    for node in range(2**level):
        if level and tree.inputs[(base + node - 1) // 2] < 0:
            continue
        cells = found[node]
        r, n, h = cells[0].sum(axis=0)
        if level == 0:
            tree.values[0] = value(r, h)
        if n < split:
            continue
        left = np.cumsum(cells, axis=1)[:, :-1]
        rl, nl = left[..., 0], left[..., 1]
        rr, nr = r - rl, n - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = rl**2 / nl + rr**2 / nr - r**2 / n
        gain = np.where((nl >= leaf) & (nr >= leaf), gain, -np.inf)
        if not gain.size or not gain.max() > max(decrease, 1e-12 * (abs(r) + 1)) or gain.max() < decrease:
            continue
        top = gain >= gain.max() * (1 - 1e-12)  # rounding does not decide between equal cuts
        i, c = np.unravel_index(int(np.argmax(top)), gain.shape)
        at = base + node
        tree.inputs[at], tree.cuts[at] = i, c
        tree.values[2 * at + 1] = value(rl[i, c], left[i, c, 2])
        tree.values[2 * at + 2] = value(rr[i, c], h - left[i, c, 2])


def _distributed(blocks: DataFrame, model: HistModel, scored: int, growing: list, level: int, classes: int, bins: int, width: int) -> np.ndarray:
    """The level's histograms over all blocks: a task sends its sums, one row per cell that is not empty."""
    inputs, trees = len(model.terms), len(growing)
    bare = HistModel([], [], [], model.start, model.rate, model.depth, model.rounds)

    def partial(batches):
        total = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                found = _histograms(_unpacked(row, inputs, width, trees), bare, scored, growing, level, classes, bins)
                total = found if total is None else total + found
        if total is not None:
            flat = total.reshape(-1, 3)
            some = np.flatnonzero(flat[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(np.ascontiguousarray(flat[some, j])) for j in range(3)]], names=["cell", "r", "n", "h"])

    out = np.zeros((trees, 2**level, inputs, bins, 3))
    flat = out.reshape(-1, 3)
    sums = blocks.mapInArrow(partial, "cell long, r double, n double, h double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "rnh"])
    found = sums.toPandas()  # at most the histogram's cells, checked above
    flat[found["cell"].to_numpy()] = found[["r", "n", "h"]].to_numpy()
    return out


def _rescored(blocks: DataFrame, model: HistModel, scored: int, width: int) -> DataFrame:
    inputs, trees = len(model.terms), len(model.start)
    bare = HistModel([], [], [], model.start, model.rate, model.depth, model.rounds)

    def rescore(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                x, n, s, scores = _unpacked(row, inputs, width, trees)
                done = _packed(x, n, s, bare.scores(x, scored, scores))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in done], names=["bins", "n", "s", "scores"])

    return blocks.mapInArrow(rescore, _BLOCK)
