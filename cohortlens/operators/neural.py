"""Feed-forward network trained by synchronous gradient steps.

Rows fall into batches by a hash of their content, never by where they lie. A
step adds up the gradient of one batch over all tasks, in salted groups, and the
driver moves the weights. So the layout of the table does not change the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G
from cohortlens.operators.linear import standardised

ACTIVATIONS = ("identity", "logistic", "tanh", "relu")
STEPS = 8  # batches, and so steps, of a round
STEP_SCALE = 10.0  # a step stands for many small ones, so it goes further
CHUNK_ROWS = 2048
SUM_SALTS = 4
MAX_WEIGHTS = 1_000_000


def _activate(name: str, x: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "tanh":
        return np.tanh(x)
    if name == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
    return x


def _slope(name: str, out: np.ndarray) -> np.ndarray:
    """Derivative of the activation, from its output."""
    return {"relu": lambda: (out > 0).astype(float), "tanh": lambda: 1.0 - out * out,
            "logistic": lambda: out * (1.0 - out), "identity": lambda: np.ones_like(out)}[name]()


@dataclass
class Network:
    sizes: list
    activation: str
    softmax: bool

    @property
    def n_weights(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts.append(np.vstack([rng.uniform(-bound, bound, (a, b)), np.zeros((1, b))]).ravel())
        return np.concatenate(parts)

    def layers(self, w: np.ndarray) -> list:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append(w[at:at + (a + 1) * b].reshape(a + 1, b))
            at += (a + 1) * b
        return out

    def forward(self, w: np.ndarray, x: np.ndarray) -> list:
        outs, layers = [x], self.layers(w)
        for i, m in enumerate(layers):
            h = outs[-1] @ m[:-1] + m[-1]
            if i < len(layers) - 1:
                h = _activate(self.activation, h)
            elif self.softmax:
                h = np.exp(h - h.max(axis=1, keepdims=True))
                h /= h.sum(axis=1, keepdims=True)
            outs.append(h)
        return outs

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
        outs, layers = self.forward(w, x), self.layers(w)
        delta = (outs[-1] - y) / len(x)
        grads = []
        for i in reversed(range(len(layers))):
            g = np.vstack([outs[i].T @ delta, delta.sum(axis=0, keepdims=True)])
            g[:-1] += alpha * layers[i][:-1] / len(x)
            grads.append(g.ravel())
            if i:
                delta = (delta @ layers[i][:-1].T) * _slope(self.activation, outs[i])
        return np.concatenate(grads[::-1])


    def penalty(self, w: np.ndarray, alpha: float, n: int) -> np.ndarray:
        """Slope of the weight penalty; intercepts go free."""
        out = [np.vstack([alpha * m[:-1] / n, np.zeros((1, m.shape[1]))]).ravel() for m in self.layers(w)]
        return np.concatenate(out)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [pdf["n"].sum()], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]})


@dataclass
class NeuralModel:
    network: Network
    weights: np.ndarray
    inputs: list
    classes: list
    centre: float = 0.0
    scale: float = 1.0

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.weights)  # at most MAX_WEIGHTS numbers
        network, classes, centre, scale = self.network, self.classes, self.centre, self.scale

        @F.pandas_udf("string" if classes else "double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            out = network.forward(shared.value, x)[-1]
            if classes:
                return pd.Series(np.array(classes, dtype=object)[out.argmax(axis=1)])
            return pd.Series(out[:, 0] * scale + centre)

        return df.withColumn(output, score(*self.inputs))

    def rows(self, spark) -> DataFrame:
        """(layer, source, unit, weight); source -1 is the intercept."""
        out = [(layer, -1 if a == len(m) - 1 else a, b, float(m[a, b]))
               for layer, m in enumerate(self.network.layers(self.weights)) for a in range(len(m)) for b in range(m.shape[1])]
        return spark.createDataFrame(out, "layer int, source int, unit int, weight double")


def neural_network(
    df: DataFrame, y: str, xs: list, hidden_layer_sizes: str = "100", activation: str = "relu",
    alpha: float = 1e-4, learning_rate_init: float = 1e-3, rounds: int = 10, seed: int = 17, step_scale: float = STEP_SCALE,
) -> NeuralModel:
    """Network with the given hidden layers, trained by ``rounds`` times ``STEPS`` steps.

    A step goes ``step_scale * learning_rate_init`` far in the scaled gradient: there are only ``STEPS`` of them a round,
    where small batches would give thousands. ``step_scale=1`` takes the rate as it is given.
    """
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation is one of {', '.join(ACTIVATIONS)}")
    rows = complete_rows(df, [y, *xs])
    _, inputs = standardised(rows, xs)
    classes = G.nominal_levels(rows, [y])[y] if is_nominal(df, y) else []
    centre, scale = 0.0, 1.0
    if classes:
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{y}`").cast("string")) - 1
    else:
        row = rows.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        centre, scale = float(row["m"]), float(row["s"] or 1.0)
        label = (F.col(f"`{y}`").cast("double") - F.lit(centre)) / F.lit(scale)
    hidden = [int(h) for h in str(hidden_layer_sizes).split(",") if h.strip()]
    network = Network([len(inputs), *hidden, len(classes) or 1], activation, bool(classes))
    if network.n_weights > MAX_WEIGHTS:
        raise ValueError(f"{network.n_weights} weights; at most {MAX_WEIGHTS} are supported")
    batch = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys([y, *xs])]), F.lit(STEPS)).cast("int")
    table = rows.select(
        *[x.cast("double").alias(f"_z{i}") for i, x in enumerate(inputs)], label.cast("double").alias("_label"),
        batch.alias("_batch")).sortWithinPartitions("_batch").persist(StorageLevel.MEMORY_AND_DISK)  # a step reads its batch alone
    n_classes, n_inputs = len(classes), len(inputs)
    sc = df.sparkSession.sparkContext
    weights = network.start(seed)
    m, v, t = np.zeros_like(weights), np.zeros_like(weights), 0
    rate = learning_rate_init * step_scale
    try:
        for turn in range(rounds):
            for batch in np.random.default_rng([seed, turn]).permutation(STEPS):
                shared = sc.broadcast(weights)

                def slope(batches, shared=shared):
                    w, n, total = shared.value, 0, 0.0
                    for pdf in batches:
                        x = pdf.iloc[:, :n_inputs].to_numpy(float)
                        y_ = pdf["_label"].to_numpy(float)
                        y_ = np.eye(n_classes)[y_.astype(int)] if n_classes else y_[:, None]
                        for at in range(0, len(x), CHUNK_ROWS):
                            part = x[at:at + CHUNK_ROWS]
                            total = total + network.gradient(w, part, y_[at:at + CHUNK_ROWS], 0.0) * len(part)
                            n += len(part)
                    if n:
                        yield pd.DataFrame({"n": [n], "g": [total]})

                local = table.filter(F.col("_batch") == int(batch)).mapInPandas(slope, "n long, g array<double>")
                salt = (F.spark_partition_id() % SUM_SALTS).alias("salt")
                found = local.groupBy(salt).applyInPandas(_added, "n long, g array<double>").collect()  # SUM_SALTS rows
                if not found:
                    continue
                n = sum(r["n"] for r in found)
                g = sum(np.array(r["g"]) for r in found) / n + network.penalty(weights, alpha, n)
                t += 1
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                weights = weights - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    finally:
        table.unpersist()
    return NeuralModel(network, weights, inputs, classes, centre, scale)
