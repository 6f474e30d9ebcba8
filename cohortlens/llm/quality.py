"""Quality classifier by Bradley-Terry ranking over preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import arrow, held_out, raw

# Labelled rows that the fit takes at most, and preference pairs per rejected row.
LABELLED_ROWS = 20_000
PAIRS = 8
FOLDS = 3

SYMBOLS = b"#$%&*|!?.,;:-_/\\\"'()<>=+@{}[]~^`"
_GROUPS = ([range(65, 91)], [range(97, 123)], [range(48, 58)], [range(128, 256)], [(10, 13)], [(32, 9)])


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and symbols, and how much words and lines repeat; an empty text is all zeros."""
    data = raw(text)
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(SIZE)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = len(data)
    groups = [sum(int(counts[list(r)].sum()) for r in g) / total for g in _GROUPS]
    letters = counts[65:91].sum() + counts[97:123].sum()
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.array([
        *groups, counts[65:91].sum() / max(letters, 1), *np.sqrt(counts[list(SYMBOLS)] / n),
        distinct / n, np.log(distinct) / np.log(n + 1), again / n, len(set(lines)) / max(len(lines), 1),
        np.log1p(n), np.log1p(total / n), np.log1p(n / max(len(lines), 1)), 1.0 / n,
    ])


SIZE = len(_GROUPS) + 1 + len(SYMBOLS) + 8


@dataclass
class Ranking:
    """Weights over standardised features, and the score at the wanted quantile."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, quantile: float | None = None,
        seed: int = 5) -> Ranking:
    """Learn from pairs (a row marked 1, a row marked 0): P(first is better) = sigmoid(w (xa - xb)).

    Newton steps on the penalised logistic loss of the feature differences. The
    threshold is the quantile of the fitted scores at the share of rows marked 0, or
    at ``quantile``. With one label only nothing can be ranked: all weights are 0 and
    every row scores on the side of that label; without rows, 0.5.
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        side = 0.0 if len(x) == 0 else (-1.0 if len(good) else 1.0)
        return Ranking(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), side)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / spread, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * pairs
    n = min(n, LABELLED_ROWS * pairs)
    d = good[rng.permutation(np.arange(n) % len(good))] - bad[rng.permutation(np.arange(n) % len(bad))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        grad = d.T @ (1 - p) / n - penalty * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    share = (y == 0).mean() if quantile is None else quantile
    return Ranking(centre, spread, w, _between(z @ w, float(share)))


def _between(scores: np.ndarray, share: float) -> float:
    """Middle of the two scores between which the share ends."""
    s = np.sort(scores)
    k = min(max(int(round(share * len(s))), 1), len(s) - 1) if len(s) > 1 else 0
    return float((s[k - 1] + s[k]) / 2) if k else float(s[0])


def learned(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id",
            label_column: str = "quality", folds: int = FOLDS, labelled_rows: int = LABELLED_ROWS) -> Ranking:
    """The ranking fitted on at most ``labelled_rows`` labels outside the held-out fold, and twice as many rows.

    Labels are chosen by a hash of their id, and where ids repeat in ``docs`` the rows by a hash of id and
    text. Labels that disagree count by majority; null labels and null ids teach nothing.
    """
    marks = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).cast("long").alias("_id")).agg((F.avg(label_column) >= 0.5).cast("int").alias("_y"))
             .where(~held_out("_id", folds)).orderBy(F.xxhash64("_id"), "_id").limit(labelled_rows))
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64())), ("order", pa.int64())])

    def run(batches):
        for b in batches:
            yield arrow(schema, y=b.column(0), x=[features(t.as_py()) for t in b.column(1)], order=b.column(2))

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    # ids that repeat bring more rows than labels; which of them count follows from their content, not from the layout
    taught = rows.join(F.broadcast(marks), "_id").select("_y", "_text", F.xxhash64("_id", "_text"))
    sample = taught.mapInArrow(run, "y int, x array<double>, order long").orderBy("order", "y").limit(2 * labelled_rows).toPandas()
    x = np.array(sample["x"].tolist()).reshape(len(sample), SIZE)
    order = np.lexsort(x.T)
    return fit(x[order], sample["y"].to_numpy()[order])


def scored(docs: DataFrame, model: Ranking, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, in a column added last; all rows and columns stay."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_column)

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(b.num_rows, SIZE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], names=[*b.schema.names, "score"])

    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).toDF(*names, score_column)


def quality_scores(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id",
                   label_column: str = "quality", folds: int = FOLDS, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Labels are learned from rows whose crc32(id as text) leaves a remainder other
    than 1. Inputs of the score are features of the whole text alone. A null or empty
    text has a score and rows that repeat come back as often.
    """
    model = learned(docs, labels, text_column, id_column, label_column, folds, labelled_rows)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return scored(rows, model).select("doc_id", held_out("doc_id", folds).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
