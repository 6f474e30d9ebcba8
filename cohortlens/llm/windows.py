"""Placing pieces of known lengths into fixed windows by a plan over lengths and counts.

A plan has rows ``length, first rank, per, sequence, offset``: from that rank on, pieces of that
length stand ``per`` to a sequence, one after the other, in consecutive sequences. Its size depends on
the number of lengths, not of pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Filling:
    """A plan in the making: what is left of each length, and the rows so far."""

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.rows: list[tuple] = []
        self.sequence = 0

    def place(self, parts: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences, each with so many pieces of each length, in this order."""
        offset = 0
        for length, per in parts:
            self.rows.append((length, self.used[length], per, self.sequence, offset))
            self.used[length] += per * times
            self.left[length] -= per * times
            offset += length * per
        self.sequence += times

    def table(self) -> np.ndarray:
        return np.array(self.rows, dtype=np.int64).reshape(-1, 5)


class Places:
    """Looks up the plan row of a piece by its length and rank."""

    def __init__(self, table: np.ndarray):
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.keys = self.table[:, 0] * (1 << 48) + self.table[:, 1]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' rows, and how many pieces of the row come before each."""
        row = self.table[np.searchsorted(self.keys, length * (1 << 48) + rank, side="right") - 1]
        return row, rank - row[:, 1]


def length_counts(rows: DataFrame, window: int) -> np.ndarray:
    """Pieces of each length, at most ``window`` numbers."""
    histogram = np.zeros(window + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        histogram[length] = n
    return histogram


def with_rank(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, in place of its task ``part`` and its number ``nth`` there.

    Only the tasks' counts per length are ordered, so a length that many pieces share needs no sort.
    """
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
