"""Best-fit packing of whole pieces: combinations that exactly fill a gap come first."""

from __future__ import annotations

import pathlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import ByteBpe
from cohortlens.llm.common import arrow, stored, tokenizer_path
from cohortlens.llm.windows import Filling, Places, length_counts, with_rank

WINDOW = 2048
END = 0


@cache
def _vocabulary(data: bytes) -> ByteBpe:
    """One for all tasks of a worker process."""
    return ByteBpe(data)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, text_column: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """Each row's ids and the end id; more than ``window`` of them in pieces of that length, the first with the rest.

    ``doc_id, piece, start, length, ids_crc32`` and, for ranks within a length without a sort, the task
    ``part`` and the piece's number ``nth`` of its length there.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in (
        "start", "length", "ids_crc32", "part", "nth")]])
    shared = docs.sparkSession.sparkContext.broadcast(pathlib.Path(tokenizer).read_bytes())

    def run(batches):
        tool, part, seen = _vocabulary(shared.value), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tool.ids(text.as_py() or "")
                ids.append(end)
                data = np.array(ids, "<u4").tobytes()
                first = (len(ids) - 1) % window + 1
                cuts = [0, *range(first, len(ids) + 1, window)]
                for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, i, s, e - s, zlib.crc32(data[s * 4:e * 4]), part, int(seen[e - s])))
                    seen[e - s] += 1
            if rows:
                yield arrow(schema, **dict(zip(schema.names, zip(*rows))))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


class Sums:
    """Which single lengths, pairs and triples have a given sum, while pieces of each length are left."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.present = left > 0
        lengths = np.flatnonzero(self.present)
        self.pairs = np.zeros(2 * len(left), np.int64)
        for v in lengths:
            self.pairs[v + lengths[lengths >= v]] += 1

    def ended(self, length: int) -> None:
        """Take a length without pieces out of the index."""
        others = np.flatnonzero(self.present)
        self.pairs[length + others] -= 1
        self.present[length] = False

    def free(self, gap: int, taken: list[int]) -> np.ndarray:
        """Pieces left of each length up to the gap, beside those taken."""
        free = self.left[:gap + 1].copy()
        np.subtract.at(free, [v for v in taken if v <= gap], 1)
        return free

    def filling(self, gap: int, taken: list[int], most: int):
        """At most so many (up to three) lengths that sum to the gap and are left beside those taken, the fewest first; else None."""
        free = self.free(gap, taken)
        if most and free[gap] > 0:
            return [gap]
        if most > 1 and (pair := self._pair(gap, free, gap)):
            return pair
        if most < 3:
            return None
        for x in np.flatnonzero((free > 0) & (self.pairs[gap - np.arange(gap + 1)] > 0))[::-1].tolist():
            if x * 3 < gap:
                break
            free[x] -= 1
            pair = self._pair(gap - x, free, x)
            free[x] += 1
            if pair:
                return [x, *pair]
        return None

    def _pair(self, total: int, free: np.ndarray, longest: int):
        if total < 2 or not self.pairs[total]:
            return None
        x = np.arange((total + 1) // 2, min(total - 1, longest) + 1)
        fits = (free[x] > 0) & (free[total - x] > 0)
        if total % 2 == 0 and len(fits) and x[0] * 2 == total:
            fits[0] = free[x[0]] > 1
        at = np.flatnonzero(fits)
        return [int(x[at[-1]]), int(total - x[at[-1]])] if len(at) else None


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows ``length, first rank, per, first sequence, offset`` that place every piece once.

    The gap that a piece leaves is looked up in the index of length sums: single lengths for all pieces
    first, then pairs, then triples; a combination that fills the gap is used as often as all its lengths
    last. What is left is packed by best fit, the longest piece that still fits, and completed exactly where
    the index can. Short pieces spent on an exact filling can be missed later, so plans with fillings of at most
    0, 1, 2 and 3 pieces are made and the one with the fewest sequences counts. The work depends on the number
    of lengths, not of pieces.
    """
    plans = [_plan(histogram, window, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda f: f.sequence).table()


def _plan(histogram: np.ndarray, window: int, most: int) -> Filling:
    filling = Filling(histogram)
    left, index = filling.left, Sums(filling.left)

    def use(parts: list[int]) -> None:
        values, per = np.unique(parts, return_counts=True)
        filling.place(list(zip(values[::-1].tolist(), per[::-1].tolist())), int((left[values] // per).min()))
        for v in values[left[values] == 0]:
            index.ended(int(v))

    for size in range(1, most + 1):
        for length in np.flatnonzero(left)[::-1].tolist():
            while left[length] and length < window and (rest := index.filling(window - length, [length], size)):
                use([length, *rest])
    while (present := np.flatnonzero(left)).size:
        parts, gap = [int(present[-1])], window - int(present[-1])
        while gap:
            if rest := index.filling(gap, parts, most):
                parts += rest
                break
            if not (fits := np.flatnonzero(index.free(gap, parts) > 0)).size:
                break
            parts.append(int(fits[-1]))
            gap -= parts[-1]
        use(parts)
    return filling


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, text_column: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece; no piece is cut further.

    Only the histogram of piece lengths (``window`` numbers) reaches the driver, and the plan goes back. Pieces of
    one length are interchangeable: which of them goes where follows from the order of tasks and of rows
    in them, so a rerun over the same files agrees. A null or empty text is its end id alone; equal rows are packed
    each; a null id stays null. Very long texts become as many pieces as they fill. Other columns are not read.
    Empty table: no rows.
    """
    rows = stored(pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), window, end, text_column, id_column), "whole-pieces")
    places = Places(plan(length_counts(rows, window), window))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = with_rank(rows).select(*names, "rank")

    def run(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            row, k = places.find(length, b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)],
                names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
