"""Principal components of tables with very many columns, without their p x p matrix.

The correlation matrix C is only ever applied to a thin block: a task multiplies its rows with the
block and sends back p x width sums. Starting from a random block, the blocks C Q, C C Q, ... are kept side
by side (a block Krylov space) and the components are the best ones inside their span; passes end when
these satisfy C v = s v closely enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.pca import PCAModel, fixed_signs
from cohortlens.session import checkpoint

EXTRA = 8  # columns of a block beyond the components asked for
MAX_NUMBERS = 40_000_000  # of all blocks together on the driver
SAMPLE_ROWS = 1000


def _arrays(df: DataFrame, columns: list | str) -> DataFrame:
    """One array of doubles per row, from many columns or from an array column."""
    if isinstance(columns, str):
        return df.select(F.transform(F.col(f"`{columns}`"), lambda v: v.cast("double")).alias("x"))
    return df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"))


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    """The complete rows of a batch; a null or NaN in any place leaves a row out."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, p)
    return x[~np.isnan(x).any(axis=1)]


def _summed(rows: DataFrame, p: int, width: int, of_batch) -> np.ndarray:
    """Sum over all rows of a p x width block that ``of_batch`` makes of a matrix; a task sends one block."""
    names = [f"b{i}" for i in range(width)]
    schema = "j int, " + ", ".join(f"{n} double" for n in names)

    def partial(batches):
        total = np.zeros((p, width))
        for b in batches:
            if len(x := _matrix(b.column(0), p)):
                total += of_batch(x)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(p, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(width)]], names=["j", *names])

    out = np.zeros((p, width))
    for r in rows.mapInArrow(partial, schema).groupBy("j").agg(*[F.sum(n).alias(n) for n in names]).collect():  # p rows
        out[r["j"]] = r[1:]
    return out


def wide_pca(
    df: DataFrame, columns: list | str, k: int = 5, tolerance: float = 1e-10, passes: int = 60, seed: int = 17,
) -> PCAModel:
    """The first k components of standardised columns, or of the places of an array column.

    ``residual`` of the model is the largest |C v - s v| / s1 over the components: below ``tolerance`` unless the
    passes ran out, which happens where variances hardly differ. Rows with a null, a NaN or another length
    are left out. Only p numbers a column of the block leave a task, and p x width times the passes stay on the driver.
    """
    arrays = _arrays(df, columns)
    first = arrays.filter("x IS NOT NULL").first()
    if first is None:
        raise ValueError("no complete rows")
    p = len(first["x"])
    names = [f"{columns}[{i}]" for i in range(p)] if isinstance(columns, str) else list(columns)
    k = min(k, p)
    width = min(k + EXTRA, p)
    if p * width > MAX_NUMBERS:
        raise ValueError(f"{p} columns times {width}: more than {MAX_NUMBERS} numbers a pass")
    rows = checkpoint(arrays.filter(F.size("x") == p))
    low = np.zeros(p)  # near the means, so that squares do not cancel
    some = [np.array([np.nan if v is None else v for v in r["x"]], float) for r in rows.limit(SAMPLE_ROWS).collect()]
    if some:
        low = np.nan_to_num(np.nanmean(np.array(some), axis=0)) if not np.isnan(np.array(some)).all(axis=0).any() else low

    sums = _summed(rows, p, 3, lambda x: np.stack([np.full(p, float(len(x))), (x - low).sum(axis=0), ((x - low) ** 2).sum(axis=0)], axis=1))
    n = sums[0, 0]
    if n < 1:
        raise ValueError("no complete rows")
    mean = low + sums[:, 1] / n
    spread = sums[:, 2] / n - (sums[:, 1] / n) ** 2
    if np.any(spread <= 0):
        raise ValueError("PCA needs columns that vary")
    std = np.sqrt(spread)

    def times(q: np.ndarray) -> np.ndarray:
        """C q from one scan."""
        shared = rows.sparkSession.sparkContext.broadcast(q / std[:, None])  # p x width, size checked above

        def block(x):
            x = x - mean
            return x.T @ (x @ shared.value)

        return _summed(rows, p, q.shape[1], block) / n / std[:, None]

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    for _ in range(passes):
        basis, image = np.hstack([basis, q]), np.hstack([image, times(q)])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        vectors = basis @ inner
        residual = float(np.linalg.norm(image @ inner - vectors * values, axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or basis.shape[1] + 1 > p or (basis.size + p * width) * 2 > 2 * MAX_NUMBERS:
            break
        rest = image[:, -q.shape[1]:]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        q = left[:, size > 1e-12 * values[0]][:, :p - basis.shape[1]]
        q = q - basis @ (basis.T @ q)
        if not q.shape[1]:
            break
        q = np.linalg.qr(q)[0]
    return PCAModel(names, mean, std, np.maximum(values, 0.0), fixed_signs(vectors.T), residual, columns if isinstance(columns, str) else None)
