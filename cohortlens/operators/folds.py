"""k-fold and leave-out splits without a global window.

``ntile(k) OVER (ORDER BY key)`` needs only the k-1 rows that end a tile. Their
keys are found by counting rows per leading digit of the order key (map-side
aggregates over a key-only scan), narrowing to the digit that holds each wanted
rank, and looking at the few rows left. The fold of a row is then a plain
comparison with those keys: no sort, no shuffle of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.keys import md5_order, pseudo_encrypt, seeded_order
from cohortlens.model import FilterRule
from cohortlens.operators.filters import apply_filters

DIGIT_BITS = 14
LEAF_ROWS = 4096
STRING_CHUNK = 7  # bytes per 56-bit number


def _tile_ends(n: int, k: int) -> list:
    """Rank of the last row of tiles 1..k-1; the first n mod k tiles get one row more."""
    q, r = divmod(n, k)
    return [i * q + min(i, r) for i in range(1, k)]


def _rows_at_ranks(
    rows: DataFrame, digits: Callable, ranks: Callable, level: int = 0
) -> list:
    """The ``key`` structs at 1-based ranks of the ascending order of ``key``.

    ``digits(level)`` gives (non-negative integer column, bits), order preserving
    within rows that agree on every earlier level. ``ranks(n)`` lists the wanted
    ranks once the row count is known.
    """
    number, bits = digits(level)
    rows = rows.withColumn("_digit", number)
    scope, known, wanted = None, bits, None
    while True:
        shift = max(known - DIGIT_BITS, 0)
        view = rows if scope is None else rows.filter(F.shiftright("_digit", known).isin(*scope))
        counts = sorted(
            (r["d"], r["n"]) for r in
            view.groupBy(F.shiftright("_digit", shift).alias("d"))
            .agg(F.count(F.lit(1)).alias("n")).collect()
            if r["d"] is not None
        )
        if wanted is None:
            total = sum(n for _, n in counts)
            wanted = {i: (None, r) for i, r in enumerate(ranks(total)) if 1 <= r <= total}
        by_parent: dict = {}
        for d, n in counts:
            by_parent.setdefault(None if scope is None else d >> (known - shift), []).append((d, n))
        sizes = dict(counts)
        for i, (parent, rank) in wanted.items():
            for d, n in by_parent[parent]:
                if rank <= n:
                    wanted[i] = (d, rank)
                    break
                rank -= n
        known, scope = shift, sorted({d for d, _ in wanted.values()})
        if not wanted:
            return []
        if known == 0 or max(sizes[d] for d in scope) <= LEAF_ROWS:
            break
    found: dict = {}
    in_scope = F.shiftright("_digit", known)
    small = [d for d in scope if sizes[d] <= LEAF_ROWS]
    if small:
        leaf: dict = {}
        for r in rows.filter(in_scope.isin(*small)).select(in_scope.alias("d"), "key").collect():
            leaf.setdefault(r["d"], []).append(tuple(r["key"]))
        for d, keys in leaf.items():
            keys.sort()
            found.update({(d, rank): keys[rank - 1] for p, rank in wanted.values() if p == d})
    for d in scope:  # rows that agree on the whole number: go on with the next one
        if d not in small:
            inner = [rank for p, rank in wanted.values() if p == d]
            deeper = _rows_at_ranks(rows.filter(in_scope == d), digits, lambda _: inner, level + 1)
            found.update({(d, rank): key for rank, key in zip(inner, deeper)})
    return [found[wanted[i]] for i in sorted(wanted)]


def _after(order: Column, tie: Column, end: tuple) -> Column:
    return (order > F.lit(end[0])) | ((order == F.lit(end[0])) & (tie > F.lit(end[1])))


def _once(order: Column, tie: Column, use: Callable) -> Column:
    """``use`` of the key {o, t}, which goes through a one-element array: a filter
    that the optimizer pushes down then computes the key once, not at every mention.
    """
    key = F.struct(order.alias("o"), tie.alias("t"))
    return F.get(F.transform(F.array(key), use), F.lit(0))


def _count_below(order: Column, tie: Column, ends: list, first: int) -> Column:
    """``first`` plus the number of tile ends below (order, tie)."""
    def place(k):
        out = F.lit(first)
        for end in ends:
            out = out + _after(k["o"], k["t"], end).cast("int")
        return out

    return _once(order, tie, place) if ends else F.lit(first)


def _tile_keys(df: DataFrame, order: Column, tie: str, k: int, bits: int) -> list:
    """(order, tie) of the last row of tiles 1..k-1 (fewer when there are fewer rows)."""
    if k < 1:
        raise ValueError("k must be positive")

    def digits(level):
        if level:
            raise ValueError(f"column {tie} is not a key: too many rows share one order value")
        return F.col("key._order"), bits

    keyed = df.select(F.struct(order.alias("_order"), F.col(tie).alias("_tie")).alias("key"))
    return _rows_at_ranks(keyed, digits, lambda n: _tile_ends(n, k))


def ntile_by_order(df: DataFrame, order: Column, tie: str, k: int, output: str, bits: int = 63) -> DataFrame:
    """Add ``ntile(k) OVER (ORDER BY order, tie)`` for a non-negative order key of so many bits."""
    ends = _tile_keys(df, order, tie, k, bits)
    return df.withColumn(output, _count_below(order, F.col(tie), ends, 1))


def split_column(k: int) -> str:
    return f"_win_kfold_{k}"


def kfold_split(
    df: DataFrame, key: str, k: int, seed: float = 0.67, rule: FilterRule | None = None
) -> DataFrame:
    """Filter, then add the fold 1..k of each row in a seeded pseudo-random order."""
    if k < 2:
        raise ValueError("k-fold needs k >= 2")
    return ntile_by_order(
        apply_filters(df, rule), seeded_order(F.col(key), seed), key, k, split_column(k)
    )


def leave_out(
    df: DataFrame, k: int, exclude: int, key: str, order: str = "auto",
    rule: FilterRule | None = None, seed: float = 0.67, keep_window: bool = False,
) -> DataFrame:
    """Rows outside one of k partitions; ``exclude`` counts from 0.

    The order is by md5 for text keys, by the Feistel permutation for integer
    keys, or ``order="random"`` for a seeded one. The user filter runs first.
    """
    if not 0 <= exclude < k:
        raise ValueError("exclude must lie in 0..k-1")
    rows = apply_filters(df, rule)
    if order == "auto":
        order = "string" if isinstance(df.schema[key].dataType, T.StringType) else "int"
    column, bits = {
        "string": lambda: (md5_order(F.col(key)), 63),
        "int": lambda: (pseudo_encrypt(F.col(key)) + (1 << 31), 32),
        "random": lambda: (seeded_order(F.col(key), seed), 63),
    }[order]()
    if keep_window:
        return ntile_by_order(rows, column, key, k, "_window_", bits).filter(F.col("_window_") != exclude + 1)
    ends = _tile_keys(rows, column, key, k, bits)
    if exclude > len(ends):
        return rows  # the partition left out has no rows

    def stays(k):
        before = ~_after(k["o"], k["t"], ends[exclude - 1]) if exclude else F.lit(False)
        behind = _after(k["o"], k["t"], ends[exclude]) if exclude < len(ends) else F.lit(False)
        return before | behind

    return rows.filter(_once(column, F.col(key), stays))


def offset_folds(df: DataFrame, key: str, k: int, output: str = "fold") -> DataFrame:
    """Contiguous folds 0..k-1 of a table ordered by its key: fold i starts at rank i*n/k, rounded."""
    text = isinstance(df.schema[key].dataType, T.StringType)
    if not text and not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError("offset folds need an integer or text key")
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if bounds["lo"] is None:
        return df.withColumn(output, F.lit(0))
    if text:
        lo, hi = bounds["lo"].encode(), bounds["hi"].encode()
        common = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))

        def digits(level):
            at = common + level * STRING_CHUNK
            if at > (1 << 16):
                raise ValueError(f"column {key} is not a key: too many rows share one value")
            piece = F.hex(F.substring(F.encode(F.col("key.k"), "UTF-8"), at + 1, STRING_CHUNK))
            padded = F.rpad(piece, 2 * STRING_CHUNK, "0")
            return F.conv(padded, 16, 10).cast("bigint"), 8 * STRING_CHUNK
    else:
        span = int(bounds["hi"]) - int(bounds["lo"])

        def digits(level):
            if level:
                raise ValueError(f"column {key} is not a key: too many rows share one value")
            return F.col("key.k").cast("bigint") - F.lit(int(bounds["lo"])), max(span.bit_length(), 1)

    keyed = df.select(F.struct(F.col(key).alias("k")).alias("key"))
    ends = _rows_at_ranks(keyed, digits, lambda n: [(2 * i * n + k) // (2 * k) for i in range(1, k)])
    missing = k - 1 - len(ends)  # more folds than rows: the first ones are empty
    marks = [F.lit(e) for (e,) in ends]
    fold = F.lit(missing)
    for mark in marks:
        fold = fold + (F.col(key) > mark).cast("int")
    return df.withColumn(output, fold.cast("int"))


def train_test(df: DataFrame, split: str, fold: int) -> tuple:
    """(training rows, test rows) of one fold; two filters over the same frame."""
    return df.filter(F.col(split) != fold), df.filter(F.col(split) == fold)


def fold_pairs(df: DataFrame, split: str, k: int) -> list:
    return [(fold, *train_test(df, split, fold)) for fold in range(1, k + 1)]


def fold_sizes(df: DataFrame, split: str, k: int) -> DataFrame:
    """Per fold 1..k: rows held out, rows trained on, and whether the fold is usable."""
    spine = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
    counts = df.groupBy(F.col(split).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("fold").between(1, k))
    total = F.sum("n_test").over(Window.partitionBy(F.lit(1)))  # over k rows
    return (
        spine.join(F.broadcast(counts), "fold", "left")  # k rows at most
        .select("fold", F.coalesce("n", F.lit(0)).alias("n_test"))
        .withColumn("n_train", total - F.col("n_test"))
        .withColumn("valid", F.col("n_test") > 0)
    )


def validate_folds(df: DataFrame, split: str, k: int) -> DataFrame:
    """Raise unless there are k folds and none is empty; returns the fold sizes."""
    sizes = fold_sizes(df, split, k)
    rows = sizes.collect()  # k rows
    empty = [r["fold"] for r in rows if not r["valid"]]
    if empty:
        raise ValueError(f"expected {k} folds, but folds {empty} are empty")
    return sizes
