"""Subgroup discovery: conjunctions of binned conditions with a high lift.

The rows are read twice: once to count every single condition, once to write, block by block of rows, one
bitmap per condition that has enough support. All longer rules are counted on these bitmaps, whose size depends on
rows and conditions but not on how many combinations of categories occur, so any number of covariables will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.dist import fisher_greater
from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators.histogram import bin_index, numeric_ranges
from cohortlens.session import checkpoint, small_rows

BINS = 4
MAX_CLASSES = 200
MAX_CANDIDATES = 500_000
BLOCK_ROWS = 1 << 16  # rows of a bitmap
CHUNK_RULES = 4096  # rules counted by one pass over the bitmaps
RULE_SCHEMA = (
    "target string, rule string, depth int, cov long, pos long, prec double, lift double, pval double"
)


def binned(df: DataFrame, columns: list, bins: int = BINS) -> tuple:
    """(cells, labels): the table as category columns, and how each category reads."""
    numeric = [c for c in columns if not is_nominal(df, c)]
    ranges = numeric_ranges(df, numeric) if numeric else {}
    cells, labels = [], {}
    for c in columns:
        if c in ranges:
            lo, hi = ranges[c]
            cells.append(bin_index(F.col(f"`{c}`").cast("double"), lo, hi, bins).cast("string").alias(c))
            width = (hi - lo) / bins
            for b in range(bins):
                sign = "<=" if b == bins - 1 else "<"
                labels[c, str(b)] = f"{lo + b * width:g}<={c}{sign}{lo + (b + 1) * width:g}"
        else:
            cells.append(F.col(f"`{c}`").cast("string").alias(c))
    return df.select(*cells), labels


def condition_counts(df: DataFrame, y: str, xs: list, bins: int = BINS) -> DataFrame:
    """(variable, value, target, n): every one-condition subgroup, from one scan."""
    cells, _ = binned(df, [y, *xs], bins)
    pairs = F.inline(F.array(*[
        F.struct(F.lit(x).alias("variable"), F.col(f"`{x}`").alias("value")) for x in xs
    ]))
    return (
        complete_rows(cells).select(F.col(f"`{y}`").alias("target"), pairs)
        .groupBy("variable", "value", "target").agg(F.count(F.lit(1)).alias("n"))
    )


def level_one(df: DataFrame, y: str, xs: list, bins: int = BINS) -> DataFrame:
    """cov, pos, prec and lift of every one-condition subgroup and target class."""
    counts = condition_counts(df, y, xs, bins)
    first = counts.filter(F.col("variable") == xs[0])
    totals = first.groupBy("target").agg(F.sum("n").alias("positives"))
    totals = totals.withColumn("total", F.sum("positives").over(Window.partitionBy(F.lit(1))))  # one row per class
    cover = counts.groupBy("variable", "value").agg(F.sum("n").alias("cov"))
    return (
        counts.join(cover, ["variable", "value"]).join(totals, "target")
        .select(
            "target", "variable", "value", "cov", F.col("n").alias("pos"),
            (F.col("n") / F.col("cov")).alias("prec"),
            (F.col("n") / F.col("cov") / (F.col("positives") / F.col("total"))).alias("lift"),
        )
    )


def subgroups(
    df: DataFrame, y: str, xs: list, beam: int = 10, support: float = 0.1, depth: int = 2,
    bins: int = BINS, alpha: float = 0.05,
) -> DataFrame:
    """Beam search for rules on each target class, best lift first.

    Each level extends the rules of the beam by every condition on another variable. How good an extension can
    be at best follows from its parts: it covers no more positives than either, and no fewer rows than the support. The
    most promising are counted first, and counting ends where none can reach the beam any more, so the
    rules found are those of a full search.
    """
    cells, labels = binned(df, [y, *xs], bins)
    cells = complete_rows(cells)
    targets = {r[y]: r["n"] for r in small_rows(
        cells.groupBy(y).agg(F.count(F.lit(1)).alias("n")), MAX_CLASSES, "target classes")}
    total = sum(targets.values())
    classes, least = sorted(targets), support * total
    counted = _single_counts(cells, y, xs, classes, least)
    items = sorted(counted, key=lambda r: (xs.index(r[0][0]), r[0][1]))
    bitmaps = None
    results, survivors = [], {}
    for level in range(1, depth + 1):
        if level > 1:
            wanted = _extensions(items, survivors, xs)
            if not wanted:
                break
            if bitmaps is None:
                bitmaps = checkpoint(_bitmaps(cells, y, xs, [r[0] for r in items], classes))
            counted = _best_counted(bitmaps, wanted, counted, items, classes, targets, total, least, beam)
        for t in classes:
            scored: dict = {}
            for rule, (counts, owners) in counted.items():
                cov, pos = sum(counts), counts[classes.index(t)]
                if pos and (owners is None or t in owners):
                    prec = pos / cov
                    scored[rule] = (prec / (targets[t] / total), pos, cov, prec)
            text = {rule: [labels.get(c, f"{c[0]}={c[1]}") for c in rule] for rule in scored}
            order = sorted(scored, key=lambda r: (-scored[r][0], -scored[r][1], text[r]))
            survivors[t] = order[:beam]  # the beam is the search's own parameter
            name = labels.get((y, t), f"{y}={t}")
            for rule in survivors[t]:
                lift, pos, cov, prec = scored[rule]
                p = fisher_greater(pos, cov, targets[t], total)
                if lift > 1 and p <= alpha:
                    results.append((name, ", ".join(text[rule]), level, cov, pos, prec, lift, p))
    results.sort(key=lambda r: (r[0], -r[6], r[1]))
    return df.sparkSession.createDataFrame(results, RULE_SCHEMA)


def _single_counts(cells: DataFrame, y: str, xs: list, classes: list, least: float) -> dict:
    """rule of one condition -> (covered rows per class, None), for those with enough support."""
    pairs = F.inline(F.array(*[F.struct(F.lit(x).alias("c"), F.col(f"`{x}`").alias("v")) for x in xs]))
    counts = (
        cells.select(F.col(f"`{y}`").alias("_t"), pairs).groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("cov"), *[F.count_if(F.col("_t") == t).alias(f"n{i}") for i, t in enumerate(classes)])
        .filter(F.col("cov") >= least)
    )
    rows = small_rows(counts, MAX_CANDIDATES, "candidate rules; raise the support")
    return {((r["c"], r["v"]),): ([r[f"n{i}"] for i in range(len(classes))], None) for r in rows}


def _extensions(items: list, survivors: dict, xs: list) -> dict:
    """rule -> the classes of whose beam it extends a rule."""
    out: dict = {}
    for t, rules in survivors.items():
        for rule in rules:
            used = {c for c, _ in rule}
            for (item,) in items:
                if item[0] not in used:
                    out.setdefault(tuple(sorted((*rule, item), key=lambda c: xs.index(c[0]))), set()).add(t)
    return out


def _best_counted(
    bitmaps: DataFrame, wanted: dict, before: dict, items: list, classes: list, targets: dict, total: int, least: float, beam: int,
) -> dict:
    """rule -> (covered rows per class, classes it counts for) of all rules that can be in a beam.

    ``before`` has the level below; a rule is no better than min(positives of its parts) / support allows.
    """
    at = {r[0]: i for i, r in enumerate(items)}
    base = {t: targets[t] / total for t in classes}
    parts = {r: np.array(n) for r, (n, _) in before.items()}
    bound: dict = {}
    for rule, owners in wanted.items():
        known = [parts[p] for p in (tuple(c for c in rule if c != x) for x in rule) if p in parts]
        top = np.min(known, axis=0)
        if top.sum() < least:
            continue
        bound[rule] = {t: min(1.0, top[classes.index(t)] / max(least, 1.0)) / base[t] for t in owners}
    order = sorted(bound, key=lambda r: -max(bound[r].values()))
    if len(order) > MAX_CANDIDATES:
        raise ValueError(f"candidate rules; raise the support: more than {MAX_CANDIDATES}")
    found: dict = {}
    best: dict = {t: [] for t in classes}  # lifts so far, the beam's best
    for start in range(0, len(order), CHUNK_RULES):
        reach = [r for r in order[start:start + CHUNK_RULES] if any(
            len(best[t]) < beam or b >= best[t][-1] * (1 - 1e-12) for t, b in bound[r].items())]
        if not reach:
            continue
        counts = _counts(bitmaps, [[at[c] for c in r] for r in reach], len(items), len(classes))
        for rule, n in zip(reach, counts):
            cov = int(n.sum())
            if cov < least or not cov:
                continue
            found[rule] = ([int(x) for x in n], wanted[rule])
            for t in wanted[rule]:
                if n[classes.index(t)]:
                    best[t].append(n[classes.index(t)] / cov / base[t])
        best = {t: sorted(b, reverse=True)[:beam] for t, b in best.items()}
    return found


def _bitmaps(cells: DataFrame, y: str, xs: list, items: list, classes: list) -> DataFrame:
    """(items, classes) per block of rows: compressed bitmaps, one after the other, of equal length."""
    of_variable = {x: {v: i for i, (c, v) in enumerate(items) if c == x} for x in xs}
    of_class = {t: i for i, t in enumerate(classes)}
    schema = pa.schema([("items", pa.binary()), ("classes", pa.binary())])

    def packed(codes: list, n: int, rows: int) -> bytes:
        bits = np.zeros((n, -(-rows // 64) * 64), bool)
        for column in codes:
            known = np.flatnonzero(column >= 0)
            bits[column[known], known] = True
        return zlib.compress(np.packbits(bits, axis=1).tobytes(), 1)

    def write(batches):
        held, rows = [], 0

        def block():
            table = pa.Table.from_batches(held)
            columns = []
            for name, lookup in [*((x, of_variable[x]) for x in xs), (y, of_class)]:
                coded = table.column(name).combine_chunks().dictionary_encode()
                ids = np.array([lookup.get(v, -1) for v in coded.dictionary.to_pylist()], np.int64)
                columns.append(ids[coded.indices.to_numpy()] if len(ids) else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([
                pa.array([packed(columns[:-1], len(items), rows)], pa.binary()),
                pa.array([packed(columns[-1:], len(classes), rows)], pa.binary())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                if rows + part.num_rows > BLOCK_ROWS:
                    yield block()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield block()

    return cells.select(*[F.col(f"`{c}`") for c in (*xs, y)]).mapInArrow(write, "items binary, classes binary")


def _counts(bitmaps: DataFrame, rules: list, n_items: int, n_classes: int) -> np.ndarray:
    """Rows of each class that each rule (numbers of its conditions) covers."""
    by_parent: dict = {}
    for i, rule in enumerate(rules):
        by_parent.setdefault(tuple(rule[:-1]), []).append((i, rule[-1]))
    groups = [(parent, np.array([i for i, _ in last]), np.array([j for _, j in last])) for parent, last in by_parent.items()]
    size = len(rules)

    def count(batches):
        total = np.zeros((size, n_classes), np.int64)
        for b in batches:
            for items, classes in zip(b.column(0), b.column(1)):
                items = np.frombuffer(zlib.decompress(items.as_py()), np.uint64).reshape(n_items, -1)
                classes = np.frombuffer(zlib.decompress(classes.as_py()), np.uint64).reshape(n_classes, -1)
                for parent, places, last in groups:
                    covered = items[last] & np.bitwise_and.reduce(items[list(parent)], axis=0)
                    for t in range(n_classes):
                        total[places, t] += np.bitwise_count(covered & classes[t]).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), *[pa.array(total[:, t]) for t in range(n_classes)]], names=["rule", *[f"n{t}" for t in range(n_classes)]])

    names = [f"n{t}" for t in range(n_classes)]
    found = bitmaps.mapInArrow(count, "rule long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((size, n_classes), np.int64)
    for r in found.groupBy("rule").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row per rule
        out[r["rule"]] = r[1:]
    return out
