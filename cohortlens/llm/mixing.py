"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD
from cohortlens.session import checkpoint

# Rows that one prefix-sum cell should hold; the number of cells follows the table.
CELL_ROWS = 20_000


def word_count(column: str):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``epochs`` times its source; what it
    leaves is shared again by weight. In order of (limit / weight) the stopped ones
    come first, so one running sum finds the level that the others get.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(epochs))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(
        Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share))
                     - F.coalesce(F.sum("top").over(before), F.lit(0)))
    s = s.withColumn("wleft", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.max(F.col("left") / F.col("wleft")).over(everything))
    return s.select("source", "source_size",
                    F.least(F.col("top").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, size_column: str = "size", id_column: str = "doc_id", source_column: str = "source",
        weights=(5.0, 2.0, 1.0), share: float = 1.5, epochs: int = 2, seed: str = "mix-1",
        row_column: str | None = None) -> DataFrame:
    """How often the mix takes each row: ``doc_id, source, size, source_size, target, times, taken``.

    Rows of a source are shuffled by md5 of seed and id. A row's virtual finish time
    in epoch e is the words of its source up to and including it, divided by the
    source's target. All rows of all epochs stand in one order by finish time, cut
    where the words reach the sum of the targets. Prefix sums have two levels (cells
    of the shuffle key, then rows of a cell), so a source with a third of all rows is
    spread over many tasks; the cut needs one range of finish times.

    A null source is a source of its own, null or negative sizes count as 0, a null
    id sorts as the empty text, rows that repeat an id are rows of their own. Rows
    of a source without words are never taken. Empty table: empty result.
    ``row_column``, a key of the row, comes back as the first column if it is named.
    """
    own = [] if row_column is None else [row_column]
    size = F.greatest(F.coalesce(F.col(size_column), F.lit(0)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    rows = checkpoint(docs.select(*own, F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                                  size.alias("size"), key.alias("key")))
    per_source = checkpoint(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                    weights, share, epochs))
    n, budget = rows.count(), per_source.agg(F.sum("target")).first()[0] or 0.0

    digits = 1
    while 16**digits * CELL_ROWS < n:
        digits += 1
    rows = rows.withColumn("cell", F.substring("key", 1, digits))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size")
    inside = Window.partitionBy("source", "cell").orderBy("key", F.col("doc_id"), "size", *own).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("inner", F.sum("size").over(inside))
    rows = _same(rows, cells, ["source", "cell"])
    rows = _same(rows, per_source, ["source"])
    rows = rows.withColumn("upto", F.col("base") + F.col("inner"))
    rows = checkpoint(rows.select(*own, "doc_id", "source", "size", "key", "source_size", "target", "upto"))

    def finish(epoch):
        return F.when(F.col("target") > 0, (F.col("upto") + epoch * F.col("source_size")) / F.col("target"))

    entry = rows.select("doc_id", "size", "key", F.explode(F.array(*[
        F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish")) for e in range(epochs)])).alias("x"))
    entry = entry.select("doc_id", "size", "key", "x.epoch", "x.finish").where("finish is not null and size > 0")
    grain = float(max(16, n // CELL_ROWS))
    ranges = entry.groupBy(F.floor(F.col("finish") * grain).alias("range")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("range"))
    last = (ranges.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("range")
            .select("range", (F.col("upto") - F.col("words")).alias("base")).limit(1).collect())
    place = F.struct("finish", "key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "epoch")
    cut = None
    if last:
        here = entry.where(F.floor(F.col("finish") * grain) == last[0]["range"]).withColumn("place", place)
        here = here.withColumn("upto", F.sum("size").over(Window.orderBy("place").rowsBetween(
            Window.unboundedPreceding, 0)) + last[0]["base"])
        cut = here.where(F.col("upto") > budget).agg(F.min("place").alias("cut")).first()["cut"]

    def taken(epoch):
        at = F.struct(finish(epoch).alias("finish"), F.col("key"),
                      F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.lit(epoch).alias("epoch"))
        inside_mix = F.lit(True)
        if cut is not None:
            inside_mix = at < F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["key"]).alias("key"),
                                       F.lit(cut["id"]).alias("id"), F.lit(cut["epoch"]).alias("epoch"))
        return F.when(finish(epoch).isNotNull() & inside_mix, 1).otherwise(0)

    times = sum((taken(e) for e in range(epochs)), F.lit(0)).cast("int")
    return rows.withColumn("times", times).select(
        *own, "doc_id", "source", "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).cast("long").alias("taken"))


def _same(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null; the other side has each key once."""
    other = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(other, on).drop(*[f"_{k}" for k in keys])
