"""Scores of predictions, per group (a fold, a dataset) and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str, yhat: str, labels: list | None = None, by=()) -> DataFrame:
    """(by..., actual, predicted, n); with ``labels`` every declared pair appears, 0 if unseen."""
    by = list(by)
    counts = (
        df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
        .groupBy(*by, F.col(y).cast("string").alias("actual"), F.col(yhat).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not labels:
        return counts
    names = F.array(*[F.lit(str(v)) for v in labels])
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(names).alias("actual")).select(
        "*", F.explode(names).alias("predicted"), F.lit(0).cast("bigint").alias("n")
    )
    return counts.unionByName(grid).groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))


def pooled(counts: DataFrame, by: str, keys: list, merge: list) -> DataFrame:
    """Add a pooled row set to per-group rows: one score over all predictions.

    ``_pooled`` tells them apart, whatever the groups are called.
    """
    each = counts.withColumn(by, F.col(by).cast("string"))
    return each.groupingSets([[by, *keys], list(keys)], by, *keys).agg(
        *merge, (F.grouping(by) == 1).alias("_pooled"))


def labelled(scores: DataFrame, by: str, pool: bool, label: str = "all") -> DataFrame:
    """The pooled row under its label, or without it."""
    if not pool:
        return scores.filter(~F.col("_pooled")).drop("_pooled")
    return scores.withColumn(by, F.when(F.col("_pooled"), F.lit(label)).otherwise(F.col(by))).drop("_pooled")


def _ratio(a, b):
    """a / b, and 0 where nothing was counted."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def multiclass_from_confusion(counts: DataFrame, by=()) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 and false positive rate."""
    by = list(by)
    sides = F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("hits")),
    ))
    same = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    per_class = (
        counts.select(*by, same.alias("tp"), sides)
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("hits").alias("predicted"),
             # a right prediction appears once on each side
             (F.sum("tp") / 2).alias("tp"))
    )
    total = F.sum("support").over(Window.partitionBy(*(by or [F.lit(1)])))  # one row per class
    c = per_class.withColumn("total", total)
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    weight = F.col("support") / F.col("total")
    f1 = _ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    fpr = _ratio(F.col("predicted") - F.col("tp"), F.col("total") - F.col("support"))
    c = c.withColumn("_p", precision).withColumn("_r", recall).withColumn("_w", weight)
    return c.groupBy(*by).agg(
        F.max("total").alias("n"),
        (F.sum("tp") / F.max("total")).alias("accuracy"),
        F.sum(F.col("_w") * F.col("_p")).alias("weighted_precision"),
        F.sum(F.col("_w") * F.col("_r")).alias("weighted_recall"),
        F.sum(F.col("_w") * f1).alias("weighted_f1"),
        F.sum(F.col("_w") * fpr).alias("weighted_fpr"),
    )


def score_multiclass(
    df: DataFrame, y: str, yhat: str, labels: list | None = None, by: str | None = None, pool: bool = True
) -> DataFrame:
    """Scores per ``by`` group plus the pooled row ``all`` (unless ``pool`` is off), or one row without ``by``."""
    if by is None:
        return multiclass_from_confusion(confusion(df, y, yhat, labels))
    counts = confusion(df, y, yhat, labels, [by])
    counts = pooled(counts, by, ["actual", "predicted"], [F.sum("n").alias("n")])
    return labelled(multiclass_from_confusion(counts, [by, "_pooled"]), by, pool)


def binary_from_confusion(counts: DataFrame, positive: str, by=()) -> DataFrame:
    hit, said = F.col("actual") == str(positive), F.col("predicted") == str(positive)

    def cell(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    cells = counts.groupBy(*by).agg(
        cell(hit & said).alias("tp"), cell(hit & ~said).alias("fn"),
        cell(~hit & said).alias("fp"), cell(~hit & ~said).alias("tn"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return cells.select(
        *by, "tp", "fn", "fp", "tn",
        _ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def score_binary(df: DataFrame, y: str, yhat: str, positive, by: str | None = None) -> DataFrame:
    if by is None:
        return binary_from_confusion(confusion(df, y, yhat), positive)
    counts = pooled(confusion(df, y, yhat, None, [by]), by, ["actual", "predicted"], [F.sum("n").alias("n")])
    return labelled(binary_from_confusion(counts, positive, [by, "_pooled"]), by, True)


def score_regression(df: DataFrame, y: str, yhat: str, by: str | None = None, pool: bool = True) -> DataFrame:
    """MSE, RMSE, MAE, R-squared and explained variance."""
    rows = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    actual = F.col(y).cast("double")
    error = actual - F.col(yhat).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.var_pop(actual).alias("_vy"), F.var_pop(error).alias("_ve"),
    ]
    if by is None:
        scored = rows.agg(*aggs)
    else:
        scored = labelled(pooled(rows.select(by, y, yhat), by, [], aggs), by, pool)
    keys = [by] if by else []
    return scored.select(
        *keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("_vy") > 0, 1 - F.col("mse") / F.col("_vy")).alias("r_squared"),
        F.when(F.col("_vy") > 0, 1 - F.col("_ve") / F.col("_vy")).alias("explained_variance"),
    )
