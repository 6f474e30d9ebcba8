"""Regularised linear and logistic models on standardised inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G

# penalty -> weight of the l1 part; None takes the l1_ratio parameter
PENALTIES = {"none": 0.0, "l2": 0.0, "l1": 1.0, "elasticnet": None}


@dataclass
class LinearClassifierOrRegressor:
    inputs: list  # standardised input Columns
    names: list
    classes: list  # empty for regression
    coef: list  # one row per class, or one row
    intercept: list

    def margin(self, i: int) -> Column:
        out = F.lit(float(self.intercept[i]))
        for x, w in zip(self.inputs, self.coef[i]):
            out = out + x * F.lit(float(w))
        return out

    def column(self) -> Column:
        if not self.classes:
            return self.margin(0)
        options = [
            F.struct((-self.margin(i)).alias("cost"), F.lit(i).alias("at"), F.lit(c).alias("label"))
            for i, c in enumerate(self.classes)
        ]
        return F.array_min(F.array(*options))["label"]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column())

    def rows(self, spark) -> DataFrame:
        out = []
        for i, c in enumerate(self.classes or [None]):
            out.append((c, "intercept", float(self.intercept[i])))
            out += [(c, n, float(w)) for n, w in zip(self.names, self.coef[i])]
        return spark.createDataFrame(out, "class string, term string, coef double")


def standardised(df: DataFrame, columns: list) -> tuple:
    """(names, Columns) of the inputs, centred and divided by the population std."""
    d = G.design(df, columns)
    terms = [t for c in columns for t in d[c]]
    row = df.select(*[t.column.alias(f"_t{i}") for i, t in enumerate(terms)]).agg(*[
        f(f"_t{i}").alias(f"{tag}{i}") for i in range(len(terms))
        for f, tag in ((F.avg, "m"), (F.stddev_pop, "s"))
    ]).first()
    z = [
        (t.column - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(row[f"s{i}"] or 1.0))
        for i, t in enumerate(terms)
    ]
    return [t.name for t in terms], z


def linear_model(
    df: DataFrame, y: str, xs: list, alpha: float = 1e-4, penalty: str = "l2",
    l1_ratio: float = 0.15, max_iter: int = 100,
) -> LinearClassifierOrRegressor:
    """Least squares for a numeric target, logistic for a nominal one."""
    if penalty not in PENALTIES:
        raise ValueError(f"penalty is one of {', '.join(PENALTIES)}")
    rows = complete_rows(df, [y, *xs])
    names, inputs = standardised(rows, xs)
    mix = l1_ratio if PENALTIES[penalty] is None else PENALTIES[penalty]
    reg = 0.0 if penalty == "none" else float(alpha)
    classes = G.nominal_levels(rows, [y])[y] if is_nominal(df, y) else []
    if classes:
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{y}`").cast("string")) - 1
    else:
        label = F.col(f"`{y}`")
    table = rows.select(label.cast("double").alias("_label"), *[x.alias(f"_z{i}") for i, x in enumerate(inputs)])
    table = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(inputs))], outputCol="_features").transform(table)
    common = dict(featuresCol="_features", labelCol="_label", regParam=reg, elasticNetParam=mix,
                  standardization=False, maxIter=max_iter)
    if not classes:
        fitted = LinearRegression(**common).fit(table)
        return LinearClassifierOrRegressor(inputs, names, [], [list(fitted.coefficients)], [fitted.intercept])
    fitted = LogisticRegression(family="multinomial", **common).fit(table)
    return LinearClassifierOrRegressor(
        inputs, names, classes, fitted.coefficientMatrix.toArray().tolist(), list(fitted.interceptVector)
    )
